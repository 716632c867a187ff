"""Which terms set a source apart from its language, and how far sources of a language lie from each other.

A term's deviation grows with its count in the group and falls with its count in the language, so a term that k others
beat in both (and in the order of the terms, which breaks ties) cannot be among the first k. The terms that fewer than k
others dominate form the k-skyband; skybands of parts merge, so each task keeps that of its own rows, and only the merged
one is ranked exactly.
"""

from __future__ import annotations

import operator
import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stage

# Terms are runs of letters of ASCII and of all characters beyond it; in UTF-8 these are the same runs of bytes.
TERM = re.compile(rb"[a-z\x80-\xff]+")
LONG_TEXT = 1 << 20  # bytes from which the terms of a text are not listed at once
MOST_COUNTED = 300_000  # terms that a task counts before it hands them on
LEAST_DOCS = 10
SCALE = 1_000_000_000
MOST_ROWS = 500_000  # rows that a task gathers before it keeps their skyband
MERGES = 64  # parts of a group that are merged apart first
SOURCE_BLOCK = 256  # sources of a language that a task compares with as many others
CELLS = 2_000_000  # of a matrix of terms and sources


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, docs (rows that hold the term) and n (occurrences), added up in each task; not yet summed.

    Null lang, source and text count as empty. Each group also has rows with an empty term, so that groups without terms
    are known.
    """
    schema = "lang string, source string, term string, docs long, n long"

    def rows(held):
        out = [(lang, source, term, d, n) for (lang, source), terms in held.items() for term, (d, n) in terms.items()]
        for at in range(0, len(out), 50_000):
            lang, source, term, d, n = zip(*out[at:at + 50_000])
            yield pa.RecordBatch.from_arrays(
                [pa.array(lang, pa.string()), pa.array(source, pa.string()),
                 pa.array([t.decode() for t in term], pa.string()), pa.array(d, pa.int64()), pa.array(n, pa.int64())],
                ["lang", "source", "term", "docs", "n"])

    def run(batches):
        held, size = defaultdict(dict), 0
        for batch in batches:
            for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text"))):
                terms = held[lang, source]
                size -= len(terms)
                terms.setdefault(b"", [0, 0])
                data = text.encode().lower()
                found = Counter(TERM.findall(data) if len(data) < LONG_TEXT else
                                map(operator.methodcaller("group"), TERM.finditer(data)))
                for term, n in found.items():
                    seen = terms.get(term)
                    if seen is None:
                        terms[term] = [1, n]
                    else:
                        seen[0] += 1
                        seen[1] += n
                size += len(terms)
                if size > MOST_COUNTED:
                    yield from rows(held)
                    held, size = defaultdict(dict), 0
        yield from rows(held)

    plain = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    return plain.mapInArrow(run, schema)


def kept_terms(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """lang, source, term, n (in the group), lang_n, first (once for each lang and term); stored.

    Only terms in at least ``least_docs`` rows of their lang, and one row with an empty term for each group.
    """
    summed = term_counts(docs).groupBy("lang", "source", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"))
    whole = Window.partitionBy("lang", "term")
    total = summed.withColumns({
        "lang_docs": F.sum("docs").over(whole), "lang_n": F.sum("n").over(whole),
        "first": F.col("source") == F.min("source").over(whole)})
    kept = total.filter((F.col("lang_docs") >= least_docs) | (F.col("term") == ""))
    return stage(kept.select("lang", "source", "term", "n", "lang_n", "first"), "terms")


def group_sizes(kept: DataFrame) -> DataFrame:
    """One row for each group: lang, source, group_n, lang_n, v (terms kept in the lang), place and sources (of the lang).

    place numbers the sources of a lang in the order of their UTF-8.
    """
    real = F.col("term") != ""
    groups = kept.groupBy("lang", "source").agg(
        F.sum("n").alias("group_n"), F.count_if(real & F.col("first")).alias("firsts"))
    lang, order = Window.partitionBy("lang"), Window.partitionBy("lang").orderBy("source")
    return groups.select(
        "lang", "source", "group_n", F.sum("group_n").over(lang).alias("lang_n"), F.sum("firsts").over(lang).alias("v"),
        (F.row_number().over(order) - 1).alias("place"), F.count(F.lit(1)).over(lang).cast("int").alias("sources"))


def share(n: Column, total: Column, v: Column) -> Column:
    """1 + floor(SCALE * (n + 2) / (total + 2 v)), exact for any count."""
    scaled = (n + 2).cast("decimal(19,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return F.call_function("div", scaled, (total + 2 * v).cast("decimal(19,0)")) + 1


def deviation(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def skyband(n: np.ndarray, lang_n: np.ndarray, term: np.ndarray, k: int) -> np.ndarray:
    """Places of the rows that fewer than k others dominate: n at least as high, lang_n as low, and an earlier term.

    In order of falling n, rising lang_n, rising term, a row comes after all that dominate it; and a row with k dominators
    has k of them in the skyband, so it is compared with the rows kept so far only.
    """
    rank = np.argsort(np.argsort(term, kind="stable"), kind="stable")
    order = np.lexsort((rank, lang_n, -n))
    low, early, kept = np.empty(len(n), dtype=np.int64), np.empty(len(n), dtype=np.int64), []
    for i in order:
        m = len(kept)
        if m < k or np.count_nonzero((low[:m] <= lang_n[i]) & (early[:m] < rank[i])) < k:
            low[m], early[m] = lang_n[i], rank[i]
            kept.append(i)
    return np.array(kept, dtype=np.int64)


def skyband_frame(df: pd.DataFrame, k: int) -> pd.DataFrame:
    """The skyband of each group in a frame of lang, source, term, n, lang_n."""
    parts = [g.iloc[skyband(g["n"].to_numpy(), g["lang_n"].to_numpy(), g["term"].to_numpy(dtype=object), k)]
             for _, g in df.groupby(["lang", "source"], sort=False)]
    return pd.concat(parts) if parts else df


def merged_skybands(kept: DataFrame, k: int) -> DataFrame:
    """lang, source, term, n, lang_n of the terms that may be among the first k of their group.

    Tasks reduce whatever rows they hold; the parts of a group are merged in two steps, so no task gathers the skybands
    of all tasks.
    """
    columns = ["lang", "source", "term", "n", "lang_n"]
    schema = "lang string, source string, term string, n long, lang_n long"

    def local(frames):
        held, size = [], 0
        for df in frames:
            held.append(df)
            size += len(df)
            if size >= MOST_ROWS:
                held = [skyband_frame(pd.concat(held), k)]
                if len(held[0]) > MOST_ROWS // 2:  # little is dominated here
                    yield held.pop()
                size = sum(map(len, held))
        if size:
            yield skyband_frame(pd.concat(held), k)

    rows = kept.filter("term <> ''").select(*columns).mapInPandas(local, schema)
    lot = F.pmod(F.xxhash64("term"), F.lit(MERGES))
    for keys in (["lang", "source", lot], ["lang", "source"]):
        rows = rows.groupBy(*keys).applyInPandas(lambda df: skyband_frame(df, k), schema)
    return rows


def deviating_terms(kept: DataFrame, groups: DataFrame, k: int = 10) -> DataFrame:
    """The first k terms of each group by deviation above the lang: lang, source, item, value, rank."""
    sizes = groups.select(F.col("lang").alias("__l"), F.col("source").alias("__s"), "group_n",
                          F.col("lang_n").alias("all_n"), "v")
    met = merged_skybands(kept, k).join(sizes, (F.col("lang") == F.col("__l")) & (F.col("source") == F.col("__s")))
    p, q = share(F.col("n"), F.col("group_n"), F.col("v")), share(F.col("lang_n"), F.col("all_n"), F.col("v"))
    valued = met.withColumns({"p": p, "q": q}).filter("n > 0 and p > q")
    out = valued.select("lang", "source", F.col("term").alias("item"), deviation(F.col("p"), F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def exact(values: np.ndarray) -> np.ndarray:
    """As 64-bit integers if SCALE times the values fits, else as Python's."""
    return values if not len(values) or int(values.max()) < (1 << 62) // SCALE else values.astype(object)


def matrix_sums(terms: pd.DataFrame, rows: pd.DataFrame, columns: pd.DataFrame, with_base: bool) -> list:
    """(place, place, sum) for the pairs of sources of two blocks: over the terms at hand, deviation beyond the one of
    two zero counts; that base for all kept terms is added once, by the task that is told to."""
    sources = pd.concat([rows, columns]).drop_duplicates("place").sort_values("place")
    v = int(sources["v"].iloc[0])
    if not v:
        return [(a, b, 0) for a in rows["place"].tolist() for b in columns["place"].tolist() if a < b]
    place, size = sources["place"].to_numpy(), exact(sources["group_n"].to_numpy()) + 2 * v
    zero = (1 + 2 * SCALE // size).astype(np.int64)
    at_row = np.searchsorted(place, rows["place"].to_numpy())
    at_col = np.searchsorted(place, columns["place"].to_numpy())

    def gap(p, q):
        d = p - q
        return d * d // (p + q)

    total = np.zeros((len(at_row), len(at_col)), dtype=np.int64)
    if len(terms):
        code, _ = pd.factorize(terms["term"])
        col = np.searchsorted(place, terms["place"].to_numpy())
        p = (1 + SCALE * (exact(terms["n"].to_numpy()) + 2) // size[col]).astype(np.int64)
        by_term = np.argsort(code, kind="stable")
        code, col, p = code[by_term], col[by_term], p[by_term]
        step = max(1, CELLS // len(place))
        for first in range(0, int(code[-1]) + 1, step):
            lo, hi = np.searchsorted(code, [first, first + step])
            count = int(code[hi - 1]) - first + 1
            dense = np.repeat(zero[:, None], count, axis=1)
            dense[col[lo:hi], code[lo:hi] - first] = p[lo:hi]
            for i, r in enumerate(at_row):
                j = np.flatnonzero(at_col > r)
                total[i, j] += gap(dense[r], dense[at_col[j]]).sum(axis=1) - count * gap(zero[r], zero[at_col[j]])
    return [(int(place[r]), int(place[c]), int(total[i, j]) + (v * int(gap(zero[r], zero[c])) if with_base else 0))
            for i, r in enumerate(at_row) for j, c in enumerate(at_col) if r < c]


def source_distances(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """Every ordered pair of sources of a lang: lang, source, item, value (over all kept terms), rank.

    Terms are dealt into parts of a lang; a task holds one part for two blocks of sources as a matrix, whose zero counts
    are the same share everywhere, and returns one sum for each pair of its sources. Deviation is symmetric, so a pair
    is added up once.
    """
    parts = int(kept.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    near = groups.select("lang", "source", "group_n", "v", "place", "sources",
                         F.floor(F.col("place") / SOURCE_BLOCK).cast("int").alias("block"))
    last = F.floor((F.col("sources") - 1) / SOURCE_BLOCK).cast("int")
    other = F.explode(F.sequence(F.lit(0), last))
    spread = near.withColumn("other", other).withColumn("x", F.least("block", "other")).withColumn("y", F.greatest("block", "other"))
    sides = spread.select("lang", "x", "y", "place", "group_n", "v", "block").withColumn(
        "part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    places = spread.select(F.col("lang").alias("__l"), F.col("source").alias("__s"), *[
        F.col(c).alias(f"__{c}") for c in ("place", "x", "y")])
    rows = kept.filter("term <> ''").select("lang", "source", "term", "n")
    rows = rows.join(places, (F.col("lang") == F.col("__l")) & (F.col("source") == F.col("__s"))).select(
        "lang", *[F.col(f"__{c}").alias(c) for c in ("x", "y", "place")], "term", "n", F.pmod(F.xxhash64("term"), F.lit(parts)).cast("int").alias("part"))

    def compare(key, terms, sources):
        lang, x, y, part = key
        if not len(sources):
            return pd.DataFrame({"lang": [], "a": [], "b": [], "s": []})
        found = matrix_sums(terms, sources[sources["block"] == x], sources[sources["block"] == y], part == 0)
        return pd.DataFrame({"lang": lang, "a": [f[0] for f in found], "b": [f[1] for f in found], "s": [f[2] for f in found]})

    keys = ["lang", "x", "y", "part"]
    sums = rows.groupBy(*keys).cogroup(sides.groupBy(*keys)).applyInPandas(compare, "lang string, a int, b int, s long")
    pairs = sums.groupBy("lang", "a", "b").agg(F.sum("s").alias("value"))
    both = pairs.select("lang", F.explode(F.array(
        F.struct(F.col("a").alias("me"), F.col("b").alias("you")),
        F.struct(F.col("b").alias("me"), F.col("a").alias("you")))).alias("e"), "value").select("lang", "e.*", "value")
    mine = groups.select(F.col("lang").alias("__l"), F.col("place").alias("__me"), "source")
    yours = groups.select(F.col("lang").alias("__k"), F.col("place").alias("__you"), F.col("source").alias("item"))
    named = both.join(mine, (F.col("lang") == F.col("__l")) & (F.col("me") == F.col("__me"))).join(
        yours, (F.col("lang") == F.col("__k")) & (F.col("you") == F.col("__you")))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return named.select("lang", "source", "item", "value", F.row_number().over(order).alias("rank"))


def audit(docs: DataFrame, k: int = 10, least_docs: int = LEAST_DOCS) -> DataFrame:
    """lang, source, part (``pair`` or ``term``), item, value, rank for every group (lang, source) of documents.

    Null text, lang and source are read as empty; repeated rows and ids count as documents of their own; texts without
    letters give groups without terms; a lang of one source has no pairs, and one without kept terms has pairs of value 0.
    Ties go to the earlier item in UTF-8. An empty table gives no rows. Other columns are not read.
    """
    kept = kept_terms(docs, least_docs)
    groups = stage(group_sizes(kept), "groups")
    columns = ["lang", "source", "part", "item", "value", "rank"]
    pairs = source_distances(kept, groups).withColumn("part", F.lit("pair")).select(*columns)
    return pairs.unionByName(deviating_terms(kept, groups, k).withColumn("part", F.lit("term")).select(*columns))
