"""N-gram Jaccard join by a size-aware heavy-light split, down to connected components.

A document's set holds 64-bit hashes of its distinct 5-word shingles; equal sets are one *class*. Classes are light or
heavy by size. Light ones enumerate the subsets of the size any partner must share with them; heavy ones (and light ones
that may meet them) enter the inverted lists of their rarest shingles, as many as any partner must hit; larger ones enter
a few more and must hit several. Scanning a list in order of size counts the hits of a class with the few before it that
may be similar, and pairs with enough hits fall into one *candidate group*. Where there are more than a few, neighbours
are grouped without a count. Inside a group, all classes of compatible size are compared exactly, in blocks; a block
keeps the links that join what is not joined yet. So no link between groups is lost, a list gives at most a fixed number
of pairs for each entry, and copies are never expanded.
"""

from __future__ import annotations

from collections import deque
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stage
from .components import components
from .ordering import prefix_sums

NGRAM = 5
PERCENT = 80
MOST_LIGHT = 16  # sizes beyond this are never light
SCAN_COST = 16  # work of an inverted-list entry, in subset entries
LEAST_CELLS, MOST_CELLS = 1 << 20, 1 << 24  # of the shingle count sketch
HIT_STEP = 50  # shingles of a set for each list more that a partner must hit
MOST_BEFORE = 16  # similar sizes before an entry in its list, up to which pairs are counted
LIST_BLOCK = 100_000  # entries of an inverted list that one task scans
BLOCK_ROWS, BLOCK_SHINGLES = 1024, 1_500_000  # of a block of compared classes
RARE = 16  # sets of a block that hold a shingle, up to which its pairs are counted one by one
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """Hash of each word, computed once in a task; the table starts anew when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 200_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


HASHES = WordHashes()  # of this worker


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread every bit of the input over the output (a 64-bit finalizer)."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingles(text: str | None, hashes: WordHashes, n: int = NGRAM) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles; one of the whole sequence if it is shorter; empty without words.

    ``bytes.lower`` maps A-Z only, and ``bytes.split`` cuts at space and the control characters 9 to 13.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < n:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed=1)], np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    out = w[: len(w) - n + 1]
    for k in range(1, n):
        out = mixed(out * MULTIPLIER + w[k: len(w) - n + 1 + k])
    return np.unique(out)


def class_of(s: np.ndarray) -> int:
    """63-bit name of a set."""
    return xxhash.xxh3_64_intdigest(s.tobytes()) >> 1


def least_overlap(a: int, b: int, percent: int = PERCENT) -> int:
    """Smallest intersection of sets of sizes a and b with 100 * intersection >= percent * union."""
    return -(-percent * (a + b) // (100 + percent))


def fits(a: int, b: int, percent: int = PERCENT) -> bool:
    return 100 * min(a, b) >= percent * max(a, b)


def prefix_length(n: int, percent: int = PERCENT) -> int:
    """As many shingles of a set that every similar set holds one of them."""
    return n + (percent * n) // -100 + 1


def least_hits(n: int, percent: int = PERCENT) -> int:
    """Lists that a similar set must hit, of the first ``prefix_length + least_hits - 1`` shingles of either.

    At least ``percent * n`` / 100 shingles are shared, so at most ``n`` less that are not, and for two sets the smaller
    of their numbers holds.
    """
    return min(1 + n // HIT_STEP, -(-percent * n // 100))


def subset_entries(n: int, light: int, percent: int = PERCENT) -> int:
    return sum(comb(n, least_overlap(n, t, percent)) for t in range(1, light + 1) if fits(n, t, percent))


def light_boundary(histogram: dict[int, int], percent: int = PERCENT, scan_cost: float = SCAN_COST) -> int:
    """Largest light size, chosen so that subset entries and list entries cost least on these sizes."""
    def cost(light):
        small = sum(m * subset_entries(n, light, percent) for n, m in histogram.items() if n <= light)
        lists = sum(m * prefix_length(n, percent) for n, m in histogram.items() if n > light or not fits_all(n, light))
        return small + scan_cost * lists

    def fits_all(n, light):  # every similar size is light
        return 100 * n // percent <= light

    return min(range(MOST_LIGHT + 1), key=lambda x: (cost(x), x))


def _summaries(docs: DataFrame, cells: int) -> DataFrame:
    """Per document: size and class of its set; per task: the used cells of its shingle counts, 65536 in a row."""
    bits = np.uint64(65 - int(cells).bit_length())
    ints = pa.list_(pa.int32())
    names = ["doc_id", "text_key", "n", "class", "cells", "counts"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), ints, ints]

    def run(batches):
        hashes, counts = WordHashes(), np.zeros(cells, np.int32)
        for batch in batches:
            sizes, keys = [], []
            for text in batch.column("text").to_pylist():
                s = shingles(text, hashes)
                sizes.append(len(s))
                keys.append(class_of(s) if len(s) else -1)
                np.add.at(counts, (s >> bits).astype(np.int64), 1)
            rows = [batch.column("doc_id"), batch.column("text_key"), pa.array(sizes, pa.int64()), pa.array(keys, pa.int64())]
            yield pa.RecordBatch.from_arrays(rows + [pa.nulls(len(sizes), ints)] * 2, names)
        used = np.flatnonzero(counts).astype(np.int32)
        for at in range(0, len(used), 65536):
            part = used[at:at + 65536]
            row = [pa.nulls(1, k) for k in kinds[:4]] + [pa.array([part], ints), pa.array([counts[part]], ints)]
            yield pa.RecordBatch.from_arrays(row, names)

    keyed = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("text_key"))
    return keyed.mapInArrow(
        run, "doc_id long, text_key long, n long, class long, cells array<int>, counts array<int>")


def _sketch(rows: DataFrame, cells: int) -> np.ndarray:
    """Counts by hash cell over all tasks. Only the fixed-size sketch comes to the driver, saturated to 31 bits."""
    flat = rows.filter(F.col("cells").isNotNull()).select(F.inline(F.arrays_zip("cells", "counts")))
    summed = flat.groupBy("cells").agg(F.least(F.sum("counts"), F.lit(2**31 - 1)).cast("int").alias("n")).toArrow()
    total = np.zeros(cells, np.int32)
    total[summed.column("cells").to_numpy()] = summed.column("n").to_numpy()
    return total


def _entries(docs: DataFrame, sketch, light: int, percent: int) -> DataFrame:
    """List entries (token, part, class, lo = hi = size, cut) of every document; long lists are cut into parts."""
    shared = docs.sparkSession.sparkContext.broadcast(sketch)

    def run(frames):
        hashes, counts = WordHashes(), shared.value
        bits = np.uint64(65 - len(counts).bit_length())
        limit = max(LIST_BLOCK, 8 * int(counts.mean()))
        for df in frames:
            tokens, parts, cuts, owners, sizes = [], [], [], [], []

            def put(token, part, cut, key, n):
                tokens.append(token)
                parts.append(part)
                cuts.append(cut)
                owners.append(np.full(len(token), key, np.int64))
                sizes.append(np.full(len(token), n, np.int64))

            for text in df["text"]:
                s = shingles(text, hashes)
                n = len(s)
                if not n:
                    continue
                key = class_of(s)
                if n <= light:
                    made = [xxhash.xxh3_64_intdigest(np.array(c, np.uint64).tobytes(), seed=min(n, t) * 1000 + max(n, t))
                            for t in range(1, light + 1) if fits(n, t, percent)
                            for c in combinations(s.tolist(), least_overlap(n, t, percent))]
                    made = np.array(sorted(set(made)), np.uint64)
                    put(made, np.zeros(len(made), np.int64), np.zeros(len(made), bool), key, n)
                if n > light or 100 * n // percent > light:
                    estimate = counts[(s >> bits).astype(np.int64)]
                    p = prefix_length(n, percent) + least_hits(n, percent) - 1
                    first = np.lexsort((s, estimate))[:p]
                    pieces = estimate[first].astype(np.int64) // limit + 1
                    put(s[first], key % pieces, pieces > 1, key, n)
            if tokens:
                n = np.concatenate(sizes)
                yield pd.DataFrame({"token": np.concatenate(tokens).view(np.int64), "part": np.concatenate(parts),
                                    "class": np.concatenate(owners), "lo": n, "hi": n, "cut": np.concatenate(cuts)})

    return docs.select("text").mapInPandas(run, "token long, part long, class long, lo long, hi long, cut boolean")


def _scan(rows: DataFrame, keys: list[str], percent: int) -> DataFrame:
    """Scan inverted lists in order of size for links between classes of compatible size.

    Input: keys, class, lo, hi (the smallest and largest size that the entry stands for), cut. Output: pairs (a, b) with
    the hits they ``need`` in all lists. An entry is paired with each of compatible size before it; where these are more
    than ``MOST_BEFORE``, or the list is cut, neighbours are linked instead and need none. For each run of compatible
    sizes of a cut list there is one row (token, class, lo, hi). Streams over sorted rows; no list is held in memory.
    """
    def run(frames):
        last = None  # key, head, lo, hi of the open run of a cut list
        key, recent, tied, at = None, deque(maxlen=MOST_BEFORE + 1), 0, 0  # of the open list; entry ``tied`` is linked
        for df in frames:
            links, runs = [], []
            same = np.logical_and.reduce([df[k].to_numpy()[1:] == df[k].to_numpy()[:-1] for k in keys])
            met = np.concatenate([[True], same]) | np.concatenate([same, [True]]) | df["cut"].to_numpy()
            met[:1] = True
            df = df[met]  # an entry alone in its list meets nothing
            for row in zip(*[df[k] for k in keys], df["class"], df["lo"], df["hi"], df["cut"]):
                own, (owner, lo, hi, cut) = row[:len(keys)], row[len(keys):]
                if cut:
                    if last and last[0] == own and 100 * last[3] >= percent * lo:
                        if owner != last[1]:
                            links.append((last[1], owner, 0))
                        last = (own, last[1], last[2], max(last[3], hi))
                    else:
                        if last:
                            runs.append(last)
                        last = (own, owner, lo, hi)
                    continue
                if own != key:
                    key, tied, at = own, 0, 0
                    recent.clear()
                elif recent[-1][0] == owner:
                    continue  # a copy
                while recent and 100 * recent[0][1] < percent * lo:
                    recent.popleft()
                if len(recent) <= MOST_BEFORE:
                    links += [(c, owner, least_hits(n, percent)) for c, n in recent]
                else:
                    chain = [c for c, _ in recent][max(0, tied - at + len(recent)):] + [owner]
                    links += [(c, d, 0) for c, d in zip(chain, chain[1:])]
                    tied = at
                recent.append((owner, lo))
                at += 1
            yield from out(links, runs)
        yield from out([], [last] if last else [])

    def out(links, runs):
        if links:
            a, b, need = np.array(links, np.int64).T
            yield pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b), "need": need,
                                "token": None, "class": None, "lo": None, "hi": None})
        if runs:
            yield pd.DataFrame({"a": None, "b": None, "need": None, "token": [r[0][0] for r in runs],
                                "class": [r[1] for r in runs], "lo": [r[2] for r in runs], "hi": [r[3] for r in runs]})

    placed = rows.repartition(*keys).sortWithinPartitions(*keys, "lo", "class")
    return placed.mapInPandas(run, "a long, b long, need long, token long, class long, lo long, hi long")


def candidate_links(docs: DataFrame, sketch: np.ndarray, light: int, percent: int) -> DataFrame:
    """Links (a, b) between classes whose components hold together every pair of classes that may be similar."""
    scanned = stage(_scan(_entries(docs, sketch, light, percent), ["token", "part"], percent), "scanned")
    pairs = scanned.filter("a is not null").groupBy("a", "b").agg(F.count(F.lit(1)).alias("hits"), F.min("need").alias("need"))
    links = pairs.filter("hits >= need").select("a", "b")
    runs = scanned.filter("token is not null").select("token", "class", "lo", "hi", F.lit(True).alias("cut"))
    if not runs.isEmpty():  # the runs of the parts of a cut list meet in a second scan
        links = links.union(_scan(runs, ["token"], percent).filter("a is not null").select("a", "b"))
    return links


def _blocks(members: DataFrame) -> DataFrame:
    """Cut each candidate group, in order of size, into blocks of bounded rows and shingles."""
    weight = F.greatest(F.col("n"), F.lit(BLOCK_SHINGLES // BLOCK_ROWS))
    ordered = prefix_sums(members, ["n", "class"], ["grp"], below=weight)
    return ordered.withColumn("block", F.floor(F.col("below") / BLOCK_SHINGLES).cast("long")).drop("below")


def _block_pairs(blocks: DataFrame, percent: int) -> DataFrame:
    """Blocks of one group to compare: (grp, x, y), y not before x, whose sizes may be compatible."""
    spans = blocks.groupBy("grp", "block").agg(F.min("n").alias("least"), F.max("n").alias("most"))
    spans = stage(spans, "spans")
    x = spans.select(F.col("grp"), F.col("block").alias("x"), F.col("most").alias("x_most"))
    y = spans.select(F.col("grp").alias("g"), F.col("block").alias("y"), F.col("least").alias("y_least"))
    near = (F.col("grp") == F.col("g")) & (F.col("x") <= F.col("y")) & (100 * F.col("x_most") >= percent * F.col("y_least"))
    return x.join(y, near).select("grp", "x", "y")


def _forest(sets: list[np.ndarray], new: int, percent: int) -> list[tuple[int, int]]:
    """Links that join the sets, pairs of the first ``new`` among themselves left out when there are others.

    Sets that share too few of their shingles with all others are left out first. Overlaps are exact: pairs of rare
    shingles are counted one by one, others become columns of a 0/1 matrix that is multiplied in slices.
    """
    n, size = np.array([len(s) for s in sets]), len(sets)
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    rows = np.repeat(np.arange(size, dtype=np.int32), n)[order]
    flat = flat[order]
    heads = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]])
    count = np.repeat(np.diff(np.r_[heads, len(flat)]), np.diff(np.r_[heads, len(flat)]))
    kept = np.flatnonzero(100 * np.bincount(rows[count > 1], minlength=size) >= percent * n)
    if len(kept) < size:
        among = int((kept < new).sum())
        if len(kept) < 2 or new < size and among in (0, len(kept)):
            return []
        return [(int(kept[i]), int(kept[j])) for i, j in _forest([sets[i] for i in kept], among, percent)]
    overlap = np.zeros((size, size), np.int64)
    few = (count > 1) & (count <= RARE)
    r, t = rows[few], flat[few]
    for d in range(1, RARE):  # of a rare shingle, every pair of its sets
        same = t[d:] == t[:-d]
        if not same.any():
            break
        overlap += np.bincount(r[:-d][same].astype(np.int64) * size + r[d:][same], minlength=size * size).reshape(size, size)
    overlap += overlap.T
    many = count > RARE
    r, columns = rows[many], np.unique(flat[many], return_inverse=True)[1]
    for start in range(0, int(columns.max(initial=-1)) + 1, 2048):
        lo, hi = np.searchsorted(columns, [start, start + 2048])
        part = np.zeros((size, 2048), np.float32)
        part[r[lo:hi], columns[lo:hi] - start] = 1
        overlap += (part @ part.T).astype(np.int64)
    linked = np.triu((100 + percent) * overlap >= percent * (n[:, None] + n[None, :]), 1)
    if new < len(sets):
        linked[:new, :new] = False
        linked[new:, new:] = False
    near = linked | linked.T
    seen, forest = np.zeros(len(sets), bool), []
    for start in range(len(sets)):
        stack = [] if seen[start] else [start]
        seen[start] = True
        while stack:
            i = stack.pop()
            new_ones = np.flatnonzero(near[i] & ~seen)
            seen[new_ones] = True
            forest += [(i, int(j)) for j in new_ones]
            stack += new_ones.tolist()
    return forest


def _compare(docs: DataFrame, blocks: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between classes: a spanning forest of the exact links of each pair of blocks.

    The texts of one document of each class are dealt to the pairs of blocks that need them; texts take half the room
    of their sets, which the task makes again.
    """
    pairs = _block_pairs(blocks, percent)
    left = pairs.select("grp", "x", "y", F.col("x").alias("at"))
    right = pairs.filter("x <> y").select("grp", "x", "y", F.col("y").alias("at"))
    dealt = left.union(right).withColumnRenamed("grp", "g")
    needed = blocks.join(dealt, (F.col("grp") == F.col("g")) & (F.col("block") == F.col("at"))).select(
        "grp", "x", "y", "block", "class", F.col("first.doc_id").alias("d"), F.col("first.text_key").alias("k"))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc"), "text", F.xxhash64("text").alias("key"))
    again = Window.partitionBy("doc", "key").orderBy("key")
    one = keyed.withColumn("n", F.row_number().over(again)).filter("n = 1")  # of repeated rows
    rows = one.join(needed, (F.col("doc") == F.col("d")) & (F.col("key") == F.col("k"))).select(
        "grp", "x", "y", "block", "class", "text")

    def run(key, df):
        df = df.sort_values(["block", "class"])
        owners = df["class"].to_numpy()
        new = int((df["block"] == key[1]).sum())
        held = [shingles(t, HASHES) for t in df["text"]]
        return pd.DataFrame([(owners[i], owners[j]) for i, j in _forest(held, new, percent)], columns=["a", "b"], dtype=np.int64)

    return rows.groupBy("grp", "x", "y").applyInPandas(run, "a long, b long")


def link_documents(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, text_key (hash of its text), n_shingles, class and component_id.

    component_id is the smallest doc_id that is reachable by links. Documents without words have an empty set and are
    components of their own, as are documents without an id, whose component_id is null. Copies share a class and are
    not compared. Repeated rows give repeated rows. Texts are read whole.
    """
    cells = sketch_cells(docs)
    rows = stage(_summaries(docs, cells), "summaries")
    per_doc = rows.filter("cells is null").drop("cells", "counts")
    sketch = _sketch(rows, cells)
    own = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    classes = stage(per_doc.filter(own).groupBy("class", "n").agg(
        F.min(F.struct("doc_id", "text_key")).alias("first"), F.count(F.lit(1)).alias("copies")), "classes")
    histogram = {r.n: r.m for r in classes.filter(F.col("n") <= MOST_LIGHT * 2).groupBy("n").agg(
        F.count(F.lit(1)).alias("m")).collect()}
    light = light_boundary(histogram, percent)
    named = docs.filter(F.col("doc_id").isNotNull())
    groups = stage(components(candidate_links(named, sketch, light, percent)), "groups")
    members = stage(groups.join(classes, F.col("node") == F.col("class")).select(
        F.col("label").alias("grp"), "class", "n", "first"), "members")
    blocks = stage(_blocks(members), "blocks")
    labels = stage(components(_compare(named, blocks, percent)), "labels")
    marked = per_doc.filter(own).join(labels, F.col("class") == F.col("node"), "left").withColumn(
        "__c", F.coalesce("label", "class"))
    marked = stage(marked.select("doc_id", "text_key", "n", "class", "__c"), "marked")
    least = marked.groupBy("__c").agg(F.min("doc_id").alias("component_id")).withColumnRenamed("__c", "__l")
    linked = marked.join(least, F.col("__c") == F.col("__l")).select("doc_id", "text_key", "n", "class", "component_id")
    alone = per_doc.filter(~own).select("doc_id", "text_key", "n", "class", F.col("doc_id").alias("component_id"))
    return linked.union(alone).withColumnRenamed("n", "n_shingles")


def sketch_cells(docs: DataFrame) -> int:
    """Cells for the shingle counts, by the number of words: at least 2^20 (8 MB in a task), at most 2^24."""
    n = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    cells = LEAST_CELLS
    while cells < MOST_CELLS and cells * 2048 < n:
        cells *= 2
    return cells


def keep_first(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One document of each component, that with the smallest doc_id, and every document without an id.

    Of rows that agree in doc_id and text one stays.
    """
    linked = link_documents(docs, percent)
    kept = linked.filter(F.col("doc_id") == F.col("component_id")).select(
        F.col("doc_id").alias("__d"), F.col("text_key").alias("__t")).distinct()
    named = docs.filter(F.col("doc_id").isNotNull()).withColumn("__k", F.xxhash64("text"))
    one = named.withColumn("__n", F.row_number().over(Window.partitionBy("doc_id", "__k").orderBy("__k"))).filter("__n = 1")
    stay = one.join(kept, (F.col("doc_id").cast("long") == F.col("__d")) & (F.col("__k") == F.col("__t")), "left_semi")
    return stay.drop("__k", "__n").union(docs.filter(F.col("doc_id").isNull()))
