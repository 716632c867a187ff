"""Toxicity of whole texts: Levenshtein automata on a lexicon trie, and windows that tell quotation from abuse.

The lexicon is learned from labelled documents: words, and word beginnings that stand for many inflected words, that
toxic documents hold far more often than others. A misspelled word is found by running the Levenshtein automaton of the
word against the trie of the lexicon. Hits are weighed by their windows (quotation marks around them and reporting words
before them), and a logistic model turns the sums into a score.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE_ROWS = 20_000  # labelled rows, in expectation, that lexicon and model are fitted on
HOLD_OUT = 5  # rows whose crc32(doc_id) is divisible by this are never learned from
STEMS = range(4, 9)  # lengths of word beginnings that may be terms
LONGEST_TERM = 24
MOST_TERMS = 1000
LEAST_G2, LEAST_ODDS = 28.0, 12.0  # significance and strength of a term
FUZZY_FROM = 5  # words from this length on (stems from the next) may differ by one edit
WINDOW = 10  # words on both sides of a hit
DENSE = 50  # words of a window whose hits are counted
MOST_CACHED = 300_000
TOKEN = re.compile(r"[^\W_]+")
# Fixed words that announce a quotation.
REPORTING = frozenset("said says wrote writes called calls quote quoted quoting word words term terms zitat citation cita".split())
OPENING, CLOSING = "\"“«„‘", "\"”»“’"
FEATURES = ("exact", "fuzzy", "quoted", "distinct", "dense", "share")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % HOLD_OUT == 0, F.lit(False))


def allowed(term: str, stem: bool) -> int:
    """Edits that a word may be away from a term."""
    return int(len(term) >= FUZZY_FROM + stem)


class Lexicon:
    """Trie of terms; a term is (text, is it a stem, weight)."""

    def __init__(self, terms: list[tuple[str, bool, float]]):
        self.terms = terms
        self.trie: dict = {}
        self.cache: dict[str, tuple[float, bool, str] | None] = {}
        self.near: set[str] = set()  # terms, and those that may be one edit away without each of their letters
        wholes, starts = set(), set()
        for text, stem, weight in terms:
            node = self.trie
            for c in text:
                node = node.setdefault(c, {})
            node[""] = (text, stem, weight)
            self.near.add(text)
            edits = allowed(text, stem)
            if edits:
                self.near.update(text[:k] + text[k + 1:] for k in range(len(text)))
            (starts if stem else wholes).update(range(len(text) - edits, len(text) + edits + 1))
        self.wholes, self.starts = frozenset(wholes), sorted(starts)

    def may(self, word: str) -> bool:
        """Whether the word, or a beginning of it, is near a term: without one letter each at most, both are equal."""
        n = len(word)
        return n in self.wholes and self.touches(word) or any(self.touches(word[:m]) for m in self.starts if m <= n)

    def touches(self, part: str) -> bool:
        near = self.near
        if part in near:
            return True
        for k in range(len(part)):
            if part[:k] + part[k + 1:] in near:
                return True
        return False

    def match(self, word: str) -> tuple[float, bool, str] | None:
        """(weight, exact, term) of the best term within the allowed edits of the word, if any."""
        if word in self.cache:
            return self.cache[word]
        if len(self.cache) >= MOST_CACHED:
            self.cache.clear()
        found = self.search(word) if self.may(word) else None
        self.cache[word] = found
        return found

    def search(self, word: str) -> tuple[float, bool, str] | None:
        """Walk the trie with the states of the word's automaton; states beyond one edit end a branch.

        Under a node at depth i only the word's first i - 1, i and i + 1 letters can be within one edit, so a state is
        the three edit counts to these.
        """
        n, far, best = len(word), 9, None
        stack = [(self.trie, 0, far, 0, 1 if n else far)]
        while stack:
            node, i, p, q, r = stack.pop()
            for c, below in node.items():
                if c == "":
                    term, stem, weight = below
                    edits = min(p, q, r) if stem else (p, q, r)[n - i + 1] if -1 <= n - i <= 1 else far
                    if edits <= allowed(term, stem):
                        rank = (edits == 0, weight, len(term), term)
                        best = max(best, rank) if best else rank
                    continue
                a = min(p + (word[i - 1] != c) if 1 <= i <= n else far, q + 1)
                b = min(q + (word[i] != c), r + 1, a + 1) if i < n else far
                d = min(r + (word[i + 1] != c), b + 1) if i + 1 < n else far
                if a <= 1 or b <= 1 or d <= 1:
                    stack.append((below, i + 1, a, b, d))
        return (best[1], best[0], best[3]) if best else None


def features(text: str | None, lexicon: Lexicon) -> list[float]:
    """Window-weighed sums of a text's hits: FEATURES in order. Null and empty texts have none."""
    lowered = (text or "").lower()
    tokens = TOKEN.findall(lowered)
    hits = {w: m for w in set(tokens) if (m := lexicon.match(w))}
    if not hits:
        return [0.0] * len(FEATURES)
    places = list(TOKEN.finditer(lowered))
    at = [i for i, w in enumerate(tokens) if w in hits]
    exact = fuzzy = quoted = 0.0
    for i in at:
        weight, is_exact, _ = hits[tokens[i]]
        q = quotation(lowered, tokens, places, i)
        quoted += weight * q
        if is_exact:
            exact += weight * (1 - q)
        else:
            fuzzy += weight * (1 - q)
    dense, start = 0, 0
    for end, i in enumerate(at):
        while i - at[start] >= DENSE:
            start += 1
        dense = max(dense, end - start + 1)
    distinct = len({hits[tokens[i]][2] for i in at})
    return [math.log1p(exact), math.log1p(fuzzy), math.log1p(quoted), math.log1p(distinct), math.log1p(dense),
            min(1.0, 10 * len(at) / len(tokens))]


def quotation(text: str, tokens: list[str], places: list, i: int) -> float:
    """How far the window of a hit says that it is quoted: 0 to 1."""
    lo, hi = max(0, i - WINDOW), min(len(tokens) - 1, i + WINDOW)
    before = text[places[lo].start():places[i].start()]
    after = text[places[i].end():places[hi].end()]
    opened = any(before.count(o) > (before.count(c) if o != c else before.count(o) // 2 * 2)
                 for o, c in zip(OPENING, CLOSING))
    closed = any(c in after for c in CLOSING)
    reported = not REPORTING.isdisjoint(tokens[lo:i])
    return 0.6 * (opened and closed) + 0.4 * reported


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, text, toxic) of labelled documents outside the held-out fold, about ``rows`` of them by a hash of the id.

    The sampled labels are broadcast; their number is bounded by ``rows``, whatever the size of the table.
    """
    usable = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    usable = usable.groupBy(F.col("doc_id").cast("long").alias("__label")).agg(F.max("toxic").cast("int").alias("toxic"))
    n = usable.count()
    if n > rows:
        usable = usable.filter(F.pmod(F.xxhash64("__label"), F.lit(1 << 30)) < int((1 << 30) * rows / n))
    return docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(usable), F.col("doc_id") == F.col("__label")).drop("__label")


def learn_terms(sample: DataFrame) -> list[tuple[str, bool, float]]:
    """Terms of the lexicon from (text, toxic), most significant first; ``MOST_TERMS`` at most.

    Each task counts the words and word beginnings of its documents, Spark adds the counts up, and only strong terms
    come to the driver. A beginning replaces its longer forms if it covers clearly more toxic documents.
    """
    def run(frames):
        toxic, other, sizes = Counter(), Counter(), [0, 0]
        for df in frames:
            for text, label in zip(df["text"], df["toxic"]):
                words = {w for w in TOKEN.findall((text or "").lower()) if len(w) >= 3}
                terms = {w[:n] + "*" for w in words for n in STEMS if len(w) > n}
                terms.update(w for w in words if len(w) <= LONGEST_TERM)
                (toxic if label else other).update(terms)
                sizes[bool(label)] += 1
        keys = list(toxic)  # a term of no toxic document is never chosen
        yield pd.DataFrame({"term": [*keys, ""], "toxic": [*(toxic[k] for k in keys), sizes[1]],
                            "other": [*(0 for _ in keys), sizes[0]]})
        rest = list(other)
        for at in range(0, len(rest), 100_000):
            part = rest[at:at + 100_000]
            yield pd.DataFrame({"term": part, "toxic": 0, "other": [other[k] for k in part]})

    counts = sample.select("text", "toxic").mapInPandas(run, "term string, toxic long, other long")
    summed = counts.groupBy("term").agg(F.sum("toxic").alias("a"), F.sum("other").alias("b")).persist()
    size = summed.filter("term = ''").first()
    if not size or not size.a or not size.b:
        summed.unpersist()
        return []
    a, b, na, nb = F.col("a") + 0.5, F.col("b") + 0.5, size.a + 1.0, size.b + 1.0
    expected = (a + b) * (na / (na + nb))
    g2 = 2 * (a * F.log(a / expected) + b * F.log(b / ((a + b) * (nb / (na + nb)))))
    odds = (a / na) / (b / nb)
    strong = summed.filter((F.col("term") != "") & (F.col("a") > 0)).filter((g2 >= LEAST_G2) & (odds >= LEAST_ODDS))
    rows = strong.select("term", "a", F.log(odds).alias("w")).orderBy(g2.desc(), "term").limit(8 * MOST_TERMS).collect()
    summed.unpersist()
    return choose_terms([(r.term, r.a, r.w) for r in rows])


def choose_terms(strong: list[tuple[str, int, float]]) -> list[tuple[str, bool, float]]:
    """Drop the forms that a stem covers, and the stems that cover little more than their longest form."""
    best = Counter()  # most toxic documents of a longer form
    for term, n, _ in strong:
        plain = term.rstrip("*")
        for k in range(1, len(plain) + (1 if not term.endswith("*") else 0)):
            best[plain[:k]] = max(best[plain[:k]], n)
    stems = sorted({t.rstrip("*") for t, n, _ in strong if t.endswith("*") and n >= 1.3 * best[t.rstrip("*")]}, key=len)
    kept: set[str] = set()
    for s in stems:
        if not any(s[:k] in kept for k in range(1, len(s))):
            kept.add(s)
    out = [(t.rstrip("*"), t.endswith("*"), w) for t, n, w in strong
           if (t.endswith("*") and t.rstrip("*") in kept) or
           (not t.endswith("*") and not any(t[:k] in kept for k in range(1, len(t))))]
    return out[:MOST_TERMS]


def featured(docs: DataFrame, terms: list, keep: list[str]) -> DataFrame:
    """``keep`` columns and the features of each text."""
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema]
                       + [f"{n} double" for n in FEATURES])
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches):
        lexicon = Lexicon(shared.value)
        for batch in batches:
            got = np.array([features(t, lexicon) for t in batch.column("text").to_pylist()]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), *(pa.array(c) for c in got.T)],
                                             [*keep, *FEATURES])

    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, schema)


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> tuple[list, list[float]]:
    """Lexicon terms and logistic weights (intercept first) from the labelled sample.

    With labels of one kind only, or none, there are no terms and the score is the share of toxic labels.
    """
    sample = labelled_sample(docs, labels, rows)
    terms = learn_terms(sample)
    seen = np.array(featured(sample, terms, ["toxic"]).collect(), dtype=float).reshape(-1, len(FEATURES) + 1)
    y, x = seen[:, 0], np.c_[np.ones(len(seen)), seen[:, 1:]]
    rate = float(y.mean()) if len(y) else 0.0
    w = np.zeros(x.shape[1])
    w[0] = math.log((rate * len(y) + 0.5) / ((1 - rate) * len(y) + 0.5)) if len(y) else -1.0
    if terms:
        ridge = np.diag([1e-6] + [1.0] * len(FEATURES))
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge, x.T @ (y - p) - ridge @ w)
            w += step
            if np.abs(step).max() < 1e-8:
                break
    return terms, w.tolist()


def score(docs: DataFrame, model: tuple[list, list[float]]) -> DataFrame:
    """doc_id, held_out, score and predicted for every document; equal texts have equal scores.

    Only the text enters the score. Null and empty texts score as texts without hits. Repeated rows and null ids are
    rows like others (a null id is never held out).
    """
    terms, w = model
    base = docs.select(F.col("doc_id").cast("long"), "text")
    rows = featured(base, terms, ["doc_id"])
    z = sum((F.lit(v) * F.col(n) for n, v in zip(FEATURES, w[1:])), F.lit(w[0]))
    p = 1 / (1 + F.exp(-z))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), p.alias("score"),
                       F.when(p >= 0.5, 1).otherwise(0).alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """The documents that are predicted clean, with their own columns; nothing is shuffled."""
    terms, w = fit(docs, labels, rows)
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches):
        lexicon = Lexicon(shared.value)
        for batch in batches:
            z = [w[0] + float(np.dot(w[1:], features(t, lexicon))) for t in batch.column("text").to_pylist()]
            yield batch.filter(pa.array([v < 0 for v in z], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
