"""Personal data, divergence audit and cell clustering against brute force."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import divergence, personal_data, vector_cells

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kind string, row long, start long, p string"


def table(spark, rows):
    """Documents with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, lang, src, 1, "k", 7, 8, "q") for i, t, lang, src in rows], DOCS)


# ---- personal data

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text):
    """The rules as they are stated, with the plain patterns."""
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and max(map(int, m.group().split("."))) > 255:
                continue
            if kind == "card" and not (12 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), list(PATTERNS).index(kind), m.end(), kind))
    return sorted(out)


TEXTS = [
    None, "", " ", "no data", "a@b.c", "x a.b-c%d+e@host-1.example.com.", "a@b.c_d@e.f@g.h", "@x.y a@ b@c d@e..f", "ä.b@c.de é@f.gh",
    "1.2.3.4 256.1.1.1 1.2.3 1.2.3.4.5.6.7.8.9 0001.02.3.4 999999999999999999999.1.1.1", "v1.2.3.4", "1.2.3.4@5.6.7.8",
    "4111 1111 1111 1111, 4111-1111-1111-1112 411111111111111111111111 4111  1111 1111 1111", "12 3-4 5", "0" * 30, "7" * 12,
    "+1 (743) 555-3824. +49 30 1234567 +1 2 ++12345678901 +(1) 234 +1.234.567.8901.234.56 +1)))))", "😀 +1 743 555 3824 😀a@b.co",
    "tel +33 1 22 33 44 55 mail x@y.fr card 4111111111111111 ip 10.0.0.1", "-".join("123456789"), "+4111111111111111",
]


def test_base_spans_follow_the_stated_patterns(spark):
    rng = random.Random(5)
    alphabet = ["a", "Z", "1", "2", "9", "255", ".", "@", "-", " ", "+", "(", ")", "_", "%", "é", "😀", "\n", "4111111111111111"]
    texts = TEXTS + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(400)]
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)] + [(3, texts[4], "en", "s"), (None, texts[5], None, None)]
    got = personal_data.report(table(spark, rows)).collect()
    assert len(got) == len(rows)
    want = {}
    for i, t, _, _ in rows:
        spans = base_spans(t)
        names = ",".join(f"{k}:{s}:{e}" for s, _, e, k in spans)
        digest = hashlib.sha256(names.encode()).hexdigest()
        want.setdefault(i, []).append((*(sum(x[3] == k for x in spans) for k in PATTERNS), digest, [n for n in names.split(",") if n]))
    for r in got:
        mine = (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256)
        same = [w for w in want[r.doc_id] if w[:5] == mine]
        assert same, (r, want[r.doc_id])
        assert set(same[0][5]) <= set(r.spans.split(",")), r
        assert r.n_added == len([x for x in r.spans.split(",") if x]) - len(same[0][5])


def test_long_runs_take_linear_time(spark):
    long = ["a" * 300_000, "1" * 300_000, "1 " * 150_000, "1." * 150_000, "+" + "1 (" * 100_000, "a@" + "b." * 150_000, "a@b.c " * 30_000,
            "(at) " * 60_000, "1:" * 100_000]
    got = personal_data.report(table(spark, [(i, t, "en", "s") for i, t in enumerate(long)]))
    rows = {r.doc_id: r for r in got.select("doc_id", "n_email", "n_ip", "base_sha256").collect()}
    for i in (2, 6, 7, 8):
        names = ",".join(f"{k}:{s}:{e}" for s, _, e, k in base_spans(long[i]))
        assert rows[i].base_sha256 == hashlib.sha256(names.encode()).hexdigest(), i
    for i in (0, 1, 4):
        assert rows[i].base_sha256 == hashlib.sha256(b"").hexdigest(), i
    assert rows[3].n_ip == 37_500 and rows[5].n_email == 1
    assert rows[6].n_email == 30_000


def test_wider_spans_are_added_and_clean_texts_left_alone(spark):
    rng = random.Random(3)

    def number(n):
        return "".join(rng.choice("0123456789") for _ in range(n))

    rows, planted = [], []
    for i in range(300):
        rows.append((i, f"write to mail user{i}@host{i % 9}.example.com or call phone +1 (555) 555-{number(4)} now", "en", "s"))
    for i in range(300, 600):
        rows.append((i, f"order {number(8)} of 20{number(2)}-05-12, serial {number(16)}/x version {i % 7}.{i}.0.300 figure {number(4)}-{number(3)}", "en", "s"))
    for i in range(600, 660):
        rows.append((i, f"please mail user{i} [at] host{i % 9}.example [dot] com today", "en", "s"))
        planted.append(i)
    got = {r.doc_id: r for r in personal_data.report(table(spark, rows)).collect()}
    found = [i for i in planted if f"email:12:" in got[i].spans]
    assert len(found) >= 0.9 * len(planted)
    assert sum(got[i].n_added for i in range(300, 600)) <= 30


def test_reliabilities_equal_a_plain_estimate(spark):
    rng = random.Random(9)
    rows = []
    for kind in range(3):
        for _ in range(40):
            rows.append((kind, *(rng.choice([-1, 0, 1]) for _ in range(5)), rng.randrange(1, 200)))
    names = list(personal_data.LABELERS)
    patterns = spark.createDataFrame(rows, "kind int, " + ", ".join(f"{n} int" for n in names) + ", n long")
    priors, evidence = personal_data.reliabilities(patterns, rounds=6)
    for kind in range(3):
        mine = [r for r in rows if r[0] == kind]
        prior, odds = 0.0, {(a, v): float(v) for a in range(5) for v in (-1, 0, 1)}
        for _ in range(6):
            p = [1 / (1 + math.exp(-(prior + sum(odds[a, r[1 + a]] for a in range(5))))) for r in mine]
            t, f = sum(x * r[6] for x, r in zip(p, mine)), sum((1 - x) * r[6] for x, r in zip(p, mine))
            for a in range(5):
                for v in (-1, 0, 1):
                    yes = sum(x * r[6] for x, r in zip(p, mine) if r[1 + a] == v)
                    no = sum((1 - x) * r[6] for x, r in zip(p, mine) if r[1 + a] == v)
                    odds[a, v] = math.log((yes + 1 + v / 2) / (t + 3) / ((no + 1 - v / 2) / (f + 3)))
            prior = math.log((t + 1) / (f + 1))
        assert priors[kind] == pytest.approx(prior, abs=1e-6)
        for a in range(5):
            for v in (-1, 0, 1):
                assert evidence[kind * 15 + 3 * a + v + 1] == pytest.approx(odds[a, v], abs=1e-6)


def test_personal_data_of_nothing(spark):
    assert personal_data.report(table(spark, [(1, "a@b.c", "en", "s")]).limit(0)).count() == 0
    one = personal_data.report(table(spark, [(1, None, None, None)])).collect()
    assert [(r.doc_id, r.n_email, r.spans, r.base_sha256) for r in one] == [(1, 0, "", hashlib.sha256(b"").hexdigest())]


# ---- divergence audit

def brute_audit(rows, k, least):
    terms = [(lang or "", src or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(
        c.lower() if c.isascii() else c for c in text or ""))) for _, text, lang, src in rows]
    out = []
    for lang in {t[0] for t in terms}:
        mine = [t for t in terms if t[0] == lang]
        words = {w for t in mine for w in t[2]}
        kept = sorted(w for w in words if sum(w in t[2] for t in mine) >= least)
        sources = sorted({t[1] for t in mine})
        count = {s: {w: sum(t[2].count(w) for t in mine if t[1] == s) for w in kept} for s in sources}
        whole = {w: sum(count[s][w] for s in sources) for w in kept}

        def shares(c):
            n = sum(c.values())
            return {w: 1 + 10**9 * (c[w] + 2) // (n + 2 * len(kept)) for w in kept}

        def f(p, q):
            return (p - q) ** 2 // (p + q)

        q = shares(whole)
        p = {s: shares(count[s]) for s in sources}
        for s in sources:
            pairs = [(-sum(f(p[s][w], p[o][w]) for w in kept), o) for o in sources if o != s]
            some = [(-f(p[s][w], q[w]), w) for w in kept if count[s][w] and p[s][w] > q[w]]
            for part, items, most in (("pair", pairs, len(pairs)), ("term", some, k)):
                items.sort(key=lambda x: (x[0], x[1].encode()))
                out += [(lang, s, part, item, -v, r + 1) for r, (v, item) in enumerate(items[:most])]
    return sorted(out)


def test_audit_equals_brute_force(spark):
    rng = random.Random(2)
    vocabulary = ["The", "the", "É", "é", "straße", "a1b", "x_y", "don't", "😀", "中文", "zz", "Zz"] + [f"w{chr(97 + i)}" for i in range(20)]
    rows = []
    for i in range(160):
        words = [vocabulary[min(int(rng.expovariate(0.12)), len(vocabulary) - 1)] for _ in range(rng.randrange(0, 25))]
        rows.append((i % 90, " ".join(words), rng.choice(["en", "de", "de", None, ""]), rng.choice(["s1", "s1", "s1", "s2", "ß", None])))
    rows += [(None, None, "xx", "only"), (5, "", "yy", "a"), (6, "12 34", "yy", "b")] + [(1, "same text", "en", "s1")] * 12
    for k, least in ((3, 2), (10, 10)):
        got = divergence.audit(table(spark, rows), k, least).collect()
        assert sorted(tuple(r) for r in got) == brute_audit(rows, k, least)


def test_audit_is_the_same_in_small_parts(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["aa", "bb", "cc", "dd", "ee", "ff"]) for _ in range(30)), "en", f"s{i % 7}") for i in range(60)]
    monkeypatch.setattr(divergence, "SOURCE_BLOCK", 3)
    monkeypatch.setattr(divergence, "CELLS", 8)
    monkeypatch.setattr(divergence, "MOST_COUNTED", 5)
    monkeypatch.setattr(divergence, "LONG_TEXT", 10)
    got = divergence.audit(table(spark, rows).repartition(3), 2, 2).collect()
    assert sorted(tuple(r) for r in got) == brute_audit(rows, 2, 2)


def test_skyband_equals_brute_force():
    rng = np.random.default_rng(1)
    for k in (1, 3):
        n, lang_n = rng.integers(0, 9, 150), rng.integers(0, 9, 150)
        term = np.array([f"t{i:03}" for i in rng.permutation(150)], dtype=object)
        above = [sum((n[j] >= n[i]) and (lang_n[j] <= lang_n[i]) and term[j] < term[i] for j in range(150)) for i in range(150)]
        assert sorted(divergence.skyband(n, lang_n, term, k)) == [i for i in range(150) if above[i] < k]


def test_audit_of_nothing(spark):
    assert divergence.audit(table(spark, [(1, "x", "en", "s")]).limit(0)).count() == 0
    assert divergence.audit(table(spark, [(1, None, None, None)])).count() == 0


# ---- cell clustering

def brute_clusters(rows, k, rounds, dims):
    kept = [(i, [math.floor(1024 * x) if abs(x) < 1e15 else int(x) * 1024 for x in v]) for i, v in rows
            if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    name = [(hashlib.sha256(f"3:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept]
    centroids = [list(v) for _, v in sorted(name)[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), at) for at, c in enumerate(centroids))

    for _ in range(rounds):
        at = [nearest(v)[1] for _, v in kept]
        for c in range(len(centroids)):
            mine = [v for (_, v), a in zip(kept, at) if a == c]
            if mine:
                centroids[c] = [sum(x) // len(mine) for x in zip(*mine)]
    found = [(i, *nearest(v)) for i, v in kept]

    def long(x):
        return x if x < 1 << 63 else None

    def inertia(values):
        return long(sum(values)) if all(v < 1 << 63 for v in values) else None

    total = inertia([d for _, d, _ in found])
    return sorted(((i, c, long(d), inertia([e for _, e, b in found if b == c]), total,
                    hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for i, d, c in found), key=repr)


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", 5) for i, v in rows], "vec_id long, embedding array<double>, cluster int, cells string, d long")


def test_clusters_equal_brute_force(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(5, 8))
    rows = [(i, [float(x) for x in centres[i % 5] + 0.4 * rng.normal(size=8)]) for i in range(400)]
    rows += [(400 + i, rows[7][1]) for i in range(60)] + [(7, rows[7][1]), (None, rows[3][1])]
    rows += [(900, None), (901, [1.0] * 7), (902, [None] + [0.0] * 7), (903, [float("nan")] * 8), (904, [float("inf")] + [0.0] * 7), (905, [])]
    rows += [(950, [0.0] * 8), (951, [-0.0] * 8), (952, [0.5] * 8), (953, [1e-300] * 8)]
    for k in (1, 8):
        got = vector_cells.cluster(vectors(spark, rows), k=k, rounds=4, dims=8).collect()
        assert sorted((tuple(r) for r in got), key=repr) == brute_clusters(rows, k, 4, 8)


def test_vectors_of_any_size(spark):
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.normal(size=4) * 10.0 ** (i % 9)]) for i in range(90)]
    rows += [(100, [1e30, 0.0, -1e30, 1.0]), (101, [1e30, 5.0, -1e30, 1.0]), (102, [1e300, 0.0, 0.0, 0.0]), (103, [131072.0] * 4)]
    got = vector_cells.cluster(vectors(spark, rows), k=8, rounds=5, dims=4).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute_clusters(rows, 8, 5, 4)


def test_few_vectors_are_fetched():
    rng = np.random.default_rng(0)
    low, high, dims = -20_000, 20_000, 16
    edges = np.tile(np.linspace(low, high, 65).astype(np.int64), (dims, 1))
    centres = rng.integers(low // 2, high // 2, (8, dims))
    ints = np.clip(centres[rng.integers(0, 8, 400)] + rng.normal(scale=900, size=(400, dims)).astype(np.int64), low, high - 1)
    cells = np.stack([np.searchsorted(edges[d, 1:-1], ints[:, d], side="right") for d in range(dims)], axis=1)

    class Held:
        wide, size = False, 400

        def cells(self, dims):
            return cells

        def vectors(self):
            return ints

    nearest = vector_cells.Assigner(centres.tolist(), edges)
    want = ((ints[:, None, :] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
    assert (nearest.assign(Held()) == want).all()
    assert nearest.fetched < 40


def test_clusters_of_nothing(spark):
    none = vector_cells.cluster(vectors(spark, [(1, [1.0])]), dims=8)
    assert none.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"] and none.count() == 0
    assert vector_cells.cluster(vectors(spark, [(1, [1.0] * 8)]).limit(0), dims=8).count() == 0
    few = vector_cells.cluster(vectors(spark, [(1, [1.0] * 8), (2, [2.0] * 8)]), dims=8).collect()
    assert sorted((r.vec_id, r.distance) for r in few) == [(1, 0), (2, 0)] and {r.inertia for r in few} == {0}
