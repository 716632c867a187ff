"""Mixing, sharding, rules, neighbours, archives, licences, chats and the pipeline on small fixtures."""

import base64
import gzip
import hashlib
import os
import random
import re
import zlib

import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from ledgerlens.llm import chat, hnsw, license_scan, mixing, ordering, quality_rules, queries, sharding, warc
from ledgerlens.llm.text import word_count
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, src string"


def docs(spark, rows):
    """From (doc_id, text, source); two more columns have names that the operators use themselves."""
    return spark.createDataFrame([(i, t, "en", s, None, -1, "x") for i, t, s in rows], DOCS)


def corpus(seed=1, n=300):
    rng = random.Random(seed)
    rows = [(i, " ".join(rng.choice("ab cd ef gh ij".split()) for _ in range(rng.randint(0, 60))),
             rng.choice(["a"] * 6 + ["b", "c", None, "", "é", "z"])) for i in range(n)]
    return rows + [(n, None, "a"), (n + 1, "", None), (n + 2, "word " * 30_000, "b"), (None, "one two", "c"), (7, rows[7][1], rows[7][2])]


def words(t):
    return [w for w in re.split("[\x20\x09-\x0d]+", t or "") if w]


def test_prefix_sums_with_a_hot_group(spark):
    rng = random.Random(1)
    rows = [("hot" if i % 3 else f"g{i % 50}", rng.randint(0, 20), i, rng.randint(1, 9)) for i in range(2000)]
    df = spark.createDataFrame(rows, "g string, o long, i long, v long")
    got = {r.i: r.before for r in ordering.prefix_sums(df, ["o", "i"], ["g"], before=F.col("v")).collect()}
    want, seen = {}, {}
    for g, o, i, v in sorted(rows, key=lambda r: (r[1], r[2])):
        want[i] = seen.get(g, 0)
        seen[g] = want[i] + v
    assert got == want
    assert ordering.prefix_sums(df.filter("false"), ["o"], before=F.col("v")).count() == 0


@pytest.mark.parametrize("most", [0, 100])
def test_small_lookup_both_ways(spark, most):
    rows = spark.createDataFrame([("a", i) for i in range(300)] + [("b", 1), ("c", 2)], "k string, i long")
    table = spark.createDataFrame([("a", 5), ("b", 6), ("d", 7)], "k string, v long")
    got = sorted(map(tuple, ordering.small_lookup(rows, table, "k", most).collect()), key=repr)
    assert got == sorted([("a", i, 5) for i in range(300)] + [("b", 1, 6), ("c", 2, None)], key=repr)


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    left, free, target = 1.5 * sum(sizes.values()), set(names), {}
    while free:
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > 2 * sizes[s]]
        if not over:
            return target | {s: level * weight[s] for s in free}
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
            free.remove(s)
    return target


def test_mix_meets_its_targets(spark):
    rows = corpus()
    frame = docs(spark, rows)
    sized = frame.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    mix = mixing.queue(sized).collect()
    again = mixing.queue(sized.repartition(5)).collect()
    assert sorted((r.doc_id or -1, r.taken) for r in mix) == sorted((r.doc_id or -1, r.taken) for r in again)
    sizes, got, target, largest = {}, {}, {}, {}
    for r in mix:
        assert r.size == len(words(next(t for i, t, _ in rows if i == r.doc_id))) and r.taken in (0, r.size, 2 * r.size)
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        got[r.source] = got.get(r.source, 0) + r.taken
        target[r.source] = r.target
        largest[r.source] = max(largest.get(r.source, 0), r.size)
    assert all(r.source_size == sizes[r.source] for r in mix) and len(mix) == len(rows)
    assert target == pytest.approx(brute_targets(sizes))
    assert all(abs(got[s] - target[s]) <= 2 * largest[s] + 60 for s in sizes)
    copies = mixing.mixed(frame)
    assert copies.columns == frame.columns
    taken = {}
    for r in copies.collect():
        taken[(r.doc_id, r.source)] = taken.get((r.doc_id, r.source), 0) + len(words(r.text))
    for r in mix:
        if r.size and r.doc_id != 7:
            assert taken.get((r.doc_id, r.source), 0) == r.taken
    assert mixing.queue(sized.filter("false")).count() == 0 and mixing.mixed(frame.filter("false")).count() == 0


def test_mix_of_repeated_ids(spark):
    """Reruns agree whatever the order of the rows, also where ids repeat with other sizes and texts."""
    rng = random.Random(3)
    rows = [(rng.choice([None, 1, 2, 3]), "w " * rng.randrange(1, 9) + rng.choice("xyz"), rng.choice(["a", "b", None])) for _ in range(400)]
    seen = set()
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        frame = docs(spark, rows).repartition(seed + 1)
        sized = frame.select("doc_id", "source", word_count(F.col("text")).alias("size"))
        taken = sorted(((r.doc_id, r.source, r.size, r.taken) for r in mixing.queue(sized).collect()), key=repr)
        texts = sorted(((r.doc_id, r.source, r.text) for r in mixing.mixed(frame).collect()), key=repr)
        seen.add(repr((taken, texts)))
    assert len(seen) == 1


def test_lookup_with_a_map_column(spark):
    rows = spark.createDataFrame([(i % 3, {"a": i}) for i in range(40)], "k int, m map<string,int>")
    table = spark.createDataFrame([(0, "x"), (1, "y")], "k int, v string")
    for most in (0, 10):
        got = ordering.small_lookup(rows, table, "k", most).collect()
        assert sorted((r.m["a"], r.v) for r in got) == [(i, {0: "x", 1: "y"}.get(i % 3)) for i in range(40)]


def test_shards_are_contiguous_and_equal(spark):
    rows = corpus(2, 500)
    out = sharding.shard_documents(docs(spark, rows), 8).collect()
    assert len(out) == len(rows)
    total, most, byte = sum(r.size for r in out), max(r.size for r in out), {}
    text = {i: (t or "").encode() for i, t, _ in rows}
    for r in out:
        assert r.size == len(text[r.doc_id]) + 1 and r.text_crc32 == zlib.crc32(text[r.doc_id])
        byte[r.shard] = byte.get(r.shard, 0) + r.size
    assert all(abs(v - total / 8) <= most + 0.002 * total for v in byte.values())
    order = sorted(out, key=lambda r: (r.text_md5, r.doc_id is not None, r.doc_id or 0))
    assert [r.shard for r in order] == sorted(r.shard for r in order)
    for s in byte:
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))
    assert sharding.shard_documents(docs(spark, []), 8).count() == 0
    assert sorted((r.shard, r.slot) for r in sharding.shard_documents(docs(spark, [(1, "a", "s")] * 3), 8).collect())[0][1] == 0


def brute_rules(text):
    w, lines = words(text), [x for x in (text or "").split("\n") if words(x)]
    at = {}
    for i in range(len(w) - 7):
        at.setdefault(tuple(w[i:i + 8]), []).append(i)
    covered = {p for v in at.values() if len(v) > 1 for i in v for p in range(i, i + 8)}
    return (len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))


def test_rules_against_plain_python(spark):
    rng = random.Random(3)
    texts = [None, "", " \t\n\x0b\f\r", "é" * 50, "a " * 8, "a " * 9, "a b c d e f g h\n" * 4, "x#*$%&|<>", "\n\n", "a\xa0b", "k " * 20_000]
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 200))) for _ in range(60)]
    texts += ["\n".join(rng.choice(["one two", " ", "", "three #"]) for _ in range(12)) for _ in range(20)]
    rows = [(i, t, "h") for i, t in enumerate(texts)]
    for r in quality_rules.rule_counts(docs(spark, rows)).collect():
        want = brute_rules(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])


def test_a_bad_host_takes_its_documents_along(spark):
    good = " ".join(f"w{i}" for i in range(40))
    rows = [(i, good, "fine") for i in range(50)] + [(100 + i, "short", "bad") for i in range(45)]
    rows += [(200 + i, good, "bad") for i in range(5)] + [(300, "short", "fine"), (301, good, None), (302, "short", None), (303, good, "")]
    report = {r.doc_id: r for r in quality_rules.quality_report(docs(spark, rows)).collect()}
    assert not report[200].kept and not report[200].base_failed and report[301].kept and report[303].kept and not report[302].kept
    assert all(report[i].kept for i in range(50)) and not report[300].kept
    kept = quality_rules.keep_good(docs(spark, rows))
    assert kept.columns == docs(spark, rows[:1]).columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in report.items() if r.kept}
    assert quality_rules.quality_report(docs(spark, [])).count() == 0


def test_neighbours_with_copies_and_bad_vectors(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(900, 16)) * rng.uniform(0.5, 2, size=(900, 1))
    x[300:600] = x[300]  # a third are copies
    rows = [(int(i), [float(np.float32(v)) for v in vec]) for i, vec in enumerate(x)]
    bad = [(1000, None), (1020, []), (1040, [0.0] * 16), (1060, [None] + [1.0] * 15), (1080, [float("nan")] + [1.0] * 15),
           (None, [1.0] * 16), (1100, [float("inf")] * 16), (1120, [1.0, 2.0])]
    df = spark.createDataFrame(rows + bad + rows[:1], "vec_id long, embedding array<float>")
    got = {}
    for r in hnsw.nearest(df, k=20, every=20, shard_rows=250).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    exact, hits, total = np.float32(x).astype(float), 0, 0
    for q in range(0, 900, 20):
        s = exact @ exact[q]
        want = [i for i in np.lexsort((np.arange(900), -s)) if i != q][:20]
        found = sorted(got[q])
        assert [f[0] for f in found] == list(range(1, 21)) and all(f[1] != q for f in found)
        assert all(abs(f[2] - s[f[1]]) < 1e-9 for f in found)
        assert [(-f[2], f[1]) for f in found] == sorted((-f[2], f[1]) for f in found)
        hits += len({f[1] for f in found} & set(want))
        total += 20
    assert hits >= 0.97 * total and set(got) == set(range(0, 900, 20))
    assert hnsw.nearest(df.filter("false")).count() == 0


@pytest.mark.parametrize("case", ["unit", "outlier", "tiny", "huge", "spread"])
def test_neighbours_of_any_length(spark, case):
    """Recall against brute force in several full shards, for lengths that single precision could not hold together."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(4000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    if case == "outlier":
        x[17] *= 1e4
    elif case in ("tiny", "huge"):
        x *= 1e-25 if case == "tiny" else 1e25
    elif case == "spread":
        x *= 10.0 ** rng.integers(-8, 9, size=(4000, 1))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in hnsw.nearest(df, shard_rows=2000).collect():
        got.setdefault(r.query_id, {})[r.vec_id] = r.score
    hits = 0
    for q in range(0, 4000, 20):
        s = (x * x[q]).sum(axis=1)
        s[q] = -np.inf
        hits += len(got[q].keys() & set(np.argsort(-s, kind="stable")[:20].tolist()))
        assert len(got[q]) == 20 and all(v == pytest.approx(s[i], rel=1e-9) for i, v in got[q].items())
    assert hits >= 0.9 * 200 * 20


def test_bands_and_shards():
    size = np.array([0.1, 13.3, 0.0, -0.2, 11.0, -900.0])
    order, ends = hnsw.in_bands(size)
    assert [sorted(size[order[a:b]], reverse=True) for a, b in zip(ends, ends[1:])] == [[13.3], [11.0], [0.1, 0.0, -0.2], [-900.0]]
    assert hnsw.in_bands(size[:0])[1] == [0]
    x = np.array([[3e200, 4e200], [3e-320, 0.0], [0.0, -1.0]])
    assert hnsw.lengths(x)[[0, 2]] == pytest.approx([np.log2(5) + 200 * np.log2(10), 0])
    assert np.abs(hnsw.scaled(x, hnsw.lengths(x))).max(axis=1).min() >= 0.25
    assert [hnsw.shard_count(n, 64) for n in (1, 20_000, 20_001, 1_280_000, 12_800_000, 1 << 40)] == [1, 1, 2, 64, 64, -(-(1 << 40) // 204_800)]


def test_graph_recall_in_one_shard():
    x = np.random.default_rng(5).normal(size=(3000, 32))
    graph = hnsw.Graph.build(hnsw.level_norms(x))
    q = x[:200]
    found = graph.search(np.c_[q, np.zeros(200)].astype(np.float32), 20)
    want = np.argsort(-(q @ x.T), axis=1)[:, :20]
    assert np.mean([len(set(a) & set(b)) / 20 for a, b in zip(found, want)]) >= 0.95


def pages(spark, rows):
    return spark.createDataFrame([(i, f"http://h/{i}" if i != 3 else None, h, -1) for i, h in rows], "page_id long, url string, html string, payload int")


def test_archives_round_trip(spark, tmp_path):
    rows = [(1, "<p>é</p>"), (2, "same"), (3, "same"), (9, "same"), (4, None), (5, ""), (6, "WARC/1.0\r\n\r\nContent"), (None, "same"),
            (None, "lonely"), (None, "lonely"), (7, "y" * 300_000)]
    warc.write_archives(pages(spark, rows), str(tmp_path / "a"))
    read = warc.read_archives(spark, str(tmp_path / "a"), with_payload=True)
    assert read.filter("kind = 'gap'").count() == 0
    payload = {r.page_id: bytes(r.payload) for r in read.filter("record_type = 'response' and page_id is not null").collect()}
    assert payload[1] == "<p>é</p>".encode() and payload[7] == b"y" * 300_000
    got = sorted(map(tuple, warc.resolve(read).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=repr)
    want = []
    for i, h in rows:
        b = (h or "").encode()
        ids = [j for j, g in rows if (g or "").encode() == b and j is not None]
        revisit = bool(ids) and i != max(ids)
        want.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if revisit else "response", max(ids) if revisit else None))
    assert got == sorted(want, key=repr)
    roles = {r.page_id: r.revisit for r in warc.page_roles(pages(spark, [(1, "ab"), (2, "ab"), (3, "abcdef"), (4, "abcdef")]), 5).collect()}
    assert roles == {1: False, 2: False, 3: True, 4: False}


def test_archives_with_repeated_ids(spark, tmp_path):
    """Pages that share an id are records of their own; archives are cut by bytes, not by pages."""
    rows = [(5, "a"), (5, "bbbb"), (3, "a"), (5, "bbbb"), (1, "bbbb")] + [(100 + i, f"{i} " * 3000) for i in range(30)]
    warc.write_archives(pages(spark, rows).coalesce(1), str(tmp_path / "a"), archive_bytes=40_000)
    sizes = [f.stat().st_size for f in (tmp_path / "a").glob("*.txt")]
    assert len(sizes) > 5 and max(sizes) < 40_000 + 12_000
    read = warc.read_archives(spark, str(tmp_path / "a"))
    assert read.filter("kind = 'gap'").count() == 0
    got = sorted(tuple(r) for r in warc.resolve(read).select("page_id", "payload_bytes", "record_type", "refers_to").collect() if r.page_id < 100)
    assert got == [(1, 4, "revisit", 5), (3, 1, "revisit", 5), (5, 1, "response", None), (5, 4, "response", None), (5, 4, "response", None)]


def test_archives_with_long_urls(spark, tmp_path):
    """Pages with urls of any length come back, also as the response that others refer to; headers without an end do not."""
    long, wide = "data:text/html," + "u" * 100_000, "http://h/" + "é" * 30_000
    rows = [(1, "http://h/WARC/1.0", "same"), (2, "http://h/2", "same"), (3, long, "same"), (4, wide, "other")]
    frame = spark.createDataFrame([(*r, -1) for r in rows], "page_id long, url string, html string, payload int")
    warc.write_archives(frame, str(tmp_path / "a"))
    read = warc.read_archives(spark, str(tmp_path / "a"))
    assert read.filter("kind = 'gap'").count() == 0
    got = sorted(map(tuple, warc.resolve(read).select("page_id", "payload_bytes", "record_type", "refers_to").collect()))
    assert got == [(1, 4, "revisit", 3), (2, 4, "revisit", 3), (3, 4, "response", None), (4, 5, "response", None)]
    assert {r.page_id: r.target_uri for r in read.collect()}[3] == long
    cut = warc.record(5, long, b"x", None, False)[:70_000] + b"\r\n"
    out = list(warc.salvage(cut + warc.record(6, None, b"y", None, False) + warc.END))
    assert [(x[0], x[1]) for x in out] == [("gap", 0), ("record", len(cut))] and out[0][3] == "header has no end"


@pytest.mark.parametrize("packed", [False, True])
def test_salvage_recovers_what_follows_damage(packed):
    rng = random.Random(8)
    close = warc.member if packed else (lambda r: r + warc.END)
    whole = [close(warc.record(i, "http://h", bytes(rng.randrange(32, 127) for _ in range(300)), None, False)) for i in range(12)]
    data = bytearray(b"".join(whole))
    starts = np.cumsum([0] + [len(w) for w in whole])
    data[starts[3] + 60:starts[3] + 64] = b"\x00\x00\x00\x00"  # inside record 3
    broken = bytes(data[:starts[6] + 40]) + bytes(data[starts[7]:starts[11] + 100])  # 6 is cut, 11 has no end
    broken = b"junk" + broken
    out = list(warc.salvage(broken))
    ids = [int(h["x-page-id"]) for kind, _, _, h, _ in out if kind == "record"]
    assert ids == [0, 1, 2, 4, 5, 7, 8, 9, 10]
    gaps = [(s, n) for kind, s, n, _, _ in out if kind == "gap"]
    assert len(gaps) == 4 and gaps[0] == (0, 4)
    spans = sorted((s, s + n) for _, s, n, _, _ in out)
    assert spans[0][0] == 0 and spans[-1][1] == len(broken) and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))


def test_salvage_of_odd_archives():
    assert list(warc.salvage(b"")) == []
    assert [x[:3] for x in warc.salvage(b"nothing here")] == [("gap", 0, 12)]
    mixed = warc.record(1, None, b"", None, False) + warc.END + warc.member(warc.record(2, "u\r\nx: y", b"z", None, False))
    assert [x[3]["x-page-id"] for x in warc.salvage(mixed)] == ["1", "2"]
    assert [x[0] for x in warc.salvage(gzip.compress(b"no record"))] == ["gap"]


def test_page_ids_of_a_whole_long():
    for i in (9_200_000_000_000_000_000, (1 << 63) - 1, -1 << 63, 10 ** 17, 1 << 63):
        [(_, _, _, headers, block)] = warc.salvage(warc.record(i, None, b"x", None, False) + warc.END)
        assert warc.fields(headers, block, False)[3] == (i if i < 1 << 63 else None)


def test_damaged_archive_through_spark(spark, tmp_path):
    warc.write_archives(pages(spark, [(i, f"page {i} " * 20) for i in range(40)]).coalesce(1), str(tmp_path / "a"))
    file = next(p for p in os.scandir(tmp_path / "a") if p.name.startswith("part"))
    data = bytearray(open(file.path, "rb").read())
    at = data.index(b"page 20 page 20")
    data[at] = ord("P")
    os.mkdir(tmp_path / "b")
    (tmp_path / "b" / "x.warc").write_bytes(bytes(data))
    rows = warc.read_archives(spark, str(tmp_path / "b")).collect()
    assert sorted(r.page_id for r in rows if r.kind == "record") == [i for i in range(40) if i != 20]
    assert [r.reason for r in rows if r.kind == "gap"] == ["block digest differs"]


def test_licences(spark):
    from ledgerlens.llm.license_templates import APACHE_NOTICE, MIT_GRANT
    prose = "some words about nothing in particular\n" * 5
    changed = MIT_GRANT.replace("free of charge", "at no cost").replace("publish, ", "")
    rows = [(1, prose + "Licensed under CC BY-NC 4.0.\n" + prose), (2, prose + "Copyright 2020 Someone\n" + changed + "\n" + prose),
            (3, prose), (4, None), (5, ""), (6, "a licensed driver was given permission to leave and the warranty ended"),
            (7, APACHE_NOTICE + "\n\n\n\n\n" + "Released under the MIT License."), (8, "licence " * 20_000),
            (9, "Licensed under CC BY-SA 4.0."), (1, None)]
    out = {(r.doc_id, r.n_blocks > 0): r for r in license_scan.scan(docs(spark, [(i, t, "s") for i, t in rows])).collect()}
    assert out[(1, True)].licenses == "CC-BY-NC-4.0" and out[(1, True)].n_missing == 0 == out[(1, True)].n_changed
    assert out[(2, True)].licenses == "MIT" and out[(2, True)].n_missing + out[(2, True)].n_changed >= 2
    assert all(out[k].licenses is None for k in [(3, False), (4, False), (5, False), (6, True), (8, True), (1, False)])
    assert out[(7, True)].licenses == "Apache-2.0,MIT" and out[(9, True)].licenses == "CC-BY-SA-4.0"
    assert license_scan.scan(docs(spark, [])).count() == 0


def test_licences_inside_prose(spark):
    """Exact notices inside long lines, and several of them in neighbouring lines, are all found."""
    from ledgerlens.llm.license_templates import GPL_NOTICE, MIT_GRANT
    gpl = "This work is licensed under the GNU General Public License, version 2."
    prose = "some words about nothing in particular and a little more of them, " * 60
    rows = [(n, f"{prose[:n]} Licensed under CC BY-NC 4.0. {prose[:n]} {gpl} {prose[:n]}") for n in (100, 200, 400, 3000)]
    rows += [(1, "Licensed under CC BY 4.0.\nReleased under the MIT License.\n\nLicensed under CC BY-ND 4.0."),
             (2, prose + MIT_GRANT.replace("\n", " ") + prose + GPL_NOTICE.format(3).replace("\n", " ") + prose),
             (3, "To the extent possible under law, the author\nhas waived all copyright and related rights to this work.")]
    out = {r.doc_id: r for r in license_scan.scan(docs(spark, [(i, t, "s") for i, t in rows])).collect()}
    assert all(out[n].licenses == "CC-BY-NC-4.0,GPL-2.0" and out[n].n_changed == 0 for n in (100, 200, 400, 3000))
    assert out[1].licenses == "CC-BY-4.0,CC-BY-ND-4.0,MIT" and out[2].licenses == "GPL-3.0,MIT"
    assert out[3].licenses == "CC0-1.0" and (out[3].n_missing, out[3].n_changed, out[3].n_added) == (0, 0, 0)


def brute_licences(scanner, text):
    """Names found when every template is compared at every place, and matches rank by the bytes they save."""
    text_words, found = license_scan.WORD.findall(text.lower()), []
    for i, (_, template) in enumerate(scanner.templates):
        n = len(template)
        for shift in range(-n, len(text_words)):
            for lo, hi in ((max(0, shift), max(0, shift + n)), (max(0, shift - n), shift + 2 * n)):
                window = text_words[lo:hi]
                if len(set(template).difference(window)) > license_scan.MOST_DIFFERENT * n:
                    continue
                missing, changed, added, start, end = license_scan.wording(window, template)
                if missing + changed <= license_scan.MOST_DIFFERENT * n and added <= n:
                    span = (lo + start, lo + end)
                    found.append((-scanner.saved(text_words[span[0]:span[1]], [i])[0], span, i))
    out, taken = set(), set()
    for _, span, i in sorted(set(found)):
        if not taken & set(range(*span)):
            taken |= set(range(*span))
            out.add(scanner.templates[i][0])
    return out


def test_licences_against_brute_force():
    """The windows lose no template that a comparison at every place finds, with words changed, dropped and put in."""
    rng = random.Random(5)
    scanner = license_scan.Scanner()
    prose = "and so the river went on under old bridges while somebody counted boats for no reason at all".split()
    for _ in range(12):
        parts = []
        for _, template in rng.sample(scanner.templates, 3):
            edited = list(template)
            for _ in range(len(template) // 20):
                at = rng.randrange(1, len(edited) - 1)
                edited[at:at + 1] = rng.choice([[], ["changed"], [edited[at], "more"]])
            parts += rng.choices(prose, k=rng.randint(0, 40)) + edited
        text = " ".join(parts + rng.choices(prose, k=5))
        assert {f[0] for f in scanner.find(text)} == brute_licences(scanner, text)


def test_savings_choose_the_licence(monkeypatch):
    """The template that saves most bytes wins; with the savings of templates exchanged, others do."""
    scanner, text = license_scan.Scanner(), "Licensed under CC BY-NC 4.0."
    assert [f[0] for f in scanner.find(text)] == ["CC-BY-NC-4.0"]
    names = [name for name, _ in scanner.templates]
    plain, other = names.index("CC-BY-4.0"), names.index("CC-BY-NC-4.0")
    swap, real = {plain: other, other: plain}, license_scan.Scanner.saved
    monkeypatch.setattr(license_scan.Scanner, "saved", lambda self, words, among: real(self, words, [swap.get(i, i) for i in among]))
    assert [f[0] for f in scanner.find(text)] == ["CC-BY-4.0"]
    monkeypatch.setattr(license_scan.Scanner, "saved", lambda self, words, among: [0] * len(among))
    assert scanner.find(text) == []


def test_snapshots_collapse(spark):
    rng = random.Random(9)
    logs, base = {}, [[("user", f"q{g}{k}") if k % 2 == 0 else ("assistant", f"a{g}{k}") for k in range(6)] for g in range(5)]
    for c in range(120):
        b = rng.choice(base)
        logs[c] = b[:rng.randint(1, 6)] + ([("user", "other")] if rng.random() < 0.2 else [])
    logs[500], logs[501], logs[502] = [(None, None)], [("", "")], [(None, "x" * 100_000)]
    rows = [(c, k, *t, 0) for c, ts in logs.items() for k, t in enumerate(ts)]
    rows += rows[:5] + [(None, 0, "user", "stray", 0)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, place int")
    got = {r.conv_id: (r.n_turns, r.copies, r.chat) for r in chat.collapse_and_render(df).collect()}
    want, all_logs = {}, {**{c: tuple(t) for c, t in logs.items()}, None: (("user", "stray"),)}
    for c, ts in all_logs.items():
        same = [d for d, x in all_logs.items() if x == ts]
        if any(len(x) > len(ts) and x[:len(ts)] == ts for x in all_logs.values()) or (c is not None and c != min(same)):
            continue
        want[c] = (len(ts), len(same), "".join(f"<|im_start|>{r or ''}\n{t or ''}<|im_end|>\n" for r, t in ts))
    assert got == want
    assert chat.collapse_and_render(df.filter("false")).count() == 0


def test_queries_are_registered():
    names = entry.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
    assert set(queries.SQL) <= set(queries.QUERIES)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="test tables are not here")
def test_pipeline_stages_keep_the_columns(spark):
    source = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    frame, seen = source, []
    for name, apply in corpus_pipeline.STAGES:
        out = apply(spark, frame, "/root/testdata/sf0.001")
        path = ordering.stage(out, "test")
        seen.append((name, path.count()))
        if name != "tokens":
            assert path.columns == source.columns
        frame = path
    assert seen[0][1] < source.count() and seen[1][1] <= seen[0][1] and seen[4][1] == seen[3][1]
    assert sorted(map(tuple, corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect())) == sorted(map(tuple, frame.collect()))
