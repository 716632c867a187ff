"""Jaccard join, piece table and toxicity against brute force."""

import hashlib
import itertools
import random

import numpy as np
import pytest

from ledgerlens.llm import components, jaccard_join, sentencepieces, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n long, class string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, "x") for i, t in rows], DOCS)


def brute_components(texts):
    """Smallest linked doc_id per row, from all pairs of exact shingle sets."""
    up = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, t in texts:
        w = [x for x in __import__("re").split("[\x20\x09-\x0d]+", (t or "").translate(up)) if x]
        sets.append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        a, b = sets[i], sets[j]
        if a and b and texts[i][0] is not None and texts[j][0] is not None and 100 * len(a & b) >= 80 * len(a | b):
            parent[root(i)] = root(j)
    least = {}
    for k, (i, _) in enumerate(texts):
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    return [(texts[k][0], len(sets[k]), least.get(root(k)) if sets[k] else texts[k][0]) for k in range(len(texts))]


def near_copies(seed, groups=12, size=14):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = []
    for g in range(groups):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 5, 8, 9, 12, 13, 30, 90]))]
        for _ in range(size):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 2])):
                at = rng.randrange(len(words))
                words[at:at + 1] = rng.choice([[], [rng.choice(vocabulary)], [words[at], rng.choice(vocabulary)]])
            texts.append(" ".join(words).upper() if rng.random() < 0.1 else " \n".join(words))
    rng.shuffle(texts)
    return list(enumerate(texts))


EDGE = [(900, None), (901, ""), (902, " \t\n"), (903, "one two"), (904, "ONE two"), (905, "one\x0btwo"), (906, "one two three four five"),
        (None, "one two"), (None, None), (907, "a\xa0b c d e f"), (908, "É é É é É é"), (907, "a\xa0b c d e f"), (909, "x " * 30_000)]


@pytest.mark.parametrize("seed", [1, 2])
def test_join_against_all_pairs(spark, seed):
    rows = near_copies(seed) + EDGE
    got = jaccard_join.link_documents(table(spark, rows)).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(brute_components(rows), key=repr)


def test_join_with_cut_lists_and_small_blocks(spark, monkeypatch):
    """Lists cut into parts and groups cut into blocks give the same components."""
    monkeypatch.setattr(jaccard_join, "LIST_BLOCK", 2)
    monkeypatch.setattr(jaccard_join, "BLOCK_ROWS", 4)
    monkeypatch.setattr(jaccard_join, "BLOCK_SHINGLES", 100)
    rows = near_copies(3, groups=6, size=20)
    got = jaccard_join.link_documents(table(spark, rows)).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got)) == sorted(brute_components(rows))


def long_copies(seed, groups, size, words=300):
    """Groups of long near copies, some just similar and some not; each group shares nine words with the next."""
    rng = random.Random(seed)
    texts = []
    for g in range(groups):
        base = [f"g{g}w{i}" for i in range(words)]
        base[20:29], base[60:69] = [f"p{g}w{i}" for i in range(9)], [f"p{g + 1}w{i}" for i in range(9)]
        for c in range(size):
            out, most = list(base), rng.choice([1, 4, 6, 7])
            for at in rng.sample(range(words), most):
                out[at] = f"c{g}x{c}x{at}"
            texts.append(" ".join(out))
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_long_sets_with_few_common_shingles_are_no_candidates(spark):
    rows = long_copies(6, groups=40, size=1)
    sketch = np.zeros(jaccard_join.LEAST_CELLS, np.int32)
    assert jaccard_join.candidate_links(table(spark, rows), sketch, 0, 80).count() == 0


@pytest.mark.parametrize("groups, size", [(12, 5), (2, 60)])
def test_join_of_long_sets_against_all_pairs(spark, groups, size):
    """Lists with few entries count hits, lists with many link neighbours."""
    rows = long_copies(7, groups, size) + near_copies(8, groups=2, size=40)[:0 if size < 40 else None]
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    got = jaccard_join.link_documents(table(spark, rows)).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got)) == sorted(brute_components(rows))


def test_least_hits_reach_every_similar_pair():
    """Whatever the order of the shingles, prefixes of similar sets share the hits asked for."""
    rng = random.Random(9)
    for _ in range(300):
        n = rng.choice([5, 49, 50, 99, 130, 260])
        m = rng.randint(-(-80 * n // 100), n)
        common = rng.randint(jaccard_join.least_overlap(n, m), m) if jaccard_join.least_overlap(n, m) <= m else 0
        if not common:
            continue
        a, b = set(range(n)), set(range(n - common, n - common + m))
        order = [*rng.sample(sorted(a - b), n - common), *rng.sample(sorted(b - a), m - common), *rng.sample(sorted(a & b), common)]
        heads = [set([x for x in order if x in s][:jaccard_join.prefix_length(len(s)) + jaccard_join.least_hits(len(s)) - 1]) for s in (a, b)]
        assert len(heads[0] & heads[1]) >= min(jaccard_join.least_hits(n), jaccard_join.least_hits(m))


def test_prefix_and_subset_sizes_reach_every_similar_pair():
    for a in range(1, 40):
        for b in range(a, 40):
            for o in range(a + 1):
                linked = 100 * o >= 80 * (a + b - o)
                assert linked == (o >= jaccard_join.least_overlap(a, b))
                if linked:
                    assert jaccard_join.fits(a, b)
                    assert a - o < jaccard_join.prefix_length(a) and b - o < jaccard_join.prefix_length(b)


def test_boundary_follows_the_cost():
    assert jaccard_join.light_boundary({}) == 0
    assert 4 <= jaccard_join.light_boundary({n: 100 for n in range(1, 30)}) <= 12
    assert jaccard_join.light_boundary({n: 100 for n in range(1, 30)}, scan_cost=0) == 0


def test_keep_first_keeps_one_of_each_group(spark):
    rows = near_copies(4, groups=5, size=8) + EDGE
    kept = jaccard_join.keep_first(table(spark, rows))
    assert kept.columns == table(spark, rows[:1]).columns
    got = sorted((r.doc_id for r in kept.collect()), key=repr)
    want = sorted({i for i, _, c in brute_components(rows) if i is not None and i == c} | set()) + [None, None]
    assert got == sorted(want, key=repr)


def test_components_of_long_paths_and_stars(spark):
    path = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5, 5), (7000, 6999)]
    got = {r.node: r.label for r in components.components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(201)}, **{1000 + i: 1000 for i in range(300)}, 7000: 6999, 6999: 6999}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_empty_table(spark):
    assert jaccard_join.link_documents(table(spark, [])).count() == 0
    assert sentencepieces.encode(table(spark, [])).count() == 0


def test_pieces_equal_the_library_on_whole_texts(spark):
    rng = random.Random(5)
    parts = ["a", "b", " ", "  ", "\n", "▁", "é", "the", "😀", "\t", ".", "<s>", "\x00", "日本"]
    texts = [None, "", " ", "   ", "▁▁", "x" * 5000, "word " * 20_000] + [
        "".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(400)]
    sp = sentencepieces.processor(sentencepieces.MODEL)
    coded = sentencepieces.encode(table(spark, list(enumerate(texts)) + [(0, None)]), with_ids=True)
    rows = coded.collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        ids = sp.encode(texts[r.doc_id] or "")
        assert r.ids == ids and r.n_tokens == len(ids) and r.decoded == sp.decode(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(sp.decode(ids).encode()).hexdigest()
    back = {r.doc_id: r.text for r in sentencepieces.decode(coded).collect()}
    assert all(back[i] == sp.decode(sp.encode(t or "")) for i, t in enumerate(texts))


def test_a_full_piece_table_starts_anew(monkeypatch):
    monkeypatch.setattr(sentencepieces, "MOST_KEPT", 5)
    sp = sentencepieces.processor(sentencepieces.MODEL)
    chunks = sentencepieces.ChunkTable(sp)
    for text in ["one two three four", "five six", "one  two seven", "x" * 200 + " one"]:
        assert chunks.join([text])[0][1] == ",".join(map(str, sp.encode(text)))


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_against_plain_edit_distance():
    rng = random.Random(6)
    terms = [("idiot", False, 3.0), ("moron", False, 2.0), ("scum", False, 1.0), ("vequet", True, 2.5), ("bad", True, 1.5)]
    lexicon = toxicity.Lexicon(terms)
    words = ["idiot", "idoit", "idiott", "diot", "xidiot", "moran", "scums", "vequetaire", "vaquetaire", "badly", "", "vequ"]
    words += ["".join(rng.choice("idotmrnvequ") for _ in range(rng.randint(1, 8))) for _ in range(3000)]
    for w in words:
        best = None
        for text, stem, weight in terms:
            least = min(edits(text, w[:j]) for j in range(len(w) + 1)) if stem else edits(text, w)
            if least <= toxicity.allowed(text, stem):
                best = max(best or (False,), (least == 0, weight, len(text), text))
        got = lexicon.match(w) if w else None
        if w:
            assert got == ((best[1], best[0], best[3]) if best else None), w


def test_quotation_lowers_the_abuse_score():
    lexicon = toxicity.Lexicon([("idiot", False, 3.0)])
    plain = toxicity.features("you are an idiot and you know it", lexicon)
    told = toxicity.features("the report said he had called them an \"idiot\" in a letter", lexicon)
    assert plain[0] > told[0] and told[2] > plain[2] == 0
    assert toxicity.features(None, lexicon) == toxicity.features("", lexicon) == [0.0] * 6


def test_rare_terms_of_toxic_documents_are_learned(spark):
    """A term of 1 % of the toxic documents and of no other is learned, however many toxic documents there are."""
    rows = [("plain words " + ("zwumpf " if i < 1188 else "quorbit ") + f"n{i}", 1) for i in range(1200)]
    rows += [(f"plain words m{i}", 0) for i in range(4800)]
    terms = toxicity.learn_terms(spark.createDataFrame(rows, "text string, toxic int"))
    assert [t for t, _, _ in terms if t in ("zwumpf", "quorbit")] == ["zwumpf", "quorbit"]
    assert not any(t in ("plain", "words") for t, _, _ in terms)


def test_prefilter_lets_every_near_word_pass():
    rng = random.Random(12)
    terms = [("".join(rng.choice("abc") for _ in range(n)), stem, 1.0) for n in range(3, 12) for stem in (False, True)]
    lexicon = toxicity.Lexicon(terms)
    for _ in range(20_000):
        text, _, _ = rng.choice(terms)
        k = rng.randrange(len(text) + 1)
        word = text[:k] + rng.choice(["", "a", "b", "x"]) + text[k + rng.choice([0, 1]):] + rng.choice(["", "a", "xyz"])
        assert lexicon.may(word) or lexicon.search(word) is None


def test_toxicity_learns_from_the_training_fold_only(spark):
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    rows, labels = [], []
    for i in range(600):
        toxic = i % 5 == 0
        text = [rng.choice(words) for _ in range(40)] + (["zwumpf", "krazzel"] * 2 if toxic else [])
        rng.shuffle(text)
        rows.append((i, " ".join(text)))
        labels.append((i, 1, int(toxic)))
    rows += [(1000, None), (1001, ""), (None, "zwumpf krazzel zwumpf krazzel " + words[0])]
    labels += [(1000, None, None), (None, 1, 1)]
    docs, marks = table(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, marks)
    out = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert len(out) == 603 and all(0 <= r.score <= 1 for r in out.values())
    assert sum(out[i].predicted == int(i % 5 == 0) for i in range(600)) >= 595
    assert out[1000].predicted == out[1001].predicted == 0 and out[None].predicted == 1 and not out[None].held_out
    import zlib
    assert all(out[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in range(600))
    flipped = spark.createDataFrame([(i, q, (1 - t) if i is not None and t is not None and zlib.crc32(str(i).encode()) % 5 == 0 else t)
                                     for i, q, t in labels], marks.schema)
    assert np.allclose([v for v in toxicity.fit(docs, flipped)[1]], model[1])
    kept = toxicity.keep_clean(docs, marks)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted == 0 for r in out.values())
    none = toxicity.fit(docs, marks.filter("false"))
    assert none[0] == [] and toxicity.score(docs, none).filter("predicted = 1").count() == 0
