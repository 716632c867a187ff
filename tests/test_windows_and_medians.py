"""Sliding windows, medians without unpivoting, hot keys of any type, fitted tail models, learning curves, wide categories."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import detectors, drift, evaluation, skew, sliding, wide
from ledgerlens.storage import stage


@pytest.mark.parametrize("window", [1, 2, 7, 30])
def test_window_medians_equal_numpy(spark, window):
    rng = random.Random(window)
    for values in ([rng.choice([0.0, 0.0, 0.0, 1.5, 2.0, rng.random()]) for _ in range(200)], [rng.gauss(0, 1) for _ in range(90)], [3.0] * 40):
        rows = stage(spark.createDataFrame(list(enumerate(values)), "i long, v double"), "values")
        got = {r.i: r.median for r in sliding.window_medians(rows, window).collect()}
        assert got == {i: pytest.approx(float(np.median(values[i - window:i]))) for i in range(window, len(values))}


def test_no_windows_in_a_short_table(spark):
    rows = stage(spark.createDataFrame([(0, 1.0), (1, 2.0)], "i long, v double"), "values")
    assert sliding.window_medians(rows, 5).count() == 0
    assert sliding.window_medians(rows.limit(0), 2).count() == 0


def test_column_medians_equal_numpy(spark):
    rng = random.Random(7)
    rows = []
    for key, n in (("hot", 1500), ("mid", 200), ("two", 2), ("one", 1), (None, 300)):
        for _ in range(n):
            rows.append((key, rng.gauss(0, 5), float(rng.randrange(7)), None if rng.random() < 0.3 else rng.expovariate(1),
                         rng.choice([0.0, 0.0, 1.0]), None if key == "one" else 2.5))
    cols = ["a", "b", "c", "d", "e"]
    df = stage(spark.createDataFrame(rows, "k string, " + ", ".join(f"{c} double" for c in cols)), "rows")

    def want(part):
        out = []
        for j in range(1, 6):
            v = [r[j] for r in part if r[j] is not None]
            out.append(pytest.approx(float(np.median(v))) if v else None)
        return out

    got = {r.k: [r[c] for c in cols] for r in skew.column_medians(df, ["k"], cols).collect()}
    assert got == {k: want([r for r in rows if r[0] == k]) for k in ("hot", "mid", "two", "one", None)}
    assert [list(r) for r in skew.column_medians(df, [], cols).collect()] == [want(rows)]
    # A sketch that misses its bracket is caught and the step repeated.
    rough = {r.k: [r[c] for c in cols] for r in skew.column_medians(df, ["k"], cols, accuracy=7).collect()}
    assert rough == got


def test_a_missed_bracket_is_opened(spark, monkeypatch):
    values = [float(i) for i in range(101)]
    df = stage(spark.createDataFrame([("k", v) for v in values], "k string, v double"), "rows")
    real = F.percentile_approx
    monkeypatch.setattr(skew.F, "percentile_approx", lambda c, p, a: real(c, [0.9, 0.95], a) if len(p) == 2 else real(c, p, a))
    assert skew.column_medians(df, ["k"], ["v"]).first().v == 50.0


def test_stored_percentiles_order_few_values(spark, monkeypatch):
    """Exact ranks of stored rows, extreme and weighted values too, without ordering all of the values."""
    rng = random.Random(3)
    odd = [float("-inf"), -1e300, -5e-324, -0.0, 0.0, 5e-324, 1e-12, 1.0, 1.0, 1e300, float("inf")]
    rows = [("odd", v, rng.randrange(1, 4)) for v in odd] + [("odd", None, 1), (None, 2.5, 1), ("none", None, 1)]
    rows += [("many", rng.choice([-1, 1]) * rng.uniform(900, 105_000), 1) for _ in range(5000)]
    df = stage(spark.createDataFrame(rows, "k string, v double, w long"), "rows")
    probs = {"low": 0.0, "q": 0.25, "mid": 0.5, "high": 0.97, "top": 1.0}
    ordered, plain = [], skew.running

    def recorded(df, *args, **kwargs):
        ordered.append(df.count())
        return plain(df, *args, **kwargs)

    monkeypatch.setattr(skew, "running", recorded)
    for weight in (None, "w"):
        for keys in (["k"], []):
            ordered.clear()
            got = skew.percentiles(df, keys, "v", probs, weight=weight, stored=True)
            assert sum(ordered) < 500
            want = skew.percentiles(df, keys, "v", probs, weight=weight)
            assert sorted(map(repr, got.select(*want.columns).collect())) == sorted(map(repr, want.collect()))


def test_hot_keys_with_a_map_column(spark):
    rows = spark.range(2000).select(F.when(F.col("id") < 1500, "hot").otherwise(F.col("id").cast("string")).alias("k"),
                                    F.create_map(F.lit("a"), F.col("id")).alias("m"), "id")
    table = spark.createDataFrame([("hot", 1), ("1600", 2)], "k string, x int")
    out = skew.spread_lookup(rows, table, ["k"])
    assert out.count() == 2000 and out.filter("x = 1").count() == 1500 and out.filter("x = 2").count() == 1


def test_running_is_the_same_with_and_without_hot_groups(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "a", "a", "b", "c", None]), rng.choice([None, *range(30)]), i) for i in range(700)]
    df = stage(spark.createDataFrame(rows, "g string, t int, id long"), "rows")
    aggs = {"s": ("sum", F.col("id")), "lo": ("min", F.col("t")), "hi": ("max", F.struct("t", "id"))}
    for order in (["t", "id"], ["-t", "id"]):
        found = []
        for share in (1, 64, 100_000):  # none, some and all groups are hot
            monkeypatch.setattr(skew, "hot_share", lambda spark, share=share: share)
            out = skew.running(df, ["g"], order, aggs, totals=True, stored=True).collect()
            found.append(sorted((tuple(r) for r in out), key=lambda r: r[2]))
        assert found[0] == found[1] == found[2]


def test_tails_of_new_rows_equal_both_tables_together(spark):
    rng = np.random.default_rng(5)
    old = [(f"o{i}", float(np.round(rng.gamma(2), 1)), float(rng.normal())) for i in range(150)]
    new = [(f"n{i}", float(np.round(rng.gamma(3), 1)), float(-rng.exponential())) for i in range(40)]
    schema = "id string, a double, b double"
    every = np.array([r[1:] for r in old + new])
    for kind in ("ecod", "copod"):
        model = detectors.TailDetector(["a", "b"], "id", kind).fit(spark.createDataFrame(old, schema))
        got = {r.id: r.score for r in model.score(spark.createDataFrame(new, schema)).collect()}
        left = [[-math.log((every[:, j] <= r[1 + j]).mean()) for j in range(2)] for r in new]
        right = [[-math.log((every[:, j] >= r[1 + j]).mean()) for j in range(2)] for r in new]
        low = [((every[:, j] - every[:, j].mean()) ** 3).mean() < 0 for j in range(2)]
        for r, lo, hi in zip(new, left, right):
            auto = [a if s else b for a, b, s in zip(lo, hi, low)]
            want = max(sum(lo), sum(hi), sum(auto)) if kind == "ecod" else sum(max(c, (a + b) / 2) for a, b, c in zip(lo, hi, auto))
            assert got[r[0]] == pytest.approx(want)


def test_learning_curve_grows_to_the_whole_pair(spark):
    """A pair far from history, of 700 rows: the error falls past 200 rows, as a plain loop over prefixes finds."""
    rng = random.Random(2)
    import hashlib
    cols = "UniqueId string, BUnit string, Cpty string, BuyAmount double"
    hist = spark.createDataFrame([(f"h{i}", "B", "H", 100.0) for i in range(20)], cols)
    cell = [(f"u{i}", "B", "N", rng.gauss(0, 4)) for i in range(700)]
    cfg = drift.RecommendConfig(empirical=True, prior_rows=300)
    got = {r.k: (r["mean"], r["std"]) for r in drift.learning_curve(hist, spark.createDataFrame(cell, cols), cfg).collect()}

    def rank(tag):
        return lambda r: hashlib.md5(f"{r[0]}:42:{tag}".encode()).hexdigest()

    probe, pool = sorted(cell, key=rank("probe"))[:8], sorted(cell, key=rank("probe"))[8:]
    curve = {}
    for k in range(10, len(pool) + 1, 10):
        errors = []
        for b in range(5):
            p = (300 * 100.0 + sum(r[3] for r in sorted(pool, key=rank(b))[:k])) / (300 + k)
            errors.append(np.mean([(r[3] - p) ** 2 for r in probe]))
        curve[k] = (np.mean(errors), np.std(errors, ddof=1))
    assert set(got) == set(curve) and max(got) == 690
    for k in curve:
        assert got[k] == pytest.approx(curve[k], abs=1e-6)
    ks = sorted(curve)
    want = next((b for a, b in zip(ks, ks[1:]) if (curve[a][0] - curve[b][0]) / curve[a][0] < 0.05 and curve[b][1] / curve[b][0] < 0.2), ks[-1])
    assert drift.empirical_n(hist, spark.createDataFrame(cell, cols), cfg).first().empirical_n == want
    assert drift.empirical_n(hist, spark.createDataFrame(cell[:17], cols), cfg).count() == 0


def test_wide_categories_have_no_limit_of_columns(spark):
    rows = [(i, "K" if i % 3 else "L", f"v{i % 1500:04}", ["x", "y", None][i % 3]) for i in range(4000)]
    df = spark.createDataFrame(rows, "id long, k string, a string, b string")
    encoder = wide.WideEncoder(max_onehot=2000).fit(df, ["a", "b"])
    assert encoder.layout == [("a", 0, 1500, False), ("b", 1500, 2, False)]
    encoded = stage(encoder.transform(df.unionByName(spark.createDataFrame([(9999, "K", "new", "y")], df.schema))), "encoded")
    assert encoded.filter("id = 9999").first().active == [-1, 1]
    vector = encoder.vectors(encoded.filter("id = 2")).first()
    assert vector.indices == [2] and vector["size"] == 1502
    profile = wide.CategoryProfile(encoder, ["k"]).fit(encoded.filter("id < 9999"))
    got = {(r.id, r.group): r.err for r in profile.errors(encoded, "id").collect()}
    for i in (0, 1, 2, 9999):
        _, k, a, b = rows[i] if i < 9999 else (9999, "K", "new", "y")
        mine = [r for r in rows if r[1] == k]
        for group, at, value in (("a", 2, a), ("b", 3, b)):
            values = {v for v in (r[at] for r in rows) if v is not None}
            share = {v: sum(r[at] == v for r in mine) / len(mine) for v in values}
            want = sum(((v == value) - p) ** 2 for v, p in share.items())
            assert got[i, group] == pytest.approx(want), (i, group)
    top = profile.explain(encoded, "id", 1).filter("id = 1").first()
    assert top.expected["b"] == "y" and len(top.top_groups) == 1


def test_corruptions_of_each_seed_are_those_of_a_single_run(spark):
    from ledgerlens import schema as S
    rng = random.Random(1)
    rows = [(f"r{i}", *[float(rng.randrange(1, 9)) for _ in S.DAY_FEATURES]) for i in range(60)]
    days = spark.createDataFrame(rows, "row_id string, " + ", ".join(f"{c} double" for c in S.DAY_FEATURES))
    every = evaluation.inject_seeds(days, "row_id", 0.2, (0, 3))
    for seed in (0, 3):
        one = evaluation.inject_anomalies(days, "row_id", 0.2, seed)
        assert {tuple(r) for r in every.filter(F.col("seed") == seed).drop("seed").collect()} == {tuple(r) for r in one.collect()}


def test_measures_by_group_equal_single_ones(spark):
    rng = random.Random(4)
    rows = [(m, i, float(rng.randrange(20)), int(rng.random() < 0.2)) for m in "ab" for i in range(120)]
    df = spark.createDataFrame(rows, "m string, id long, s double, y int")
    both = {r.m: tuple(r)[1:] for r in evaluation.ranking_metrics(df, "s", "y", 10, ("id",), ["m"]).collect()}
    for m in "ab":
        one = evaluation.ranking_metrics(df.filter(F.col("m") == m), "s", "y", 10, ("id",)).first()
        assert both[m] == pytest.approx(tuple(one))


def test_forests_of_several_seeds_score_their_own_rows(spark):
    rng = random.Random(6)
    rows = [(f"i{i}", rng.gauss(0, 1), rng.gauss(0, 1)) for i in range(200)]
    df = spark.createDataFrame(rows, "id string, a double, b double")
    both = detectors.ForestDetector(["a", "b"], "id", trees=10, seeds=(1, 2)).fit(df)
    tagged = df.withColumn("seed", F.explode(F.array(F.lit(1), F.lit(2))))
    got = {(r.id, r.seed): r.score for r in both.score(tagged).collect()}
    for seed in (1, 2):
        one = detectors.ForestDetector(["a", "b"], "id", trees=10, seed=seed).fit(df).score(df)
        assert {r.id: r.score for r in one.collect()} == {i: s for (i, k), s in got.items() if k == seed}
