"""Balanced grouped operators: equal to the plain ones, also with a key that holds a third of the rows."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import skew


@pytest.fixture(scope="module")
def data():
    rng = random.Random(7)
    rows = []
    for i in range(3000):
        key = "hot" if i % 3 == 0 else f"k{rng.randrange(200)}"
        value = 0.0 if rng.random() < 0.2 else round(rng.uniform(-50, 50), 2)
        rows.append((i, key, value))
    return rows


@pytest.fixture(scope="module")
def frame(spark, data):
    return spark.createDataFrame(data, "id long, k string, v double").repartition(5)


def groups(data):
    out = defaultdict(list)
    for i, k, v in data:
        out[k].append((v, i))
    return out


def test_percentiles_per_key(frame, data):
    got = {r.k: (r.n, r.p10, r.p50, r.p99) for r in skew.percentiles(
        frame, ["k"], "v", {"p10": 0.1, "p50": 0.5, "p99": 0.99}).collect()}
    for k, rows in groups(data).items():
        values = [v for v, _ in rows]
        assert got[k][0] == len(values)
        np.testing.assert_allclose(got[k][1:], np.percentile(values, [10, 50, 99]), atol=1e-9)


def test_percentile_of_the_whole_table(frame, data):
    row = skew.percentiles(frame, [], "v", {"p": 0.3}).first()
    assert row.p == pytest.approx(np.percentile([v for _, _, v in data], 30))


def test_running_sums_and_totals(frame, data):
    out = skew.running(frame, ["k"], ["-v", "id"], {"s": ("sum", F.col("v")), "lo": ("min", F.col("v"))}, totals=True)
    got = {r.id: r for r in out.collect()}
    for rows in groups(data).values():
        ordered = sorted(rows, key=lambda r: (-r[0], r[1]))
        total = 0.0
        for n, (v, i) in enumerate(ordered):
            assert got[i].s == pytest.approx(total, abs=1e-6)
            assert got[i].lo == (min(x for x, _ in ordered[:n]) if n else None)
            assert got[i].s_total == pytest.approx(sum(x for x, _ in ordered), abs=1e-6)
            total += v


@pytest.mark.parametrize("keys", [["k"], []])
def test_positions(frame, data, keys):
    got = {r.id: (r.pos, r.pos_n) for r in skew.positions(frame, keys, ["v", "id"]).collect()}
    whole = groups(data).values() if keys else [[(v, i) for i, _, v in data]]
    for rows in whole:
        for n, (_, i) in enumerate(sorted(rows)):
            assert got[i] == (n + 1, len(rows))


def test_positions_by_text(spark):
    words = ["b", "", "aa", "Z", "é", "aaa", "zebra"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = [r.w for r in skew.positions(df, [], ["w"]).orderBy("pos").collect()]
    assert got == sorted(words, key=lambda w: w.encode())


def test_group_context_keeps_every_row(frame, data):
    out = skew.group_context(frame, ["k"], {"n": F.count("*"), "top": F.max("v")}).collect()
    by_key = groups(data)
    assert len(out) == len(data)
    assert all(r.n == len(by_key[r.k]) and r.top == max(v for v, _ in by_key[r.k]) for r in out)


def test_identical_copies_of_a_hot_row_are_spread(spark):
    copies = spark.range(0, 900, 1, 6).select(F.lit("x").alias("k"), F.lit(1.0).alias("v"))
    rest = spark.range(900).select(F.concat(F.lit("r"), F.col("id").cast("string")).alias("k"), F.lit(2.0).alias("v"))
    out = skew.group_context(copies.union(rest), ["k"], {"n": F.count("*")})
    assert {(r.k == "x", r.n): r.c for r in out.groupBy("k", "n").agg(F.count("*").alias("c")).collect()}[(True, 900)] == 900
    salts = copies.select(skew.spread(copies).alias("s")).distinct().count()
    assert salts == 6


def test_ordered_values_carry_previous_and_sums(frame, data):
    out = skew.ordered_values(frame, [], "v", {"odd": F.col("id") % 2}).orderBy("v").collect()
    values = sorted({v for _, _, v in data})
    assert [r.v for r in out] == values
    assert [r.prev for r in out] == [None, *values[:-1]]
    assert out[-1].below + out[-1].n == len(data) == out[0].total
    assert out[-1].odd_below + out[-1].odd == sum(i % 2 for i, _, _ in data)


def test_missing_key_matches_missing_key(spark):
    left = spark.createDataFrame([("a",), (None,), ("b",)], "k string")
    table = spark.createDataFrame([("a", 1), (None, 2)], "k string, x int")
    got = {r.k: r.x for r in skew.spread_lookup(left, table, ["k"], null_safe=True).collect()}
    assert got == {"a": 1, None: 2, "b": None}


def test_large_inputs_never_meet_in_one_window(spark, frame):
    plan = skew.positions(frame, [], ["v", "id"])._jdf.queryExecution().executedPlan().toString()
    rows = [line for line in plan.splitlines() if "Window" in line and "windowspecdefinition" in line]
    assert any("__b" in line for line in rows)
    # The only unpartitioned window orders the bucket offsets, at most one row per bucket.
    assert all("__b" in line for line in rows)
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_ids_with_a_common_start_spread_over_the_buckets(spark):
    df = spark.range(100_000).select(F.format_string("TXN-2024-%08d", "id").alias("t"))
    sizes = [r["count"] for r in skew.with_bucket(df, "t").groupBy("__b").count().collect()]
    assert len(sizes) == skew.bucket_count(spark) and max(sizes) < 3 * 100_000 / len(sizes)
    ranked = skew.positions(df, [], ["t"]).agg(F.sum("pos"), F.min("pos"), F.max("pos_n")).first()
    assert tuple(ranked) == (100_000 * 100_001 // 2, 1, 100_000)


def test_a_hot_key_that_the_table_lacks_is_salted(spark):
    rows = spark.range(3000).select(F.when(F.col("id") < 1500, "hot").when(F.col("id") < 2500, None).otherwise(
        F.col("id").cast("string")).alias("k"), "id")
    table = spark.createDataFrame([(str(i), i) for i in range(2500, 2600)], "k string, x int")
    out = skew.spread_lookup(rows, table, ["k"])
    assert out.count() == 3000 and out.filter("x is not null").count() == 100
    joins = [p for p in out.repartition(4)._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in p]
    assert any("__s" in p for p in joins)


def test_running_sums_cut_a_hot_null_group(spark):
    rows = spark.range(4000).select(F.when(F.col("id") % 4 == 0, F.col("id").cast("string")).alias("g"), "id")
    out = skew.running(rows, ["g"], ["id"], {"before": ("sum", F.lit(1).cast("long"))}, totals=True)
    got = out.filter("g is null").agg(F.count(F.lit(1)), F.max("before"), F.min("before_total")).first()
    assert tuple(got) == (3000, 2999, 3000)


def test_bins_of_groups_serve_the_medians_of_all_rows(spark):
    rows = [(i % 3 or None, math.sin(i) * 10 ** (i % 5) if i % 7 else None, float(i * i), 1.0) for i in range(200)]
    df = spark.createDataFrame(rows, "k int, x double, y double, z double")
    bins = skew.value_bins(df, ["k"], ["x", "y", "z"])
    for keys in ([], ["k"]):
        want = df.groupBy(*keys).agg(*[F.percentile(c, F.lit(0.5)).alias(c) for c in ("x", "y")])
        got = skew.column_medians(df, keys, ["x", "y"], counted=bins)
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
