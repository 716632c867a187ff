import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest

from ledgerlens.operators import rolling

START = dt.date(2024, 1, 1)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    out = []
    for i in range(500):
        key = "hot" if i % 3 == 0 else rng.choice("abcd")
        out.append((i, key, START + dt.timedelta(days=rng.randrange(70)), round(rng.uniform(1, 90), 2), rng.randrange(5)))
    return out


SCHEMA = "id long, k string, ts date, amount double, posting_lag_days int"


def expected(rows):
    df = pd.DataFrame(rows, columns=["id", "k", "ts", "amount", "lag"]).sort_values(["k", "ts", "id"])
    df["ts"] = pd.to_datetime(df["ts"])
    parts = []
    for _, g in df.groupby("k"):
        g = g.set_index("ts")
        month = g["amount"].rolling("30D")
        parts.append(pd.DataFrame({
            "id": g["id"], "c7": g["amount"].rolling("7D").count().shift(1), "c30": month.count().shift(1),
            "mean": month.mean().shift(1), "std": month.std(ddof=1).shift(1), "lag": g["lag"].rolling("30D").mean().shift(1)}))
    return pd.concat(parts).set_index("id")


def test_row_baselines_equal_pandas(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    got = rolling.rolling_baselines(df, ["k"], tie=["id"]).toPandas().set_index("id").sort_index()
    want = expected(rows).sort_index()
    for mine, theirs in zip(rolling.BASELINE_COLUMNS, ["c7", "c30", "mean", "std", "lag"]):
        np.testing.assert_allclose(got[mine].astype(float), want[theirs].astype(float), atol=1e-6, equal_nan=True)


def test_equal_amounts_have_no_spread(spark):
    df = spark.createDataFrame([(i, "a", START + dt.timedelta(days=i), 50000.33, 0) for i in range(5)], SCHEMA)
    std = [r.std_amount_30d for r in rolling.rolling_baselines(df, ["k"], tie=["id"]).orderBy("id").collect()]
    assert std == [None, None, 0.0, 0.0, 0.0]


def test_asof_join_equals_pandas(spark, rows):
    right = [(k, START + dt.timedelta(days=d), float(d)) for k in ("hot", "a", "b") for d in range(5, 70, 9)]
    left = spark.createDataFrame(rows, SCHEMA)
    out = rolling.asof_join(left, spark.createDataFrame(right, "k string, ts date, x double"), ["k"], "ts", ["x"], "known")
    got = {r.id: (r.x, r.known) for r in out.collect()}
    l = pd.DataFrame(rows, columns=["id", "k", "ts", "amount", "lag"])
    r = pd.DataFrame(right, columns=["k", "ts", "x"])
    l["ts"], r["ts"] = pd.to_datetime(l["ts"]), pd.to_datetime(r["ts"])
    want = pd.merge_asof(l.sort_values("ts"), r.sort_values("ts"), on="ts", by="k").set_index("id")
    assert len(got) == len(rows)
    for i, (x, known) in got.items():
        assert (x is None and np.isnan(want.x[i])) or x == want.x[i]
        assert known == int(want.k[i] in ("hot", "a", "b"))


def test_zscore_rules(spark):
    cols = "amount double, mean_amount_30d double, std_amount_30d double, has_baseline int, " \
           "txn_count_7d long, txn_count_30d long, avg_posting_lag_30d double"
    data = [(10.0, 4.0, 2.0, 1, 1, 1, 0.0), (4.0, 4.0, 0.0, 1, 1, 1, 0.0), (5.0, 4.0, 0.0, 1, 1, 1, 0.0),
            (5.0, None, None, 1, None, None, None), (5.0, None, None, 0, None, None, None)]
    got = [r.zscore_amount_30d for r in rolling.zscore_30d(spark.createDataFrame(data, cols)).collect()]
    assert got == [3.0, 0.0, 6.0, 0.0, 6.0]


def test_newer_baseline_wins(spark):
    cols = "k string, ts date, x long"
    old = spark.createDataFrame([("a", START, 1), ("b", START, 2)], cols)
    new = spark.createDataFrame([("a", START, 0), ("c", START, 3)], cols)
    assert {(r.k, r.x) for r in rolling.update_baselines(old, new, ["k"]).collect()} == {("a", 0), ("b", 2), ("c", 3)}
