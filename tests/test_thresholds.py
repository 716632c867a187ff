import random

import numpy as np
import pytest

from ledgerlens.operators import thresholds


def samples():
    rng = random.Random(11)
    yield [round(rng.expovariate(1.0), 2) for _ in range(400)]
    yield [0.0] * 150 + [round(rng.uniform(0, 5), 1) for _ in range(300)] + [40.0, 90.0]
    yield [float(2 ** i) for i in range(12)]


def slope(values):
    s = np.sort(values)
    gaps = np.diff(s)
    start = max(1, int(len(gaps) * 0.1))
    for i in range(start, len(gaps)):
        if gaps[i] > 1.2 * gaps[:start].mean():
            return s[i]
    return s[int(gaps.argmax())]


def tail(values):
    s = np.sort(values)[::-1]
    at = int(np.ceil(0.05 * len(s)))
    for i in range(1, len(s)):
        if s[i - 1] != 0 and (s[i - 1] - s[i]) / s[i - 1] < 0.2:
            at = i
            break
    return s[at - 1]


def rolling(values):
    s = np.sort(values)
    gaps = np.diff(s)
    w = max(1, int(len(gaps) * 0.02))
    ratio = np.array([gaps[i] / (np.median(gaps[max(0, i - w):i]) + 1e-12) for i in range(w, len(gaps))])
    limit = np.sort(ratio)[int(np.ceil(0.95 * len(ratio))) - 1] * 1.02
    hits = np.flatnonzero(ratio >= limit)
    return s[w + hits[0]] if len(hits) else s[-1]


@pytest.mark.parametrize("method, brute", [("slope", slope), ("tail", tail), ("rolling", rolling)])
@pytest.mark.parametrize("which", range(3))
def test_elbow_equals_brute_force(spark, method, brute, which):
    values = list(samples())[which]
    df = spark.createDataFrame([(v,) for v in values], "e double")
    row = thresholds.elbow_threshold(df, "e", method).first()
    want = brute(values)
    assert row.threshold == pytest.approx(want)
    over = [v for v in values if (v >= want if method == "tail" else v > want)]
    assert (row.n_flagged, row.n) == (len(over), len(values))


def test_per_key_threshold_needs_enough_rows(spark):
    rows = [(k, float(i)) for k, n in (("a", 19), ("b", 20), ("c", 21)) for i in range(n)]
    df = spark.createDataFrame(rows, "k string, e double")
    got = {r.k: r.threshold for r in thresholds.fit_threshold(df, "e", 0.99, ["k"], 20).collect()}
    assert set(got) == {"b", "c"}
    assert got["b"] == pytest.approx(np.percentile(range(20), 99))


def test_five_thresholds(spark):
    values = [round(random.Random(5).gauss(10, 2), 3) for _ in range(1)] + [float(v) for v in range(200)] + [999.0]
    df = spark.createDataFrame([(v,) for v in values], "e double")
    got = {r.method: r for r in thresholds.five_thresholds(df, "e").collect()}
    assert got["zscore"].threshold == pytest.approx(np.mean(values) + 3 * np.std(values))
    assert got["elbow"].threshold == 999.0 and got["elbow"].n_flagged == 0
    assert got["percentile"].n_flagged == sum(v > np.percentile(values, 99) for v in values)
