import datetime as dt
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import account_day, cleaning, detectors, drift, evaluation, splits
from ledgerlens import schema as S


def fill(sizes, cap):
    """Allocation one account at a time, smallest first."""
    if sum(sizes.values()) <= cap:
        return dict(sizes)
    out, left = {}, len(sizes)
    for name, n in sorted(sizes.items(), key=lambda kv: (kv[1], kv[0])):
        out[name] = min(n, cap // left)
        cap -= out[name]
        left -= 1
    return out


@pytest.mark.parametrize("cap", [7, 50, 101, 10_000])
def test_water_fill_equals_the_loop(spark, cap):
    rng = random.Random(cap)
    days = {d: {f"a{i}": rng.randrange(1, 30) for i in range(rng.randrange(2, 9))} for d in range(4)}
    rows = [(d, a, n) for d, sizes in days.items() for a, n in sizes.items()]
    df = spark.createDataFrame(rows, "d int, BankAccountCode string, n long")
    got = {(r.d, r.BankAccountCode): r.alloc for r in account_day.water_fill(df, cap, ["d"]).collect()}
    assert got == {(d, a): n for d, sizes in days.items() for a, n in fill(sizes, cap).items()}


def test_capped_context_equals_a_loop_over_days(spark):
    rng = random.Random(2)
    start = dt.date(2024, 1, 1)
    hist = [(f"a{i % 5}", start + dt.timedelta(days=i // 5), "USD", rng.gauss(0, 1)) for i in range(200)]
    test = [(f"a{i % (2 + i % 4)}", dt.date(2024, 6, 1 + i % 6), "USD", rng.gauss(0, 2)) for i in range(30)]
    test = list({(a, d): (a, d, c, x) for a, d, c, x in test}.values())
    cols = "BankAccountCode string, txn_date date, CurrencyCode string, x double"
    out = account_day.context_score(spark.createDataFrame(test, cols), spark.createDataFrame(hist, cols), ["x"], cap=70,
                                    min_context=50)
    got = {(r.BankAccountCode, r.txn_date): (r.context_rows, r.context_score) for r in out.collect()}
    assert len(got) == len(test)
    for a, d, _, x in test:
        present = {r[0] for r in test if r[1] == d}
        mine = {k: sorted((h for h in hist if h[0] == k), key=lambda h: h[1], reverse=True) for k in present}
        alloc = fill({k: len(v) for k, v in mine.items()}, 70)
        ctx = [h[3] for k in present for h in mine[k][:alloc[k]]]
        if len(ctx) < 50:
            assert got[(a, d)] == (None, None)
            continue
        m, s = np.mean(ctx), np.std(ctx, ddof=1)
        want = 0.5 * ((x - m) / s) ** 2 + np.log(s) + 0.5 * np.log(2 * np.pi)
        assert got[(a, d)][0] == len(ctx) and got[(a, d)][1] == pytest.approx(want)


def test_fair_context_takes_the_newest_rows(spark):
    cols = "BankAccountCode string, txn_date date, CurrencyCode string"
    hist = spark.createDataFrame([("a", dt.date(2024, 1, d), "USD") for d in range(1, 11)] + [("b", dt.date(2023, 1, 1), "USD")], cols)
    day = spark.createDataFrame([("a", dt.date(2024, 2, 1), "USD"), ("b", dt.date(2024, 2, 1), "USD")], cols)
    got = sorted((r[0], r[1].day) for r in account_day.build_context(day, hist, 4, "fair").collect())
    assert got == [("a", 8), ("a", 9), ("a", 10), ("b", 1)]


@pytest.fixture(scope="module")
def day_table(spark):
    rng = random.Random(4)
    rows = []
    for i in range(300):
        n = rng.randrange(2, 9)
        credit = rng.randrange(0, n + 1)
        amounts = [rng.uniform(1, 100) for _ in range(n)]
        cs, ds = float(sum(amounts[:credit])), float(sum(amounts[credit:]))
        rows.append((f"a{i % 6}", dt.date(2024, 1, 1) + dt.timedelta(days=i // 6), "USD", float(n), sum(amounts), sum(amounts) / n,
                     max(amounts), 1.0, float(credit), float(n - credit), cs, ds, 2.0, 0.0, 2.0, 2.0, 2.0 / n, 1.0, credit / n, cs - ds))
    cols = "BankAccountCode string, txn_date date, CurrencyCode string, " + ", ".join(f"{c} double" for c in S.DAY_FEATURES)
    return spark.createDataFrame(rows, cols).withColumn("row_id", F.concat_ws("|", "BankAccountCode", "txn_date"))


def test_injection_hits_the_wanted_share_and_stays_consistent(day_table):
    out = evaluation.inject_anomalies(day_table, "row_id", 0.1, 3)
    rows = out.collect()
    assert sum(r.is_anomaly for r in rows) == 30
    assert {r.anomaly_type for r in rows if not r.is_anomaly} == {"none"}
    assert all(abs(r.BU_concentration_ratio - r.top_bu_txn_count / r.txn_count) < 1e-9 for r in rows)
    assert {r.row_id for r in evaluation.inject_anomalies(day_table, "row_id", 0.1, 3).filter("is_anomaly = 1").collect()} == {
        r.row_id for r in rows if r.is_anomaly}


def test_ranking_metrics_with_ties(spark):
    data = [(0, 0.9, 1), (1, 0.9, 0), (2, 0.8, 1), (3, 0.4, 0), (4, 0.4, 1), (5, 0.1, 0)]
    row = evaluation.ranking_metrics(spark.createDataFrame(data, "id int, s double, y int"), "s", "y", 2, ("id",)).first()
    pos, neg = [s for _, s, y in data if y], [s for _, s, y in data if not y]
    auc = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    assert row.roc_auc == pytest.approx(auc)
    assert row.pr_auc == pytest.approx(1 / 3 * 1 / 2 + 1 / 3 * 2 / 3 + 1 / 3 * 3 / 5)
    assert row.p_at_k == 0.5


def test_detectors_rank_an_outlier_high(day_table):
    features = ["amount_sum", "amount_max", "txn_count"]
    odd = day_table.limit(1).withColumns({"row_id": F.lit("odd"), "amount_sum": F.lit(9e4), "amount_max": F.lit(9e4),
                                          "txn_count": F.lit(500.0)})
    both = day_table.unionByName(odd)
    for det in (detectors.ForestDetector(features, "row_id", trees=40), detectors.ProfileDetector(features),
                detectors.TailDetector(features, "row_id"), detectors.PcaDetector(features, 1)):
        scored = det.fit(day_table).score(both)
        assert scored.count() == 301
        if det.name != "pca":
            # An extreme training row can share the whole path of the outlier in a tree, so ties are allowed.
            odd_score = scored.filter("row_id = 'odd'").first().score
            assert scored.filter(F.col("score") > odd_score).count() <= 3, det.name


def test_pca_keeps_everything_with_all_axes(day_table):
    features = ["amount_sum", "amount_max", "txn_count"]
    scored = detectors.PcaDetector(features, 3).fit(day_table).score(day_table)
    assert scored.agg(F.max("score")).first()[0] < 1e-9


def test_attribution_prefers_the_account_baseline(day_table):
    attributor = account_day.TypeAttributor.fit(day_table, min_account_rows=30)
    busy = day_table.limit(1).withColumn("txn_count", F.lit(500.0))
    row = attributor.label(busy).first()
    assert (row.anomaly_type, row.top_feature, row.baseline_scope) == ("volume_spike", "txn_count", "account")
    stranger = attributor.label(busy.withColumn("BankAccountCode", F.lit("new"))).first()
    assert stranger.baseline_scope == "global"


def test_validation_names_each_problem(day_table):
    assert cleaning.validate_account_day(day_table).count() == 0
    broken = day_table.withColumn("amount_sum", F.when(F.col("row_id").endswith("01"), None).otherwise(F.col("amount_sum")))
    assert [r.issue for r in cleaning.validate_account_day(broken).collect()] == ["missing values in amount_sum"]
    assert "net_amount" in cleaning.validate_account_day(day_table.drop("net_amount")).first().issue


def brute_psi(ref, new):
    edges = np.unique(np.quantile(ref, np.linspace(0, 1, 11)))
    a, _ = np.histogram(ref, edges)
    b, _ = np.histogram(new, edges)
    p, q = a / a.sum(), b / max(b.sum(), 1)
    return abs(np.sum((q - p) * np.log((q + 1e-6) / (p + 1e-6))))


def test_psi_equals_numpy(spark):
    rng = np.random.default_rng(1)
    ref = np.concatenate([rng.normal(0, 1, 200), np.zeros(60)])
    cells = {"x": rng.normal(1, 2, 50), "y": ref[:40], "z": np.array([0.5])}
    r = spark.createDataFrame([(float(v),) for v in ref], "v double")
    n = spark.createDataFrame([(c, float(v)) for c, vs in cells.items() for v in vs], "c string, v double")
    got = {row.c: row.psi for row in drift.psi(r, n, ["v"], cells=["c"]).collect()}
    assert got["x"] == pytest.approx(brute_psi(ref, cells["x"])) and got["y"] == pytest.approx(brute_psi(ref, cells["y"]))
    assert got["z"] == 0.0
    same = drift.psi(r, r.withColumn("c", F.lit("s")), ["v"], cells=["c"]).first().psi
    assert same == pytest.approx(0.0, abs=1e-9)


def test_recommendation_for_new_pairs(spark):
    rng = random.Random(1)
    cols = "UniqueId string, BUnit string, Cpty string, FX_Instrument_Type string, BuyCurr string, SellCurr string, " \
           "BuyAmount double, SellAmount double, score double"
    hist = [(str(i), f"B{i % 2}", f"C{i % 3}", "Spot", "USD", "EUR", rng.gauss(100, 10), rng.gauss(90, 9), rng.gauss(0, 1))
            for i in range(120)]
    new = [(str(1000 + i), "B0", "N", "Spot" if i else "Swap", "USD", "EUR", rng.gauss(100, 30), rng.gauss(90, 9), 0.0) for i in range(40)]
    cfg = drift.RecommendConfig(empirical=True)
    row = drift.recommend(spark.createDataFrame(hist, cols), spark.createDataFrame(hist[:5] + new, cols), cfg).collect()
    assert [(r.BUnit, r.Cpty, r.available) for r in row] == [("B0", "N", 40)]
    r = row[0]
    sigma = np.std([h[8] for h in hist if h[1] == "B0"], ddof=1)
    vr = max(np.sqrt(max(np.var([n[6] for n in new], ddof=1) / np.var([h[6] for h in hist], ddof=1), 1)), 1)
    assert r.sigma == pytest.approx(sigma) and 1.0 <= r.vif <= 3.0 and r.vif >= np.sqrt(vr) - 1e-9
    assert r.analytical_n == max(30, int(np.ceil((1.96 * r.sigma_effective / 0.25) ** 2)))
    assert r.empirical_n in (10, 20, 30) and r.recommended_n >= r.analytical_n
    assert r.shortfall == max(r.recommended_n - 40, 0)


def test_tail_split_rounds_half_to_even(spark):
    rows = [(i, dt.date(2024, 1, 1 + i % 3)) for i in range(25)]
    train, valid = splits.split_tail(spark.createDataFrame(rows, "id int, ts date"), "ts", 0.1, ["id"])
    assert sorted(r.id for r in valid.collect()) == [20, 23]
    assert train.count() == 23
    assert splits.split_tail(spark.createDataFrame(rows[:3], "id int, ts date"), "ts", 0.1, ["id"])[1].count() == 1


def test_splits_lose_no_rows_at_the_ends(spark):
    rows = [(i, None if i == 4 else dt.date(2024, 1, 1 + i % 2)) for i in range(5)]
    df = spark.createDataFrame(rows, "id int, ts date")
    sizes = [tuple(part.count() for part in parts) for parts in (
        splits.split_tail(df, "ts", 0.1, ["id"], skip_below=10), splits.split_time(df, "ts", frac=0.0, tie=["id"]),
        splits.split_time(df, "ts", frac=1.0, tie=["id"]), splits.split_tail(df, "ts", 0.4, ["id"]),
        splits.split_tail(df, "ts", 3.0, ["id"]))]
    assert sizes == [(5, 0), (5, 0), (0, 5), (3, 2), (0, 5)]


def test_the_last_of_repeated_rows_stays(spark):
    rows = [("a", 1, "x"), ("a", 3, "y"), ("a", 2, "z"), ("b", 5, "u"), (None, 1, "v"), (None, 2, "w")]
    df = spark.createDataFrame(rows, "k string, o int, v string").repartition(3)
    last = {tuple(r) for r in cleaning.dedupe_rows(df, ["k"], ["o"]).collect()}
    assert last == {("a", 3, "y"), ("b", 5, "u"), (None, 2, "w")}
    assert {r.v for r in cleaning.dedupe_rows(df, ["k"], ["o"], "first").collect()} == {"x", "u", "v"}
    assert cleaning.dedupe_rows(df.union(df)).count() == 6


def test_fold_sizes_are_even_in_each_stratum(spark):
    rows = [(i, "a" if i % 3 else "b") for i in range(60)]
    out = splits.stratified_folds(spark.createDataFrame(rows, "id int, k string"), ["k"], "id").groupBy("k", "fold").count()
    assert {(r.k, r["count"]) for r in out.collect()} == {("a", 8), ("b", 4)}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="test tables are not here")
def test_benchmark_and_ablation_run_whole(spark, monkeypatch):
    """Five seeds with whole forests, and contexts of 500 rows, doubled, up to all rows."""
    import inspect

    from ledgerlens.operators import evaluation
    from ledgerlens.plans import day_queries
    assert evaluation.context_sizes(2100) == [500, 1000, 2000, 2100] and evaluation.context_sizes(300) == [300]
    assert evaluation.context_sizes(1000) == [500, 1000]
    sizes, seeds, bound = [], [], inspect.signature(evaluation.evaluate_detectors)

    def caught(*args, **more):
        found = bound.bind(*args, **more)
        found.apply_defaults()
        seeds.extend(found.arguments["seeds"])
        return spark.createDataFrame([("a", 0.0, 0.0, 0.0)], "model string, roc_auc double, pr_auc double, p_at_k double")

    monkeypatch.setattr(evaluation, "evaluate_detectors", caught)
    day_queries.detector_benchmark(spark, "/root/testdata/sf0.001")
    monkeypatch.setattr(evaluation, "context_ablation", lambda train, *a: sizes.extend([train.count(), *a[2]]))
    day_queries.context_ablation(spark, "/root/testdata/sf0.001")
    assert seeds == [0, 1, 2, 3, 4] and sizes[1:] == evaluation.context_sizes(sizes[0])


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="test tables are not here")
def test_account_days_do_not_clean_the_rows_again(spark):
    from ledgerlens.plans import day_queries
    plan = day_queries.bank_days(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "l_orderkey" not in plan
