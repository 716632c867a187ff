import os

import pytest
from pyspark.sql import functions as F

from ledgerlens import schema as S
from ledgerlens.functions import scalars as X
from ledgerlens.operators import baselines, cleaning, encoders, features, query_audit, reasons, scoring, skew, splits
from ledgerlens.plans import pipelines
from ledgerlens.plans.fixtures import ORDER, bank_txn
from ledgerlens.sources import io
from ledgerlens.storage import stage

SF = "/root/testdata/sf0.001"


def one(spark, expr, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(expr.alias("x")).first().x


def test_scalar_functions(spark):
    col = F.col("a")
    assert one(spark, X.inv_signed_log1p(X.signed_log1p(col)), a=-12.5) == pytest.approx(-12.5)
    assert [one(spark, X.magnitude_bucket(col), a=v) for v in (0.0, 5.0, -1234.0, 1e12)] == [-9, 0, 3, 9]
    assert [one(spark, X.clean_category(col), a=v) for v in (" x ", "", "NULL", "nan")] == ["x", "UNK", "UNK", "UNK"]
    assert one(spark, X.parse_date_key(col), a="20240230") is None and one(spark, X.parse_date_key(col), a="0") is None
    assert one(spark, X.coerce_numeric(col), a="n/a") == 0.0
    assert one(spark, X.whole(col), a=2.5) == "2" and one(spark, X.format_rupees(col), a=1234.5) == "₹1,234.50"
    assert one(spark, X.month_name(col), a=3) == "Mar" and one(spark, X.weekday_name(col), a=6) == "Sun"
    assert [one(spark, X.cashbook_flag(col, w), a="Yes") for w in (False, True)] == [0, 1]
    assert one(spark, X.range_flag(col, F.lit(1), F.lit(2)), a=3) == 1
    assert one(spark, X.squared_percent_error([F.lit(2.0)], [col]), a=3.0) == pytest.approx(0.25)
    assert one(spark, X.range_weighted_error([F.lit(2.0)], [col], [F.lit(50.0)]), a=3.0) == pytest.approx(2.0)


def test_tiny_means_keep_the_ratio_finite(spark):
    from ledgerlens.operators.features import daily_group_features
    rows = [("a", "b", "c", "20240101", v) for v in (3.0, 1e-7, -1e-7)]
    df = spark.createDataFrame(rows, "BankAccountCode string, BusinessUnitCode string, BankTransactionCode string, ValueDateKey string, amount double")
    assert all(abs(r.amount_ratio_loo_slog) < 20 for r in daily_group_features(df).collect())


def test_id_map_has_a_place_for_the_unknown(spark):
    train = spark.createDataFrame([("b",), ("a",), ("b",)], "c string")
    mapped = encoders.fit_id_map(train, "c")
    got = {r.c: r.id for r in encoders.apply_id_map(spark.createDataFrame([("a",), ("z",), (None,)], "c string"), "c", mapped, "id").collect()}
    assert got == {"a": 0, "z": 2, None: 2}
    with pytest.raises(Exception, match="no __OOV__"):
        encoders.apply_id_map(train, "c", mapped.filter("value <> '__OOV__'"), "id").collect()


def test_hybrid_encoder_and_inverse_scaling(spark):
    import hashlib
    df = spark.createDataFrame([(f"v{i}", "x" if i % 2 else "y", float(i)) for i in range(20)], "many string, few string, n double")
    enc = encoders.CategoryEncoder("hybrid").fit(df, ["many", "few"])
    row = enc.transform(df).filter("many = 'v7'").first()
    bin_ = int(hashlib.md5(b"many||v7").hexdigest(), 16) % 32
    assert row[f"many__hash_{bin_}"] == 1 and sum(row[f"many__hash_{i}"] for i in range(32)) == 1
    assert (row.few_x, row.few_y) == (1, 0)
    assert one(spark, encoders.hash_bin("a", 7), a="q") == int(hashlib.md5(b"a||q").hexdigest(), 16) % 7
    scaler = encoders.Standardizer(["n"], log=True).fit(df)
    back = scaler.inverse(scaler.transform(df)).orderBy("n").collect()
    assert [round(r.n, 6) for r in back] == [float(i) for i in range(20)]


def test_gates(spark):
    cols = "amount double, amount_pred double, std_amount_30d double, zscore_amount_30d double"
    data = [(1000.0, 1010.0, 0.0, 3.0), (1000.0, 1000.5, 0.0, 3.0), (1000.0, 1010.0, 0.0, 1.0), (10.0, 10.5, 0.0, 3.0), (10.0, 20.0, 0.0, -3.0)]
    assert [r.passes_gate for r in scoring.adaptive_gate(spark.createDataFrame(data, cols)).collect()] == [True, False, False, False, True]
    assert scoring.resolve_amount_columns([f"{b}_combo" for b in ("mean_amount_30d", "std_amount_30d", "zscore_amount_30d")])[0].endswith("_combo")


def test_decoded_category_takes_the_first_maximum(spark):
    df = spark.createDataFrame([(0.2, 0.7, 0.7)], "a double, b double, c double")
    assert df.select(scoring.decode_category({"A": "a", "B": "b", "C": "c"}).alias("x")).first().x == "B"


@pytest.mark.parametrize("query, cost, valid", [
    ("Products?$expand=Category&$orderby=Name", 65.0, 1),
    ("Products?$expand=Category($expand=Supplier)&$orderby=Name&$count=true", 85.0, 0)])
def test_audit_cost_of_known_queries(spark, query, cost, valid):
    cfg = query_audit.AuditConfig.production(flat_cost=True)
    row = query_audit.audit_queries(spark.createDataFrame([(query,)], "query string"), cfg=cfg).first()
    assert (row.cost_score, row.is_valid) == (cost, valid)


@pytest.mark.parametrize("query, category, severity", [
    (" ", "generation", "critical"), ("9Users?$top=1", "syntax", "critical"), ("Big Users", "syntax", "critical"),
    ("Users?$top=1&$filter=a eq (1", "syntax", "critical"), ("Users?$topp=3&$top=1", "syntax", "critical"),
    ("Users?$top=", "syntax", "critical"), ("Users?$top=5&$filter=x eq 'a'; drop table t", "safety", "critical"),
    ("Users?$top=5&x=$batch", "safety", "critical"), ("Users?$top=5&$filter=<script>", "security", "critical"),
    ("Users?$top=0", "limits", "critical"), ("Users?$top=700", "limits", "warning"), ("Users?$top=1001", "limits", "critical"),
    ("Users?$select=a", "limits", "warning"), ("Users?$top=1&$expand=A($expand=B($expand=C($expand=D)))", "cost", "critical")])
def test_audit_issues(spark, query, category, severity):
    row = query_audit.audit_queries(spark.createDataFrame([(query,)], "query string")).first()
    assert (category, severity) in {(i.category, i.severity) for i in row.issues}
    assert row.is_valid == int(all(i.severity != "critical" for i in row.issues))
    ranks = [i.severity != "critical" for i in row.issues]
    assert ranks == sorted(ranks)


def test_audit_uses_the_last_value_and_entity_limits(spark):
    df = spark.createDataFrame([("Ledger?$top=9000&$top=150",)], "query string")
    props = spark.createDataFrame([("Ledger", n, n.startswith("k")) for n in ("k1", "k2", "kdate", "a")],
                                  "entity string, property string, is_key boolean")
    row = query_audit.audit_queries(df, profiles=query_audit.entity_profiles(props)).first()
    assert row.estimated_rows == 150 and row.is_valid == 1
    assert "transaction entity" in row.issues[0].message


def test_combined_reason_prefers_pairs(spark):
    g = "array(named_struct('name','month','kind','lowcat','actual',3.0D,'pred',7.0D,'label_actual',cast(null as string)," \
        "'label_pred',cast(null as string)), named_struct('name','amount_scaled','kind','numeric','actual',5.0D,'pred',9.0D," \
        "'label_actual',cast(null as string),'label_pred',cast(null as string)))"
    text = reasons.best_combination(F.expr(g), F.lit(5.0), F.lit("A"), F.lit("B"))
    assert one(spark, text, z=1) == ("In Mar, amount ₹5.00 between Account 'A' and BU 'B' looks unusual; "
                                    "it usually occurs in Jul around ₹9.00.")
    assert one(spark, reasons.feature_sentence(F.lit("BankAccountCode_X"), F.lit(0.5), F.lit(1.0), F.lit(0.0)), z=1) == (
        "BankAccountCode='X' contributed most (err=0.5000)")


def test_event_log_and_client_folders(spark, tmp_path):
    rows = spark.createDataFrame([("TRAINING", "INFO", "{}", "ok")], "stage string, status string, input_payload string, response string")
    for _ in range(2):
        io.append_event(rows, str(tmp_path / "log"))
    log = spark.read.parquet(str(tmp_path / "log"))
    assert log.count() == 2 and '"stage":"TRAINING"' in log.first().log_entry
    spark.range(2).write.parquet(str(tmp_path / "in" / "AI_FX_rcc"))
    spark.range(3).write.parquet(str(tmp_path / "in" / "AI_FX_abc"))
    got = {r.Client: r["count"] for r in io.read_clients(spark, str(tmp_path / "in")).groupBy("Client").count().collect()}
    assert got == {"RCC": 2, "ABC": 3}


def test_empty_results_keep_their_columns(spark, tmp_path):
    io.write_table(spark.range(3).filter("id > 5"), str(tmp_path / "none"), "csv")
    assert io.read_table(spark, str(tmp_path / "none"), "csv").columns == ["id"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
def test_saved_model_scores_every_row(spark, tmp_path):
    raw = bank_txn(spark, SF, carry=ORDER)
    raw.select(*[c for c in raw.columns if c not in ORDER]).write.parquet(str(tmp_path / "raw"))
    source = io.read_transactions(spark, str(tmp_path / "raw"))
    anomalies, art = pipelines.train_and_detect(source)
    assert anomalies.filter("reason is null or is_anomaly = 0").count() == 0
    art.save(str(tmp_path / "model"))
    score = pipelines.BatchScorer(spark, str(tmp_path / "model"))
    batch = source.filter(F.col(S.VALUE_DATE) > "20010101")
    out = score(batch)
    assert out.count() == batch.count()
    assert out.filter("(Anomaly = 1) <> (AnomalyReason <> '')").count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
def test_training_alone_gives_the_model_of_train_and_detect(spark):
    """The fitted tables do not depend on the rows to score, so a model that is only saved needs none."""
    raw = bank_txn(spark, SF, carry=ORDER).withColumn("__ts", X.parse_date_key(F.col(S.POSTING_DATE)))
    old, new = (d.drop("__ts") for d in splits.split_last_months(stage(raw, "raw"), "__ts"))
    _, both = pipelines.train_and_detect(old, test=new, order_by=ORDER)
    alone = pipelines.train(old, order_by=ORDER)
    for name in pipelines.TABLES:
        assert sorted(map(repr, alone[name].collect())) == sorted(map(repr, both[name].collect()))


def test_a_filter_on_the_issues_does_not_repeat_the_audit(spark):
    texts = ["Products?$top=10", "", "Orders?$top=abc", "Lines?$filter=(Price gt 1&$top=5"]
    audited = query_audit.audit_queries(spark.createDataFrame([(t,) for t in texts], "query string"))
    report = query_audit.audit_report(audited)
    found = {(r.entity, r.category, r.severity): r.n for r in report.collect()}
    assert found == {("", "generation", "critical"): 1, ("Orders", "limits", "critical"): 1, ("Lines", "syntax", "critical"): 1}
    for frame in (report, audited.filter("is_valid = 0")):
        plan = frame._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("regexp_extract(") < 50


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
def test_profiles_come_from_counted_rows(spark, monkeypatch):
    """Only features that differ from row to row are ordered row by row; the medians are those of the laid-out rows."""
    ordered, plain = [], skew.column_medians

    def recorded(df, keys, cols, *rest):
        ordered.append(set(cols))
        return plain(df, keys, cols, *rest)

    for module in (scoring, pipelines):
        monkeypatch.setattr(module, "column_medians", recorded, raising=False)
    raw = stage(bank_txn(spark, SF, carry=ORDER).withColumn(S.VALUE_DATE, F.when(F.col("l_partkey") % 7 == 0, None).when(
        F.col("l_partkey") % 11 == 0, "").otherwise(F.col(S.VALUE_DATE))), "raw")
    _, art = pipelines.train_and_detect(raw, order_by=ORDER)
    assert ordered and all(cols <= {"amount_dev_loo_log", "amount_ratio_loo_slog", "count_norm", "y_norm"} for cols in ordered)

    feats = stage(features.engineer_basic_features(cleaning.clean_transactions(raw, order_by=ORDER)), "feats")
    train, valid = splits.split_tail(splits.split_last_months(feats)[0], "ts", 0.1, [S.TXN_ID])
    tail = splits.in_tail(splits.split_last_months(feats)[0], "ts", S.TXN_ID, 0.1)
    found = splits.split_last_months(feats)[0].filter(tail)
    assert found.count() == valid.count() and found.select(S.TXN_ID).exceptAll(valid.select(S.TXN_ID)).isEmpty()
    counted = skew.group_context(train.drop("trans_count_day"), [*S.KEYS, S.VALUE_DATE], {"trans_count_day": F.count(F.lit(1))})
    rows = baselines.add_count_norm(counted, art["combo_stats"], art["overall"])
    rows = stage(baselines.normalize_amount(rows, art["combo_stats"], art["overall"]), "rows")
    columns = [*S.MODEL_FEATURES, "y_norm"]
    for keys, table in ((S.KEYS, art["model"]), ([], art["overall"])):
        want = {tuple(r[k] for k in keys): r for r in rows.groupBy(*keys).agg(*[F.median(c).alias(c) for c in columns]).collect()}
        got = {tuple(r[k] for k in keys): r for r in table.collect()}
        assert got.keys() == want.keys()
        for key, row in got.items():
            assert [row[f"p_{c}"] for c in columns] == pytest.approx([want[key][c] for c in columns], abs=1e-9)
