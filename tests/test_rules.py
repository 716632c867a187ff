import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerlens import schema as S
from ledgerlens.operators import baselines, cleaning, rules
from ledgerlens.operators.store import DailyCountStore, run_rules
from ledgerlens.streaming import daily

COLS = "BankTransactionId string, BankAccountCode string, BusinessUnitCode string, BankTransactionCode string, " \
       "ValueDateKey string, PostingDateKey string, AmountInBankAccountCurrency double, CashBookFlag string"


def txn(spark, rows):
    return spark.createDataFrame([(str(i), a, "B", "C", v, p, 1.0, "Bank") for i, (a, v, p) in enumerate(rows)], COLS)


def test_posting_weekend_is_named_before_value_holiday(spark):
    df = txn(spark, [("A", "20240115", "20240113"), ("A", "20240115", "20240116"), ("A", "x", None), ("A", "20240116", "20240115")])
    holidays = [dt.date(2024, 1, 15)]
    table = spark.createDataFrame([(h,) for h in holidays], "d date")
    for given in (holidays, table):
        out = rules.flag_non_business_days(df, holidays=given, wording="short").orderBy(S.TXN_ID).collect()
        assert [r.nonbiz_reason for r in out] == [
            "Posting date 2024-01-13 is a weekend.", "Value date 2024-01-15 is a holiday.", "",
            "Posting date 2024-01-15 is a holiday."]
        assert [(r.is_nonbiz_value, r.is_nonbiz_post) for r in out] == [(1, 1), (1, 0), (0, 0), (0, 1)]


def test_mismatch_needs_two_readable_dates(spark):
    df = txn(spark, [("A", "20240115", "20240116"), ("A", "20240115", "20240115"), ("A", "0", "20240115")])
    assert [r.is_posting_value_diff for r in rules.flag_posting_value_mismatch(df).orderBy(S.TXN_ID).collect()] == [1, 0, 0]


def test_reasons_are_numbered_without_gaps(spark):
    df = spark.createDataFrame([("a", " ", "b"), (None, None, None), ("", "c", "")], "x string, y string, z string")
    got = [r.anomaly_reason for r in rules.combine_reasons_columns(df, ["x", "y", "missing", "z"]).collect()]
    assert got == ["1) a 2) b", "", "1) c"]


def test_extra_rows_are_the_last_of_the_day(spark):
    rows = [("A", "20240101", "20240101")] * 6 + [("B", "20240101", "20240101")] * 2
    df = txn(spark, rows)
    base = spark.createDataFrame([("A", "B", "C", 2.5, 0.0, 9), ("B", "B", "C", 1.0, 0.0, 4)],
                                 "BankAccountCode string, BusinessUnitCode string, BankTransactionCode string, "
                                 "mean_daily_count double, std_daily_count double, active_days long")
    out = rules.flag_extra_transactions(df, base, [S.TXN_ID])
    got = {r[S.TXN_ID]: r for r in out.collect()}
    # 2.5 rounds to 2, so four of six are extra; B has too few active days.
    assert sorted(i for i, r in got.items() if r.is_volume_spike_txn) == ["2", "3", "4", "5"]
    assert got["5"].volume_spike_reason.startswith("This transaction is one of 4 extra txns above the typical 2 per day")
    assert got["0"].group_count_today == 6 and got["7"].group_count_today == 0
    review = rules.review_transactions(df, out)
    assert sorted(r[S.TXN_ID] for r in review.collect()) == ["0", "1", "2", "3", "4", "5"]


def test_duplicate_baseline_keys_fail(spark):
    df = spark.createDataFrame([("a",)], "k string")
    table = spark.createDataFrame([("a", 1), ("a", 2)], "k string, x int")
    with pytest.raises(Exception, match="duplicate keys"):
        baselines.lookup_checked(df, table, ["k"]).collect()


def test_first_copy_of_an_id_is_kept(spark):
    df = spark.createDataFrame([("1", 2, "late"), ("1", 1, "early"), ("2", 5, "only")], "id string, o int, v string")
    assert sorted(r.v for r in cleaning.dedupe_by_id(df, "id", ["o"]).collect()) == ["early", "only"]
    assert sorted(r.v for r in cleaning.dedupe_by_id(df, "id", ["o"], keep="last").collect()) == ["late", "only"]


def test_headers_and_column_names(spark):
    df = spark.createDataFrame([("a", "b")], "`bank account-code` string, IsCashBook string")
    assert cleaning.normalize_headers(df).columns == [S.ACCOUNT, "IsCashBook", S.CASHBOOK]
    odd = spark.createDataFrame([(1, 2)], "src_BankAccountCode int, BusnessUnitCod int")
    assert cleaning.resolve_columns(odd, wanted=(S.ACCOUNT, S.UNIT)) == {S.ACCOUNT: "src_BankAccountCode", S.UNIT: "BusnessUnitCod"}
    with pytest.raises(ValueError, match="ValueDateKey"):
        cleaning.require_columns(odd)


def test_store_replaces_a_batch_and_ignores_newer_versions(spark, tmp_path):
    store = DailyCountStore(spark, str(tmp_path / "store"))
    store.upsert_counts(txn(spark, [("A", "20240101", "20240101")] * 3 + [("B", "20240101", "20240102")]))
    store.upsert_counts(txn(spark, [("A", "20240101", "20240101")] * 5))
    rows = {(r[S.ACCOUNT], str(r.day)): r["count"] for r in store.counts().collect()}
    assert rows == {("A", "2024-01-01"): 5, ("B", "2024-01-02"): 1}
    assert {r["count"] for r in store.counts(before=1).filter("BankAccountCode = 'A'").collect()} == {3}
    store.upsert_counts(txn(spark, [("A", "20240101", "20240101")] * 4), version=1)
    assert {r["count"] for r in store.counts().filter("BankAccountCode = 'A'").collect()} == {4}
    merged = store.compact(str(tmp_path / "merged"))
    assert merged.counts().count() == 2


def days(spark, first, counts, account="A"):
    rows = []
    for n, c in enumerate(counts):
        day = (first + dt.timedelta(days=n)).strftime("%Y%m%d")
        rows += [(account, day, day)] * c
    return txn(spark, rows)


def test_rules_score_first_and_update_after(spark, tmp_path):
    store = DailyCountStore(spark, str(tmp_path / "store"))
    run_rules(days(spark, dt.date(2024, 1, 1), [2, 3, 2, 3, 2, 3, 2, 3]), store, out_path=str(tmp_path / "a"))
    spike = days(spark, dt.date(2024, 1, 9), [12])
    out = run_rules(spike, store, out_path=str(tmp_path / "b"))
    row = out.first()
    assert (row.vol_spike_flag, row.hist_active_days, row.group_count_today) == (1, 8, 12)
    counts = [2, 3, 2, 3, 2, 3, 2, 3] + [0] * 22
    assert row.hist_mean_30d == pytest.approx(sum(counts) / 30)
    assert store.latest_version() == 1
    again = run_rules(spike, store, out_path=str(tmp_path / "b"), version=1)
    assert again.first().hist_active_days == 8


def test_micro_batches_update_after_scoring(spark, tmp_path):
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    store = DailyCountStore(spark, str(tmp_path / "store"))
    days(spark, dt.date(2024, 1, 1), [2] * 8).coalesce(1).write.parquet(source)
    process = daily.score_then_update(store, sink)

    def run():
        stream = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
        q = stream.writeStream.foreachBatch(process).option("checkpointLocation", str(tmp_path / "log")).trigger(
            availableNow=True).start()
        q.awaitTermination()

    run()
    days(spark, dt.date(2024, 1, 9), [9]).coalesce(1).write.mode("append").parquet(source)
    run()
    flagged = daily.flagged_batches(spark, sink).filter("vol_spike_flag = 1")
    assert flagged.count() == 9
    assert store.latest_version() == 1
    assert store.counts().agg(F.sum("count")).first()[0] == 25


def test_first_seen_combinations(spark):
    seen = txn(spark, [("A", "20240101", "20240101")])
    new = txn(spark, [("A", "20240101", "20240101"), ("Z", "20240101", "20240101")])
    assert [r[S.ACCOUNT] for r in daily.first_seen(new, seen).collect()] == ["Z"]
