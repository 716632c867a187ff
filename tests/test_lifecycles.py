"""Stores, streams and saved models over more than one run."""

import datetime as dt
import os
import uuid

import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerlens import schema as S
from ledgerlens.operators.store import DailyCountStore
from ledgerlens.plans import pipelines
from ledgerlens.plans.fixtures import ORDER, bank_txn
from ledgerlens.plans.stream_queries import replay
from ledgerlens.storage import shared_folder
from ledgerlens.streaming import daily
from test_rules import days, txn

SF = "/root/testdata/sf0.001"


def stored(store, **limits):
    return {(r[S.ACCOUNT], str(r.day)): r["count"] for r in store.counts(**limits).collect()}


def test_merged_days_and_later_versions_read_as_one(spark, tmp_path):
    store = DailyCountStore(spark, str(tmp_path / "store"))
    store.upsert_counts(txn(spark, [("A", "20240101", "20240101")] * 3 + [("A", "20240101", "20240102")]))
    store.upsert_counts(txn(spark, [("A", "20240101", "20240101")] * 5 + [("B", "20240101", "20240101")]))
    before = stored(store)
    assert store.merge() == 1
    store.vacuum()
    assert store._committed() == [] and stored(store) == before and store.latest_version() == 1
    store.upsert_counts(txn(spark, [("A", "20240101", "20240102")] * 7))
    assert stored(store) == {**before, ("A", "2024-01-02"): 7}
    assert stored(store, before=2) == before
    store.merge()
    # Only the touched day is written again.
    assert os.listdir(tmp_path / "store" / "merged" / "version=2") and not os.path.exists(
        tmp_path / "store" / "merged" / "version=2" / "day=2024-01-01")
    assert stored(store) == {**before, ("A", "2024-01-02"): 7}


def test_half_written_versions_are_not_read(spark, tmp_path):
    store = DailyCountStore(spark, str(tmp_path / "store"))
    store.upsert_counts(txn(spark, [("A", "20240101", "20240101")]))
    store.upsert_counts(txn(spark, [("A", "20240101", "20240101")] * 9))
    (tmp_path / "store" / "version=1" / "_SUCCESS").unlink()
    assert stored(store) == {("A", "2024-01-01"): 1} and store.latest_version() == 0


def test_a_restarted_stream_goes_on_after_the_stored_versions(spark, tmp_path):
    store = DailyCountStore(spark, str(tmp_path / "store"))
    assert [store.claim_version("one", b) for b in (0, 1, 1, 0)] == [0, 1, 1, 0]
    assert [store.claim_version("two-x", b) for b in (0, 1)] == [2, 3]
    assert store.claim_version("one", 2) == 4 and store.claim_version("two-x", 0) == 2
    sink = str(tmp_path / "out")
    for n, batch in enumerate((days(spark, dt.date(2024, 1, 1), [2] * 8), days(spark, dt.date(2024, 1, 9), [9]))):
        source = str(tmp_path / f"in{n}")
        batch.coalesce(1).write.parquet(source)
        stream = spark.readStream.schema(batch.schema).parquet(source)
        stream.writeStream.foreachBatch(daily.score_then_update(store, sink)).option(
            "checkpointLocation", str(tmp_path / f"log{n}")).trigger(availableNow=True).start().awaitTermination()
    assert daily.flagged_batches(spark, sink).filter("vol_spike_flag = 1").count() == 9
    assert sum(stored(store).values()) == 25


def test_returning_keys_and_expired_state(spark, tmp_path):
    start = pd.Timestamp("2024-01-01")
    hours = {"a": [0, 1, 30, 100, 101], "b": [0, 200, 201], "c": [150]}
    rows = sorted((h, k) for k, hs in hours.items() for h in hs)
    schema = "k string, id long, ts timestamp"
    for n, chunk in enumerate((rows[:4], rows[4:6], rows[6:])):
        late = [(k, -i, start.to_pydatetime()) for i, k in enumerate("abc", 1)] if n == 2 else []
        new = [(k, h, (start + pd.Timedelta(hours=h)).to_pydatetime()) for h, k in chunk]
        spark.createDataFrame(new + late, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"chunk={n}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "chunk=*"))
    out = daily.returning_stream(stream, ["k"], "id", absent_days=2, delay="1 hour")
    run = out.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "log")).trigger(
        availableNow=True).start(str(tmp_path / "out"))
    run.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r.k, r.id) for r in got) == [("a", 0), ("a", 100), ("b", 0), ("b", 200), ("c", 150)]
    assert {r.ts for r in got if r.k == "c"} == {(start + pd.Timedelta(hours=150)).to_pydatetime()}


def test_returning_keys_share_the_state_of_a_bucket(spark, tmp_path):
    start, big = pd.Timestamp("2024-01-01"), 1 << 60
    rows = [(None if k == 7 else big + k, f"t{k % 3}", i, start + pd.Timedelta(hours=h)) for i, (h, k) in enumerate(
        (h, k) for h in range(0, 400, 20) for k in range(40) if (h // 20 + k) % (1 + k % 5) == 0 and not (k > 30 and h > 100))]
    wanted, last = set(), {}
    for k, t, i, at in rows:
        if (k, t) not in last or at - last[k, t] > pd.Timedelta(days=2):
            wanted.add((k, t, i))
        last[k, t] = at
    schema = "k long, t string, id long, ts timestamp"
    for n in range(4):
        part = [(k, t, i, at.to_pydatetime()) for k, t, i, at in rows if n * 100 <= (at - start) / pd.Timedelta(hours=1) < n * 100 + 100]
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"chunk={n}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "chunk=*"))
    out = daily.returning_stream(stream, ["k", "t"], "id", absent_days=2, delay="1 hour", buckets=4)
    run = out.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "log")).trigger(
        availableNow=True).start(str(tmp_path / "out"))
    run.awaitTermination()
    assert {(r.k, r.t, r.id) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == wanted
    assert 0 < run.lastProgress["stateOperators"][0]["numRowsTotal"] <= 4


def test_a_table_of_many_files_is_one_batch(spark):
    seen, rows, log = [], spark.range(0, 90, numPartitions=3), f"{shared_folder(spark)}/log-{uuid.uuid4().hex}"

    def look(batch, n):
        found = batch.select("id", F.input_file_name().alias("file")).collect()
        seen.append((sorted(r.id % 3 for r in found), len({r.file for r in found})))

    replay([rows.filter(f"id % 3 = {n}") for n in range(3)], "batches", lambda stream: stream.writeStream.foreachBatch(look).option(
        "checkpointLocation", log))
    assert seen == [([n] * 30, 3) for n in range(3)]


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
def test_repeated_and_missing_ids_keep_their_rows(spark, tmp_path):
    raw = bank_txn(spark, SF, carry=ORDER)
    _, art = pipelines.train_and_detect(raw, order_by=ORDER, weight_count_norm=2.0)
    art.save(str(tmp_path / "model"))
    scorer = pipelines.BatchScorer(spark, str(tmp_path / "model"))
    assert scorer.artifacts.meta["weight_count_norm"] == 2.0
    batch = raw.filter(F.col(S.VALUE_DATE) > "20010101")
    loud = batch.limit(1).withColumn(S.AMOUNT, F.lit(9e9)).withColumn(S.TXN_ID, F.lit("loud")).withColumn("l_orderkey", F.lit(-1).cast("long"))
    second = loud.withColumn("l_orderkey", F.lit(-2).cast("long"))
    nameless = batch.limit(3).withColumn(S.TXN_ID, F.lit(None).cast("string"))
    given = batch.unionByName(loud).unionByName(second).unionByName(nameless)
    out = scorer(given, order_by=ORDER)
    assert out.columns == [*given.columns, "Anomaly", "AnomalyReason"] and out.count() == given.count()
    flags = {r.l_orderkey: r.Anomaly for r in out.filter(F.col(S.TXN_ID) == "loud").collect()}
    assert flags == {-1: 0, -2: 1}
