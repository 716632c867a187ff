"""Readers and sinks: tables are written to the shared folder and read back through the library."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import schema as S
from ..functions import scalars as X
from ..operators import baselines as B
from ..operators import store as K
from ..sources import io
from ..storage import shared_folder
from .features_queries import KEY_SQL, cleaned, event_rows
from .fixtures import event_txn, fx_deal, sql
from .registry import SQL, present, query


def folder(spark, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("csv_round_trip", SQL["clean_txn"])
def csv_round_trip(spark, sf_dir):
    path = folder(spark, "csv")
    io.write_table(cleaned(spark, sf_dir), path, "csv")
    out = io.read_transactions(spark, path, "csv")
    posting, value = (X.parse_date_key(F.col(c)) for c in (S.POSTING_DATE, S.VALUE_DATE))
    return present(out.withColumn("ts", F.coalesce(posting, value)))


@query("client_folders", sql("select upper(Client) as Client, cast(count(*) as bigint) as n from fx_deal group by 1", "fx_deal"))
def client_folders(spark, sf_dir):
    root = folder(spark, "clients")
    deals = fx_deal(spark, sf_dir)
    named = deals.withColumn("folder", F.concat(F.lit("AI_FX_"), F.lower("Client"))).drop("Client")
    io.write_table(named, root, partition_by=["folder"])
    return io.read_clients(spark, root).groupBy("Client").agg(F.count(F.lit(1)).alias("n"))


@query("event_log", sql("""select BankTransactionCode as stage, cast(count(*) as bigint) as n from event_txn group by 1
union all select 'done', cast(count(distinct BankAccountCode) as bigint) from event_txn""", "event_txn"))
def event_log(spark, sf_dir):
    path = folder(spark, "log")
    rows = event_txn(spark, sf_dir)
    io.append_event(rows.select(F.col(S.CODE).alias("stage"), F.lit("INFO").alias("status"),
                                F.col(S.TXN_ID).alias("input_payload"), F.lit("{}").alias("response")), path)
    io.append_event(rows.select(F.lit("done").alias("stage"), F.lit("INFO").alias("status"),
                                F.col(S.ACCOUNT).alias("input_payload"), F.lit("{}").alias("response")).distinct(), path)
    log = spark.read.parquet(path).select(F.get_json_object("log_entry", "$.stage").alias("stage"))
    return log.groupBy("stage").agg(F.count(F.lit(1)).alias("n"))


@query("saved_stats", SQL["combo_stats"])
def saved_stats(spark, sf_dir):
    path = folder(spark, "artefacts")
    stats = B.fit_combo_stats(event_rows(spark, sf_dir))
    io.Artifacts({"combo_stats": stats}, {"weight": 1.0}).save(path)
    loaded = io.Artifacts.load(spark, path, ("combo_stats",), {"weight": 2.0, "frac": 0.1})
    if loaded.meta != {"weight": 1.0, "frac": 0.1}:
        raise ValueError("settings differ from those saved")
    return present(loaded["combo_stats"])


@query("store_cycle", sql(f"""select {KEY_SQL}, strftime(pday,'%Y-%m-%d') as day, cast(count(*) as bigint) as count
from event_txn where pday is not null group by {KEY_SQL}, pday""", "event_txn"))
def store_cycle(spark, sf_dir):
    """Counts after two upserts, the second of which replaces a day of the first that was incomplete."""
    store = K.DailyCountStore(spark, folder(spark, "store"))
    rows = event_txn(spark, sf_dir)
    day = F.dayofmonth(X.parse_date_key(F.col(S.POSTING_DATE)))
    store.upsert_counts(rows.filter((day < 15) | ((day == 15) & (F.col("event_id") % 2 == 0))))
    store.upsert_counts(rows.filter(day >= 15))
    return present(store.counts())
