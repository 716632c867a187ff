"""Streaming operators run over the event table as a stream until it is used up."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from .. import schema as S
from ..storage import shared_folder
from ..streaming import daily
from .features_queries import KEY_SQL
from ..operators.store import DailyCountStore
from .fixtures import event_txn, sql, table
from .registry import present, query
from .rules_queries import RULE_COLUMNS, STORED_RULES_SQL, day_batches


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return raw.select(
        F.col("event_id").cast("string").alias(S.TXN_ID), "ts",
        F.concat(F.lit("ACC"), (F.col("user_id") % 10).cast("string")).alias(S.ACCOUNT),
        F.concat(F.lit("BU"), (F.col("user_id") % 2).cast("string")).alias(S.UNIT), F.col("event_type").alias(S.CODE))


def replay(chunks: list[DataFrame], name: str, run: Callable[[DataFrame], DataStreamWriter]) -> None:
    """Run a stream over tables that arrive one after the other, each as one micro-batch of as many files as it has tasks.

    The stream stops after each table and goes on from its checkpoint when the next one has arrived.
    """
    spark = chunks[0].sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    for n, chunk in enumerate(chunks):
        chunk.write.parquet(f"{path}/chunk={n}")
        arrived = spark.readStream.schema(chunk.schema).parquet(f"{path}/chunk=*")
        run(arrived).trigger(availableNow=True).start().awaitTermination()


def to_folder(stream: DataFrame, path: str) -> DataStreamWriter:
    return stream.writeStream.format("parquet").option("checkpointLocation", f"{path}-log").option("path", path)


def drain(stream: DataFrame, name: str) -> DataFrame:
    """Run the stream over everything available into parquet and read the result."""
    spark = stream.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    to_folder(stream, path).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


@query("stream_daily_counts", sql(f"""select {KEY_SQL}, strftime(pday,'%Y-%m-%d') as day, cast(count(*) as bigint) as count
from event_txn where pday + interval 1 day <= (select max(event_ts) from event_txn) - interval 1 day group by all""", "event_txn"))
def stream_daily_counts(spark, sf_dir):
    return present(drain(daily.daily_counts_stream(event_stream(spark, sf_dir)), "daily"))


@query("stream_first_seen", sql(f"select distinct {KEY_SQL} from event_txn", "event_txn"))
def stream_first_seen(spark, sf_dir):
    return drain(daily.first_seen_stream(event_stream(spark, sf_dir)), "first").select(*S.KEYS)


@query("stream_dedupe", sql("select BankTransactionId, strftime(event_ts,'%Y-%m-%d') as day from event_txn", "event_txn"))
def stream_dedupe(spark, sf_dir):
    stream = event_stream(spark, sf_dir)
    out = drain(daily.dedupe_stream(stream.union(stream)), "dedupe")
    return out.select(S.TXN_ID, F.date_format("ts", "yyyy-MM-dd").alias("day"))


ABSENT_SQL = """select event_id, strftime(ts,'%Y-%m-%d %H:%M:%S') as ts from (
  select *, lag(ts) over (partition by user_id, event_type order by ts, event_id) as before from events)
where before is null or ts - before > interval 2 day"""


@query("stream_returns", ABSENT_SQL)
def stream_returns(spark, sf_dir):
    """New or returning (user, event type) pairs, with copies of old rows arriving too late in every chunk but the first."""
    events = table(spark, sf_dir, "events").select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").cast("string").alias("user_id"), "event_type")
    day = F.dayofmonth("ts")
    chunks = [events.filter((day > a) & (day <= a + 5)) for a in range(0, 31, 5)]
    late = [events.filter((day > a - 10) & (day <= a - 5)).withColumn("event_id", -F.col("event_id")) for a in range(0, 31, 5)]
    path = f"{shared_folder(spark).rstrip('/')}/returns-{uuid.uuid4().hex}"
    replay([c.unionByName(x) for c, x in zip(chunks, late)], "events", lambda stream: to_folder(
        daily.returning_stream(stream, ["user_id", "event_type"], "event_id", absent_days=2), path))
    return present(spark.read.schema(events.schema).parquet(path), "event_id", "ts")


@query("stream_rules", STORED_RULES_SQL)
def stream_rules(spark, sf_dir):
    """Micro-batches flagged against the stored counts; the stream starts anew, with a new checkpoint, before the last."""
    root = f"{shared_folder(spark).rstrip('/')}/rules-{uuid.uuid4().hex}"
    store = DailyCountStore(spark, f"{root}/counts")
    batches = day_batches(event_txn(spark, sf_dir))
    for n, chunks in enumerate((batches[:-1], batches[-1:])):
        process = daily.score_then_update(store, f"{root}/flagged", z_k=1.0)
        replay(chunks, "batches", lambda stream: stream.writeStream.foreachBatch(process).option("checkpointLocation", f"{root}/log-{n}"))
    return present(spark.read.parquet(f"{root}/flagged"), *RULE_COLUMNS)
