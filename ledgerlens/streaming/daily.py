"""Streaming forms of the daily baseline: counts, de-duplication, first-seen combinations, score-then-update batches."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .. import schema as S
from ..operators.rules import any_rule
from ..operators.skew import spread_lookup
from ..operators.store import DailyCountStore, run_rules


def daily_counts_stream(stream: DataFrame, ts: str = "ts", keys: list[str] = S.KEYS, delay: str = "1 day") -> DataFrame:
    """Transactions per combination and day, emitted once the watermark has passed the day."""
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp"))
    counts = timed.withWatermark(ts, delay).groupBy(F.window(ts, "1 day"), *keys).agg(F.count(F.lit(1)).alias("count"))
    return counts.select(*keys, F.to_date("window.start").alias("day"), "count")


def dedupe_stream(stream: DataFrame, id_col: str = S.TXN_ID, ts: str = "ts", delay: str = "1 day") -> DataFrame:
    """Drop repeated transaction ids that arrive within the delay of each other."""
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp"))
    return timed.withWatermark(ts, delay).dropDuplicatesWithinWatermark([id_col])


def first_seen(batch: DataFrame, seen: DataFrame, keys: list[str] = S.KEYS) -> DataFrame:
    """Rows whose combination has not been seen before this batch."""
    known = seen.select(*keys).distinct().withColumn("__hit", F.lit(1))
    return spread_lookup(batch, known, keys).filter("__hit is null").drop("__hit")


def first_seen_stream(stream: DataFrame, keys: list[str] = S.KEYS) -> DataFrame:
    """First row of each combination ever; the state holds one entry per combination for good."""
    return stream.dropDuplicates(keys)


def returning_stream(stream: DataFrame, keys: list[str], id_col: str, ts: str = "ts", absent_days: int = 90,
                     delay: str = "1 day", buckets: int = 1024) -> DataFrame:
    """Rows of combinations that are new, or were not seen in the ``absent_days`` before; (keys, id, ts).

    The state of a combination is the time it was last seen. Combinations are dealt to ``buckets`` by hash, and a bucket
    keeps the times of its combinations in one state, so a batch costs a call for each bucket instead of one for each
    combination. A timer drops a combination once the watermark has passed its time by ``absent_days``, so the state holds
    the combinations active lately. Rows that arrive after the watermark are dropped; earlier ones that come late do not
    count as a return. Of rows at one time the smallest id counts. ``buckets`` is fixed for the life of a checkpoint.
    """
    rows = stream.select(*keys, F.col(id_col), F.col(ts).cast("timestamp").alias(ts)).withWatermark(ts, delay)
    longs = [k for k in keys if isinstance(rows.schema[k].dataType, T.LongType)]  # a null among them would make them floats
    texts = rows.withColumns({k: F.col(k).cast("string") for k in longs})
    plain = texts.schema
    gap = absent_days * 86_400_000_000  # microseconds
    exact = {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd HH:mm:ss.SSSSSSXXX",
             "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS"}

    def keep(state: GroupState, seen: pd.Series) -> None:
        """Keep the times that are not too old, and come back when the first of them is."""
        mark = state.getCurrentWatermarkMs()
        seen = seen[seen + gap >= mark * 1000]
        if seen.empty:
            state.remove()
            return
        state.update((seen.index.tolist(), seen.tolist()))
        state.setTimeoutTimestamp(max((int(seen.min()) + gap) // 1000 + 1, mark + 1))

    def update(key, frames, state: GroupState):
        names, times = state.get if state.exists else ([], [])
        seen = pd.Series(times, index=pd.Index(names, dtype=object), dtype="int64")
        if state.hasTimedOut:
            keep(state, seen)
            return
        found = pd.concat(list(frames)).sort_values(["__key", "__us", id_col], ignore_index=True)
        times = found["__us"].to_numpy()
        unseen, at = times - gap - 1, seen.index.get_indexer(found["__key"])
        stored = np.where(at < 0, unseen, np.append(seen.to_numpy(), 0)[at])
        before = np.where(found["__key"].duplicated(), np.roll(times, 1), unseen)
        yield found.loc[times - np.maximum(before, stored) > gap, plain.names]
        keep(state, pd.concat([seen, found.groupby("__key")["__us"].max()]).groupby(level=0).max())

    keyed = texts.withColumns({"__us": F.unix_micros(ts), "__key": F.to_json(F.struct(*keys), exact)})
    dealt = keyed.withColumn("__bucket", F.pmod(F.xxhash64("__key"), F.lit(buckets)))
    found = dealt.groupBy("__bucket").applyInPandasWithState(
        update, plain, "keys array<string>, seen array<long>", "append", GroupStateTimeout.EventTimeTimeout)
    return found.withColumns({k: F.col(k).cast("long") for k in longs})


def score_then_update(store: DailyCountStore, sink: str, holidays=None, posting_col: str = S.POSTING_DATE,
                      **cfg) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function: flag a batch against earlier batches, write it, then add it to the store.

    The store gives each batch of a stream its version, which names the output folder too: a batch that runs again
    replaces its own output and counts and never sees them as history, and a stream that starts anew (its batches count
    from 0 again) goes on after the stored versions and sees them all.
    """
    def process(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        source = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or "direct"
        version = store.claim_version(source, batch_id)
        run_rules(batch, store, holidays, out_path=f"{sink.rstrip('/')}/batch={version}", version=version, **cfg)

    return process


def flagged_batches(spark, sink: str) -> DataFrame:
    """Rows of all batches with any rule flag set."""
    return any_rule(spark.read.parquet(sink), ["is_nonbiz_value", "is_nonbiz_post", "vol_spike_flag"])
