"""Stored daily counts per combination, versioned so that a batch never reads what it writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S
from ..functions import scalars as X
from .baselines import daily_counts
from .rules import combine_reasons_columns, flag_non_business_days, flag_spikes_from_history
from .skew import lookup


class DailyCountStore:
    """Parquet table of (keys, day, count) under ``version=/day=`` folders, and merged days under ``merged/version=/day=``.

    A version holds the counts of one batch and replaces earlier counts of the same keys and day. Writing a version
    again overwrites only itself, so a repeated batch leaves the same state. Reads list the committed versions first and
    open only those, so a half-written one is never seen, and finding the newest version reads no data.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str] = S.KEYS):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), keys
        self.schema = T.StructType(
            [T.StructField(k, T.StringType()) for k in keys]
            + [T.StructField("count", T.LongType()), T.StructField("version", T.LongType()),
               T.StructField("day", T.DateType())])

    def _folder(self, name: str = ""):
        """The folder and its file system."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, name: str = "") -> list[str]:
        path, files = self._folder(name)
        return [f.getPath().getName() for f in files.listStatus(path)] if files.exists(path) else []

    def _committed(self, name: str = "") -> list[int]:
        found = [int(n[8:]) for n in self._names(name) if n.startswith("version=") and n[8:].isdigit()]
        prefix = f"{name}/" if name else ""
        return sorted(v for v in found if "_SUCCESS" in self._names(f"{prefix}version={v}"))

    def latest_version(self) -> int:
        return max([*self._committed(), *self._committed("merged")], default=-1)

    def claim_version(self, source: str, batch: int) -> int:
        """The version of a source's batch: the one it was given before, else the next.

        An empty file keeps the claim, so a batch that runs again finds its version and a restarted source, whose
        batches count from 0 again under another name, goes on after all versions there are.
        """
        claims = [n.split("-") for n in self._names("_claims") if n.count("-") == 2]
        name = source.replace("-", "_")
        for owner, number, version in claims:
            if owner == name and int(number) == batch:
                return int(version)
        version = max([self.latest_version(), *(int(c[2]) for c in claims)], default=-1) + 1
        path, files = self._folder(f"_claims/{name}-{batch}-{version}")
        files.create(path, False).close()
        return version

    def _versions(self, before: int | None = None) -> DataFrame:
        """Rows of the merged days and of the versions after them."""
        limit = float("inf") if before is None else before
        merged = [v for v in self._committed("merged") if v < limit]
        after = max(merged, default=-1)
        rows = None
        for name, found in (("merged", merged), ("", [v for v in self._committed() if after < v < limit])):
            if found:
                root = f"{self.path}/{name}" if name else self.path
                read = self.spark.read.schema(self.schema).option("basePath", root)
                part = read.parquet(*[f"{root}/version={v}" for v in found]).select(*self.schema.names)
                rows = part if rows is None else rows.unionByName(part)
        return self.spark.createDataFrame([], self.schema) if rows is None else rows

    def counts(self, before: int | None = None, start=None, end=None) -> DataFrame:
        """Newest count per keys and day; the day range prunes the folders that are read."""
        rows = self._versions(before)
        if start is not None:
            rows = rows.filter(F.col("day") >= F.lit(start).cast("date"))
        if end is not None:
            rows = rows.filter(F.col("day") <= F.lit(end).cast("date"))
        return rows.groupBy(*self.keys, "day").agg(F.max_by("count", "version").alias("count"))

    def batch_counts(self, df: DataFrame, posting_col: str = S.POSTING_DATE) -> DataFrame:
        missing = [k for k in (*self.keys, posting_col) if k not in df.columns]
        if missing:
            raise KeyError(f"columns {missing} are needed for daily counts")
        dated = df.withColumn("day", X.parse_date_key(F.col(posting_col))).filter("day is not null")
        return daily_counts(dated, self.keys, "day").withColumnRenamed("count_day", "count")

    def upsert_counts(self, df: DataFrame, posting_col: str = S.POSTING_DATE, version: int | None = None) -> int:
        """Add or replace the counts of the (keys, day) pairs in the batch."""
        version = self.latest_version() + 1 if version is None else version
        counts = self.batch_counts(df, posting_col)
        counts.hint("rebalance", "day").write.mode("overwrite").partitionBy("day").parquet(f"{self.path}/version={version}")
        return version

    def load_history(self, df: DataFrame, days_back: int = 30, posting_col: str = S.POSTING_DATE,
                     before: int | None = None) -> DataFrame:
        """Counts of the keys in the batch, from ``days_back`` days before its first day up to its last day."""
        days = df.select(X.parse_date_key(F.col(posting_col)).alias("d"))
        span = days.agg(F.date_sub(F.min("d"), days_back).alias("a"), F.max("d").alias("b")).first()
        if span.a is None:
            return self.counts().limit(0)
        return lookup(self.counts(before, span.a, span.b), df.select(*self.keys).distinct(), self.keys, how="left_semi")

    def merge(self) -> int:
        """Merge the versions since the last merge into the days they touch; other days stay as they are."""
        version, after = self.latest_version(), max(self._committed("merged"), default=-1)
        if version > after:
            days = self._versions().filter(F.col("version") > after).select("day").distinct()  # at most the calendar
            touched = self._versions().join(F.broadcast(days), "day", "left_semi")
            counts = touched.groupBy(*self.keys, "day").agg(F.max_by("count", "version").alias("count"))
            counts.hint("rebalance", "day").write.mode("overwrite").partitionBy("day").parquet(
                f"{self.path}/merged/version={version}")
        return version

    def vacuum(self) -> None:
        """Delete the versions that are merged. Readers that listed them before must have finished."""
        after = max(self._committed("merged"), default=-1)
        for v in self._committed():
            if v <= after:
                path, files = self._folder(f"version={v}")
                files.delete(path, True)

    def compact(self, path: str) -> "DailyCountStore":
        """Merge all versions into a new store."""
        merged = self.counts()
        merged.write.mode("overwrite").partitionBy("day").parquet(f"{path}/version={self.latest_version()}")
        return DailyCountStore(self.spark, path, self.keys)


def densify(counts: DataFrame, keys: list[str], end, days: int = 30) -> DataFrame:
    """Counts of the ``days`` days before ``end`` for every key, 0 where nothing was stored."""
    last = F.lit(end).cast("date")
    grid = counts.select(*keys).distinct().withColumn(
        "day", F.explode(F.sequence(F.date_sub(last, days), F.date_sub(last, 1))))
    return lookup(grid, counts.select(*keys, "day", "count"), [*keys, "day"]).withColumn(
        "count", F.coalesce("count", F.lit(0)))


def flag_spikes_from_store(df: DataFrame, store: DailyCountStore, posting_col: str = S.POSTING_DATE,
                           before: int | None = None, horizon_days: int = 30, **cfg) -> DataFrame:
    history = store.load_history(df, horizon_days, posting_col, before)
    return flag_spikes_from_history(df, history, store.keys, posting_col, horizon_days=horizon_days, **cfg)


def run_rules(df: DataFrame, store: DailyCountStore, holidays=None, out_path: str | None = None,
              version: int | None = None, **cfg) -> DataFrame:
    """Flag a batch against the stored history and only then add the batch to the store.

    With ``out_path`` the flagged rows are written first and returned from there; without it the caller upserts.
    """
    version = store.latest_version() + 1 if version is None else version
    flagged = flag_non_business_days(df, holidays=holidays, wording="column")
    flagged = flag_spikes_from_store(flagged, store, before=version, **cfg)
    flagged = combine_reasons_columns(flagged, ["nonbiz_reason", "vol_spike_reason"])
    hit = (F.col("is_nonbiz_value") == 1) | (F.col("is_nonbiz_post") == 1) | (F.col("vol_spike_flag") == 1)
    flagged = flagged.withColumn("is_rule_anomaly", hit.cast("int"))
    if out_path is None:
        return flagged
    flagged.write.mode("overwrite").parquet(out_path)
    store.upsert_counts(df, version=version)
    return df.sparkSession.read.parquet(out_path)
