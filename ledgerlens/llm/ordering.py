"""Running sums in a global or grouped order, from the totals of range partitions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stage


def prefix_sums(rows: DataFrame, order: list[str], group: list[str] = (), **sums: Column) -> DataFrame:
    """Add ``<name>``: the sum of a column over the rows before each row of its group, in ascending order.

    Rows are dealt into range partitions of (group, order), so a group with a third of all rows is cut over many of
    them; each partition adds up alone, and the totals of the partitions before it in the group (one row for each group
    and partition) are added. The placed rows are stored once, so both passes see the same partitions even if an
    executor is lost. Ties are put in a fixed but arbitrary order. Group columns must not be null. An empty table gives
    an empty result. ``rows`` is planned twice for the range boundaries: give it a stored table.
    """
    group = list(group)
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tied = rows.withColumn("__tie", F.monotonically_increasing_id())
    ranged = tied.repartitionByRange(n, *group, *order, "__tie").withColumn("__part", F.spark_partition_id())
    placed = stage(ranged, "placed")
    before = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("__part", *group).orderBy(*order, "__tie").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy("__part", *group).agg(*[F.sum(c).alias(f"__t_{k}") for k, c in sums.items()])
    offsets = totals.select(
        F.col("__part").alias("__p"), *[F.col(g).alias(f"__g_{g}") for g in group],
        *[F.coalesce(F.sum(f"__t_{k}").over(before), F.lit(0)).alias(f"__o_{k}") for k in sums])
    local = placed.select(
        "*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"__w_{k}") for k, c in sums.items()])
    same = F.col("__part") == F.col("__p")
    for g in group:
        same = same & (F.col(g) == F.col(f"__g_{g}"))
    return local.join(offsets, same, "left").select(
        *rows.columns, *[(F.col(f"__o_{k}") + F.col(f"__w_{k}")).alias(k) for k in sums])


def small_lookup(rows: DataFrame, table: DataFrame, key: str, most: int = 100_000) -> DataFrame:
    """Left join a one-row-per-key table to ``rows`` on a key that may be null on neither side.

    The table is counted: with at most ``most`` rows it is broadcast, and ``rows`` are not shuffled. Beyond that the
    two sides meet in a shuffle, where the rows of each key are dealt over 64 salts and the table is repeated for each
    salt, so that a hot key does not land in one task. The salt is of a row's place and of those columns that can be
    hashed, so copies of one row spread too. Both ways give the same rows.
    """
    names = [c for c in table.columns if c != key]
    right = table.select(F.col(key).alias("__key"), *names)
    if right.count() <= most:
        return rows.join(F.broadcast(right), rows[key] == F.col("__key"), "left").drop("__key")
    hashable = [F.col(f"`{f.name}`") for f in rows.schema if not re.search("map<|variant", f.dataType.simpleString())]
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(F.spark_partition_id(), *hashable), F.lit(64)).cast("int"))
    copies = right.withColumn("__copy", F.explode(F.sequence(F.lit(0), F.lit(63))))
    met = salted.join(copies, (F.col(key) == F.col("__key")) & (F.col("__salt") == F.col("__copy")), "left")
    return met.drop("__key", "__salt", "__copy")
