"""Chat logs: drop snapshots that a longer log continues, then render what is left."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stage

LANES = 4  # of 31 bits each, in a prefix hash


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, place, prefix) for every turn: its 1-based place and the rolling hash of the turns up to it.

    Each turn is hashed with its place, role and text (nulls apart from empty texts) into four lanes; the hash of a
    prefix is the running sum of each lane, so it rolls forward by an addition per turn. Turns are ordered by turn
    (null first), role and text; repeated rows count once; rows without conv_id form one conversation.
    """
    rows = turns.select("conv_id", "turn", "role", "text").distinct()
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    placed = rows.withColumn("place", F.row_number().over(order))
    lanes = [F.xxhash64("place", F.col("role").isNull(), "role", F.col("text").isNull(), "text", F.lit(i)).bitwiseAND(F.lit(2**31 - 1))
             for i in range(LANES)]
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    sums = [F.sum(lane).over(upto) for lane in lanes]
    return placed.select("conv_id", "place", F.concat_ws("-", *[s.cast("string") for s in sums]).alias("prefix"))


def maximal(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, copies): conversations that no longer one continues; of equal ones the smallest conv_id.

    The hash of a whole conversation is looked for among the proper prefixes of all; both sides are distinct, so a first
    turn or conversation that many logs share is one row on either side.
    """
    rolled = stage(prefixes(turns), "prefixes")
    last = rolled.groupBy("conv_id").agg(F.max("place").alias("n_turns"))
    tagged = rolled.join(last.withColumnRenamed("conv_id", "__c"), F.col("conv_id").eqNullSafe(F.col("__c"))).drop("__c")
    tagged = stage(tagged, "tagged")
    whole = tagged.filter("place = n_turns").groupBy("prefix", "n_turns").agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("copies"))
    proper = tagged.filter("place < n_turns").select("prefix", F.col("place").alias("n_turns")).distinct()
    kept = whole.join(proper, ["prefix", "n_turns"], "left_anti")
    return kept.select("conv_id", F.col("n_turns").cast("long").alias("n_turns"), F.col("copies").cast("long").alias("copies"))


def render(turns: DataFrame, kept: DataFrame, start: str = "<|im_start|>", end: str = "<|im_end|>\n") -> DataFrame:
    """(conv_id, n_turns, copies, chat): each kept conversation as one text, its turns in order.

    A turn is ``start role \\n text end``; null roles and texts are empty. A rendered conversation is one value, so it
    must fit a row.
    """
    turn = F.concat(F.lit(start), F.coalesce("role", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit(end))
    rows = turns.select("conv_id", "turn", "role", "text").distinct()
    one = rows.join(kept.withColumnRenamed("conv_id", "__c"), F.col("conv_id").eqNullSafe(F.col("__c")))
    grouped = one.groupBy("conv_id", "n_turns", "copies").agg(F.array_sort(F.collect_list(
        F.struct("turn", "role", "text", turn.alias("out")))).alias("turns"))
    return grouped.select("conv_id", "n_turns", "copies", F.array_join(F.transform("turns", lambda t: t["out"]), "").alias("chat"))


def collapse_and_render(turns: DataFrame) -> DataFrame:
    """Maximal conversations, rendered. Snapshots and copies are gone before any text is joined."""
    return render(turns, stage(maximal(turns), "maximal"))
