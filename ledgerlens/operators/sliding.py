"""Order statistics of sliding windows that may be as long as a share of the table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import stage
from .skew import positions, running, spread_lookup

BITS = 4  # of a value's number that are settled in a pass


def window_values(values: DataFrame, window: int, ranks: list[int]) -> DataFrame:
    """(i, rank, value): the value of each 0-based rank among the ``window`` values before position i.

    ``values`` is a stored table of i (0, 1, ... without gaps) and v. Distinct values are numbered in order, and the
    number of the wanted value is found digit by digit: running counts of the digits, among the values that share the
    digits found so far, are read off at both ends of a window, and their difference says which digit holds the rank. So
    a window is never laid out; each pass orders the values and two points for each window once, cut evenly.
    """
    numbered = positions(values.select("v").distinct(), [], ["v"], "d")
    codes = stage(numbered.select("v", (F.col("d") - 1).alias("d")), "codes")
    top = codes.agg(F.max("d")).first()[0]
    if top is None:
        return values.select("i", F.lit(0).alias("rank"), F.col("v").alias("value")).limit(0)
    marks = stage(spread_lookup(values.select("i", "v"), codes, ["v"]).select("i", "d"), "marks")
    levels = max(1, -(-int(top).bit_length() // BITS))
    wanted = F.explode(F.array(*map(F.lit, sorted(set(ranks)))))
    windows = marks.filter(F.col("i") >= window).select("i", wanted.alias("rank"))
    windows = windows.select("i", "rank", F.col("rank").cast("long").alias("left"), F.lit(0).cast("long").alias("node"))
    for level in reversed(range(levels)):
        shift = BITS * level
        held = marks.select(
            F.shiftright("d", shift + BITS).alias("node"), F.col("i").alias("at"), F.lit(1).alias("kind"),
            F.shiftright("d", shift).bitwiseAND(F.lit((1 << BITS) - 1)).cast("int").alias("digit"))
        ends = windows.select("node", F.explode(F.array(
            F.struct((F.col("i") - window).alias("at"), F.lit(-1).alias("sign")),
            F.struct(F.col("i").alias("at"), F.lit(1).alias("sign")))).alias("e"), "i", "rank", "left")
        points = ends.select("node", "e.at", F.lit(0).alias("kind"), "e.sign", "i", "rank", "left")
        laid = held.unionByName(points, allowMissingColumns=True)
        counts = running(laid, ["node"], ["at", "kind"], {
            f"c{t}": ("sum", F.when(F.col("digit") == t, 1).otherwise(0)) for t in range(1 << BITS)})
        spans = counts.filter("kind = 0").groupBy("i", "rank", "left", "node").agg(F.array(*[
            F.sum(F.col(f"c{t}") * F.col("sign")) for t in range(1 << BITS)]).alias("c"))
        start = F.struct(F.lit(0).alias("digit"), F.col("left").alias("left"), F.lit(False).alias("done"))
        found = F.aggregate("c", start, lambda s, n: F.struct(
            F.when(s["done"] | (s["left"] < n), s["digit"]).otherwise(s["digit"] + 1).alias("digit"),
            F.when(s["done"] | (s["left"] < n), s["left"]).otherwise(s["left"] - n).alias("left"),
            (s["done"] | (s["left"] < n)).alias("done")))
        stepped = spans.withColumn("f", found)
        windows = stage(stepped.select("i", "rank", F.col("f.left").alias("left"),
                                       (F.col("node") * (1 << BITS) + F.col("f.digit")).alias("node")), "windows")
    return spread_lookup(windows.select("i", "rank", F.col("node").alias("d")), codes, ["d"]).select(
        "i", "rank", F.col("v").alias("value"))


def window_medians(values: DataFrame, window: int) -> DataFrame:
    """(i, median) of the ``window`` values before each position that has so many."""
    found = window_values(values, window, [(window - 1) // 2, window // 2])
    return found.groupBy("i").agg(((F.min("value") + F.max("value")) / 2).alias("median"))
