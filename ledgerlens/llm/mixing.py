"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import stage
from .ordering import prefix_sums, small_lookup
from .text import word_count

# Sources in order of their names (null last) take these weights in turn.
WEIGHTS = (5.0, 2.0, 1.0)
BUDGET = 1.5
MOST_COPIES = 2


def shuffle_key(doc_id: Column, seed: int) -> Column:
    return F.md5(F.concat_ws(":", doc_id.cast("string"), F.lit(str(seed))).cast("binary"))


def source_targets(sized: DataFrame, weights: tuple = WEIGHTS, budget: float = BUDGET,
                   copies: int = MOST_COPIES) -> DataFrame:
    """Target of each source: its share of the budget by weight, at most ``copies`` times its size.

    What sources above that limit leave is shared by weight among the others until none is above. With the sources in
    order of limit / weight, the level reached is the smallest one that no later source cuts, so running sums over the
    sources replace the repeated sharing. Returns src (never null), source_size, target.
    """
    sources = stage(sized.groupBy("src").agg(F.sum("size").alias("source_size")), "sources")
    numbered = prefix_sums(sources, ["src"], at=F.lit(1).cast("long"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("at") % len(weights) + 1).cast("int"))
    limits = numbered.select("src", "source_size", weight.alias("weight"),
                             (F.col("source_size") * float(copies)).alias("limit"))
    limits = stage(limits.withColumn("level", F.col("limit") / F.col("weight")), "limits")
    total = limits.agg(F.sum("weight").alias("weights"), (F.sum("source_size") * F.lit(budget)).alias("words")).first()
    below = prefix_sums(limits, ["level", "src"], used=F.col("limit"), heavy=F.col("weight"))
    reached = (F.lit(total.words) - F.col("used")) / (F.lit(total.weights) - F.col("heavy"))
    level = below.filter(reached <= F.col("level")).agg(F.min_by(reached, F.struct("level", "src"))).first()[0]
    share = F.col("limit") if level is None else F.least("limit", F.lit(level) * F.col("weight"))
    return limits.select("src", "source_size", share.alias("target"))


def queue(sized: DataFrame, weights: tuple = WEIGHTS, budget: float = BUDGET, copies: int = MOST_COPIES,
          seed: int = 7) -> DataFrame:
    """How many copies of each row the mix takes.

    ``sized`` has doc_id, source, size (words, at least 0) and, if rows with equal id and size are to be told apart, a
    comparable ``tie``. Rows of a source are shuffled by a hash of (doc_id, seed); repeated ids by size, then ``tie``.
    A copy's virtual finish time is the source's words up to its end (earlier rounds through the source included)
    divided by the source's target; all copies are range-sorted by that time and cut where the budget is used up. The
    cut is one position in that order, so each row compares its own times with it. Adds source_size, target, copies
    and taken (size times copies).

    A null source is one source and comes last. Rows of size 0 take no words. Rows that agree in all columns are
    interchangeable. An empty table gives an empty result. Reruns agree, as order depends on values alone.
    """
    src = F.struct(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name"))
    tie = F.col("tie") if "tie" in sized.columns else F.lit(0)
    rows = stage(sized.select("doc_id", "source", "size", src.alias("src"), shuffle_key(F.col("doc_id"), seed).alias("mixed"),
                              tie.alias("tie")), "sized")
    targets = stage(source_targets(rows, weights, budget, copies), "targets")
    at = ["mixed", "doc_id", "size", "tie"]
    placed = prefix_sums(rows, at, ["src"], start=F.col("size"))
    known = stage(small_lookup(placed, targets, "src"), "queued")
    end = F.col("start") + F.col("size")

    def finish(copy):
        return F.try_divide((F.col("source_size") * copy + end).cast("double"), F.col("target"))

    place = ["finish", "src", *at, "copy"]
    tickets = known.filter(F.col("size") > 0).withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    tickets = tickets.select(finish(F.col("copy")).alias("finish"), "src", *at, "copy")
    whole = rows.agg(F.sum("size") * F.lit(budget)).first()[0] or 0.0
    sorted_tickets = prefix_sums(stage(tickets, "tickets"), place, before=F.col("size"))
    over = sorted_tickets.filter(F.col("before") + F.col("size") > F.lit(whole))
    cut = over.agg(F.min(F.struct(*place)).alias("cut"))
    taken = known.crossJoin(F.broadcast(cut))  # one row
    took = sum((F.when(F.col("cut").isNull() | (F.struct(
        finish(F.lit(c)).alias("finish"), "src", *at, F.lit(c).alias("copy")) < F.col("cut")), 1).otherwise(0)
        for c in range(copies)), F.lit(0))
    taken = taken.withColumn("copies", F.when(F.col("size") > 0, took).otherwise(0).cast("int"))
    return taken.select("doc_id", "source", "mixed", "size", "tie", "source_size", "target", "copies",
                        (F.col("size") * F.col("copies")).alias("taken"))


def mixed(docs: DataFrame, weights: tuple = WEIGHTS, budget: float = BUDGET, copies: int = MOST_COPIES,
          seed: int = 7) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with their own columns.

    In the shuffled order of a source, a round takes all documents up to a point. So the decision is one place per
    source and round, looked up by source, and texts are neither sorted nor joined by document. Documents without words
    stay once.
    """
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("tie"))
    taken = queue(sized, weights, budget, copies, seed).filter(F.col("size") > 0)
    place = F.struct("mixed", "doc_id", "size", "tie")
    ends = stage(taken.groupBy(F.struct(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name")).alias("__src")).agg(
        *[F.max(F.when(F.col("copies") > c, place)).alias(f"__end{c}") for c in range(copies)]), "ends")
    safe = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"))
    keyed = safe.select("__row", F.struct(F.col("__row.source").isNull().alias("none"), F.coalesce(
        F.col("__row.source"), F.lit("")).alias("name")).alias("__src"), F.struct(
        shuffle_key(F.col("__row.doc_id"), seed).alias("mixed"), F.col("__row.doc_id").alias("doc_id"), word_count(
            F.col("__row.text")).alias("size"), F.xxhash64("__row.text").alias("tie")).alias("__at"))
    met = small_lookup(keyed, ends, "__src")
    times = sum((F.when(F.col("__at") <= F.col(f"__end{c}"), 1).otherwise(0) for c in range(copies)), F.lit(0))
    n = F.when(F.col("__at.size") == 0, 1).otherwise(times)
    many = met.withColumn("__n", n).filter("__n > 0").select("__row", F.explode(F.array_repeat(F.lit(0), F.col("__n").cast("int"))))
    return many.select("__row.*")
