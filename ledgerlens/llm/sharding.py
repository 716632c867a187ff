"""Contiguous shards of equal bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import stage
from .ordering import prefix_sums
from .text import byte_size

# A group of equal texts of at most this share of a shard is not cut between two shards.
WHOLE_GROUP = 0.001


def byte_shards(rows: DataFrame, shards: int, order: list[str], group: str, whole: float = WHOLE_GROUP) -> DataFrame:
    """Cut ``rows`` (with a ``size`` of at least 1), in the given order, into contiguous shards of equal total size.

    Every row gets the global sum of the sizes before it, from the totals of range partitions; the cuts are at equal
    shares of the total. ``group`` is the first column of the order: a cut inside a group of at most ``whole`` of a
    shard moves to the nearer end of the group; larger groups are cut, so shards stay equal. Adds shard and slot (the
    position in the shard, from 0). Shards may be empty if there are fewer rows than shards.
    """
    placed = stage(prefix_sums(rows, order, start=F.col("size"), row=F.lit(1).cast("long")), "sized")
    total = placed.agg(F.sum("size")).first()[0]
    if total is None:
        return placed.select(*rows.columns, F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    target = total / shards
    wanted = [target * i for i in range(1, shards)]
    hit = placed.agg(*[F.max_by(group, F.when(F.col("start") < c, F.col("start"))).alias(f"g{i}")
                       for i, c in enumerate(wanted)]).first()
    ends = placed.filter(F.col(group).isin(list({g for g in hit if g is not None}))).groupBy(group).agg(
        F.min("start").alias("first"), F.max(F.col("start") + F.col("size")).alias("last")).collect() if hit else []
    span = {e[group]: (e["first"], e["last"]) for e in ends}  # one row for each cut at most
    cuts = []
    for g, c in zip(hit, wanted):
        first, last = span[g]
        cuts.append(c if last - first > whole * target or last <= c else float(first if c - first <= last - c else last))
    shard = sum((F.when(F.col("start") >= c, 1).otherwise(0) for c in cuts), F.lit(0))
    counts = placed.agg(*[F.count_if(F.col("start") < c).alias(f"c{i}") for i, c in enumerate(cuts)]).first()
    firsts = F.array(F.lit(0).cast("long"), *[F.lit(c).cast("long") for c in counts])
    out = placed.withColumn("shard", shard.cast("int"))
    return out.select(*rows.columns, "shard", (F.col("row") - F.get(firsts, F.col("shard"))).alias("slot"))


def shard_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """Shards of documents, ordered by the MD5 of the text and then doc_id, so equal texts lie together.

    Size is the UTF-8 length of the text plus 1. Null texts count as empty, null ids come first, repeated rows are
    rows of their own. Only ids, sizes and digests are shuffled; ``shard`` and ``slot`` say where a document goes.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (byte_size(F.col("text")) + 1).alias("size"),
                       F.crc32(text.cast("binary")).alias("text_crc32"), F.md5(text.cast("binary")).alias("text_md5"))
    return byte_shards(stage(rows, "sizes"), shards, ["text_md5", "doc_id"], "text_md5")
