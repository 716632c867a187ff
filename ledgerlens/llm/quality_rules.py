"""Quality rules for texts, and for hosts by their shrunk failure rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import stage
from .ordering import small_lookup
from .text import words

WINDOW = 8
MIN_WORDS = 20
MAX_REPEATED = 30  # percent of the words
MAX_HOST_RATE = 0.5  # a host fails if its shrunk rate is above this


def rule_counts(docs: DataFrame) -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed to documents.

    Whole texts are counted inside the row, with no shuffle: windows are hashed, and only texts that hold a window twice
    sort their windows. The repeated words are those covered by any window that occurs twice or more, the first
    occurrence included. Null and empty texts have no words, and fail.
    """
    text = F.coalesce("text", F.lit(""))
    split = docs.withColumn("__w", words(F.col("text")))
    hashes = F.when(F.size("__w") > WINDOW, F.transform(
        F.sequence(F.lit(0), F.size("__w") - WINDOW),
        lambda i: F.xxhash64(*[F.get(F.col("__w"), i + k) for k in range(WINDOW)])))
    hashed = split.withColumn("__h", hashes)
    twice = F.size(F.array_distinct("__h")) < F.size("__h")
    windows = hashed.withColumn("__s", F.when(twice, F.sort_array(
        F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))

    def at(i):
        return F.get(F.col("__s"), i)["h"]

    repeated = F.filter("__s", lambda x, i: (at(i - 1).eqNullSafe(x["h"])) | (at(i + 1).eqNullSafe(x["h"])))
    places = windows.withColumn("__p", F.sort_array(F.transform(repeated, lambda x: x["i"])))
    covered = F.aggregate(
        F.transform("__p", lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("__p"), i + 1) - p, F.lit(WINDOW)))),
        F.lit(0), lambda a, b: a + b)
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike("[^ \\t-\\r]"))
    out = places.withColumn("__l", lines)
    counted = out.withColumns({
        "n_words": F.size("__w").cast("long"),
        "word_chars": F.char_length(F.array_join("__w", "")).cast("long"),
        "n_symbols": (F.size(F.split(text, "[#*$%&|<>]", -1)) - 1).cast("long"),
        "n_dup_lines": (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long"),
        "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
    }).drop("__w", "__h", "__s", "__p", "__l")
    # The condition cannot be moved: a filter on the verdict would else be pushed below the counts and repeat their arrays.
    return counted.withColumn("base_failed", F.when(F.monotonically_increasing_id() >= 0, base_failed()))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))


def host_verdicts(rows: DataFrame, host: str = "source", failed: str = "base_failed",
                  max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """Verdict for each host (null hosts have none): rule failures, shrunk by a beta prior fitted to all hosts.

    The prior has the mean of the hosts' rates and, by moments, their variance beyond what chance alone gives; hosts
    that differ by chance only get a prior as strong as all rows together. A host fails if its posterior mean
    (failures + alpha) / (rows + alpha + beta) is above ``max_rate``.
    """
    hosts = stage(rows.filter(F.col(host).isNotNull()).groupBy(host).agg(
        F.count(F.lit(1)).alias("host_rows"), F.count_if(failed).alias("host_failures")), "hosts")
    rate = F.col("host_failures") / F.col("host_rows")
    moments = hosts.agg(F.avg(rate).alias("m"), F.var_pop(rate).alias("v"), F.avg(1 / F.col("host_rows")).alias("inv"),
                        F.sum("host_rows").alias("n"))
    chance = F.col("m") * (1 - F.col("m"))
    beyond = F.col("v") - chance * F.col("inv")
    strength = F.when((beyond > 0) & (chance > beyond), F.least(chance / beyond - 1, F.col("n"))).otherwise(F.col("n"))
    prior = moments.select("m", strength.cast("double").alias("strength"))
    shrunk = (F.col("host_failures") + F.col("m") * F.col("strength")) / (F.col("host_rows") + F.col("strength"))
    one = hosts.crossJoin(F.broadcast(prior))  # one row
    return one.select(host, "host_rows", "host_failures", shrunk.alias("host_rate"), (shrunk > max_rate).alias("host_failed"))


def judge(counted: DataFrame, verdicts: DataFrame, host: str = "source") -> DataFrame:
    """Add host_rate, host_failed and kept: neither the document's own rules nor its host failed."""
    keyed = counted.withColumn("__host", F.coalesce(F.col(host), F.lit("")))
    table = verdicts.select(F.col(host).alias("__host"), F.col(host).alias("__known"), "host_rate", "host_failed")
    met = small_lookup(keyed, table, "__host")
    known = F.col(host).isNotNull() & F.col("__known").isNotNull()
    out = met.withColumn("host_rate", F.when(known, F.col("host_rate")))
    out = out.withColumn("host_failed", known & F.coalesce("host_failed", F.lit(False)))
    return out.withColumn("kept", ~F.col("base_failed") & ~F.col("host_failed")).drop("__host", "__known")


def quality_report(docs: DataFrame, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """One row of counts and verdicts for each document; only the counts are stored and joined, not the texts."""
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    counted = stage(rule_counts(docs.select("doc_id", "text", "source")).select("doc_id", "source", *counts), "rules")
    return judge(counted, host_verdicts(counted, max_rate=max_rate))


def keep_good(docs: DataFrame, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """The documents that pass, with their own columns. Texts are scanned for the hosts' rates and again to filter."""
    flagged = rule_counts(docs.select("text", "source")).select("source", "base_failed")
    failed = host_verdicts(flagged, max_rate=max_rate)
    names = {c: f"__d_{i}" for i, c in enumerate(docs.columns)}
    safe = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    named = safe.withColumns({"text": F.col(names["text"]), "source": F.col(names["source"])})
    kept = judge(rule_counts(named), failed).filter("kept")
    return kept.select(*[F.col(n).alias(c) for c, n in names.items()])
