"""Labelled corruptions and the measures taken on them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..storage import stage
from .scoring import top_n
from .skew import lookup, ordered_values, positions, with_scalars

# The eight corruption types.
TYPES = ["volume_spike", "large_amount", "one_sided_flow", "bu_concentration", "bu_diversity", "code_diversity",
         "weekend_activity", "net_flow_extreme"]


def _draw(id_col: str, seed: Column, k: int) -> Column:
    """Uniform number in [0, 1) fixed by id, seed and draw."""
    digest = F.md5(F.concat_ws(":", F.col(id_col).cast("string"), seed.cast("string"), F.lit(str(k))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / float(1 << 32)


def inject_seeds(df: DataFrame, id_col: str, rate: float = 0.02, seeds: tuple[int, ...] = (0, 1, 2, 3, 4)) -> DataFrame:
    """The rows once for each seed, in column ``seed``, each copy corrupted on its own."""
    copies = df.withColumn("seed", F.explode(F.array(*map(F.lit, seeds))))
    return _inject(copies, id_col, rate, F.col("seed"), ["seed"])


def inject_anomalies(df: DataFrame, id_col: str, rate: float = 0.02, seed: int = 0) -> DataFrame:
    """Corrupt ``max(1, floor(n * rate))`` account-day rows, one of eight joint edits each, and label them.

    Which rows and what edits follow from hashes of the id, so every run and retry corrupts the same rows.
    """
    return _inject(df, id_col, rate, F.lit(seed), [])


def _inject(df: DataFrame, id_col: str, rate: float, seed: Column, keys: list[str]) -> DataFrame:
    chosen = df.withColumn("__h", F.md5(F.concat_ws(":", F.col(id_col).cast("string"), seed.cast("string"), F.lit("pick"))))
    ranked = ordered_values(chosen, keys, "__h")
    at = F.greatest(F.lit(1).cast("long"), F.floor(F.col("total") * rate)) - 1
    limit = ranked.filter((F.col("below") <= at) & (at < F.col("below") + F.col("n"))).select(*keys, F.col("__h").alias("__limit"))
    drawn = lookup(chosen, limit, keys, hint=True) if keys else chosen.withColumn("__limit", limit.scalar())  # a row for each seed
    drawn = drawn.withColumn("is_anomaly", F.coalesce(F.col("__h") <= F.col("__limit"), F.lit(False)).cast("int"))
    pick = F.floor(_draw(id_col, seed, 0) * len(TYPES)).cast("int")
    drawn = drawn.withColumns({
        "anomaly_type": F.when(F.col("is_anomaly") == 1, F.get(F.array(*[F.lit(t) for t in TYPES]), pick)).otherwise("none"),
        "__u": _draw(id_col, seed, 1), "__coin": _draw(id_col, seed, 2) < 0.5,
    })
    c, u, heads = F.col, F.col("__u"), F.col("__coin")
    n, total = c("txn_count"), c("amount_sum")
    one = F.lit(1.0)

    def whole(x: Column) -> Column:
        return F.floor(x).cast("double")

    new_k = whole(n * (8 + 12 * u)) + 5
    f = new_k / F.greatest(n, one)
    mult = 15 + 45 * u
    delta = c("amount_max") * (mult - 1)
    boost = total * (20 + 40 * u)
    k3, k12 = F.greatest(whole(n), F.lit(3.0)), F.greatest(whole(n), F.lit(12.0))
    units = F.least(k12, whole(10 + 10 * u))
    codes = F.least(F.greatest(whole(n), F.lit(8.0)), whole(8 + 7 * u))
    credit, debit = c("credit_amount_sum"), c("debit_amount_sum")
    zero = F.lit(0.0)
    edits: dict[str, dict[str, Column]] = {
        "volume_spike": {
            "txn_count": new_k, "credit_count": F.bround(c("credit_count") * f, 0),
            "debit_count": new_k - F.bround(c("credit_count") * f, 0), "amount_sum": total * f,
            "credit_amount_sum": credit * f, "debit_amount_sum": debit * f,
            "top_bu_txn_count": F.least(F.bround(c("top_bu_txn_count") * f, 0), new_k), "net_amount": credit * f - debit * f,
        },
        "large_amount": {
            "amount_max": c("amount_max") * mult, "amount_sum": total + delta,
            "credit_amount_sum": F.when(heads, credit + delta).otherwise(credit),
            "debit_amount_sum": F.when(heads, debit).otherwise(debit + delta),
            "amount_mean": (total + delta) / F.greatest(n, one),
            "amount_stddev": F.greatest(c("amount_stddev"), c("amount_max") * mult * 0.4),
            "net_amount": credit - debit + F.when(heads, delta).otherwise(-delta),
        },
        "one_sided_flow": {
            "txn_count": k3, "credit_count": F.when(heads, k3).otherwise(zero), "debit_count": F.when(heads, zero).otherwise(k3),
            "credit_amount_sum": F.when(heads, total).otherwise(zero), "debit_amount_sum": F.when(heads, zero).otherwise(total),
            "net_amount": F.when(heads, total).otherwise(-total),
        },
        "bu_concentration": {"unique_BU_count": one, "top_bu_txn_count": n},
        "bu_diversity": {"txn_count": k12, "unique_BU_count": units,
                         "top_bu_txn_count": F.greatest(one, whole(k12 / units))},
        "code_diversity": {"unique_txn_code_count": codes, "txn_count": F.greatest(n, codes)},
        "weekend_activity": {"weekend_txn_count": n},
        "net_flow_extreme": {
            "credit_amount_sum": F.when(heads, credit + boost).otherwise(credit),
            "debit_amount_sum": F.when(heads, debit).otherwise(debit + boost), "amount_sum": total + boost,
            "amount_mean": (total + boost) / F.greatest(n, one),
            "net_amount": credit - debit + F.when(heads, boost).otherwise(-boost),
        },
    }
    changed = {}
    for name in S.DAY_FEATURES:
        value = c(name)
        for kind, cols in edits.items():
            if name in cols:
                value = F.when(c("anomaly_type") == kind, cols[name]).otherwise(value)
        changed[name] = value
    out = drawn.select(*[changed[x].alias(x) if x in changed else c(x) for x in df.columns], "is_anomaly", "anomaly_type")
    return out.withColumns({
        "BU_concentration_ratio": F.try_divide(c("top_bu_txn_count"), n),
        "credit_debit_ratio": F.coalesce(F.try_divide(c("credit_count"), c("credit_count") + c("debit_count")), zero),
    })


def ranking_metrics(df: DataFrame, score: str, label: str, k: int = 50, tie: tuple[str, ...] = (),
                    keys: list[str] = ()) -> DataFrame:
    """ROC-AUC, average precision (both exact with tied scores) and the precision of the k largest scores.

    One row, or one for each value of ``keys`` (model, seed, context size): all groups are ordered in one pass.
    """
    keys = list(keys)
    o = ordered_values(df, keys, score, {"pos": F.col(label).cast("long")})
    pos, p = F.col("pos"), F.col("pos_total")
    neg = F.col("n") - pos
    negatives = F.col("total") - p
    area = F.try_divide(pos * (F.col("below") - F.col("pos_below") + neg / 2.0), p * negatives)
    hits = p - F.col("pos_below")
    precision = F.try_divide(pos, p) * hits / (F.col("total") - F.col("below"))
    areas = o.groupBy(*keys).agg(F.sum(area).alias("roc_auc"), F.sum(precision).alias("pr_auc"))
    top = top_n(df, score, k, keys, tie).groupBy(*keys).agg(F.avg(F.col(label).cast("double")).alias("p_at_k"))
    if keys:
        return lookup(areas, top, keys).select(*keys, "roc_auc", "pr_auc", "p_at_k")
    return with_scalars(areas, top).select("roc_auc", "pr_auc", F.col("__g.p_at_k").alias("p_at_k"))


def flag_budget(df: DataFrame, score: str, budget: float, tie: tuple[str, ...] = (), out: str = "flag") -> DataFrame:
    """Flag the ``floor(budget * n)`` largest scores."""
    ranked = positions(df, [], [f"-{score}", *tie], "__pos")
    flag = F.col("__pos") <= F.floor(F.lit(budget) * F.col("__pos_n"))
    return ranked.select(*df.columns, flag.cast("int").alias(out))


def recall_per_type(df: DataFrame, scores: list[str], budget: float = 0.03, tie: tuple[str, ...] = ()) -> DataFrame:
    """(anomaly_type, one recall column per score): share of each type among the flagged rows of each detector."""
    rows = F.array(*[F.struct(F.lit(s).alias("model"), F.col(s).cast("double").alias("score")) for s in scores])
    long = df.select("is_anomaly", "anomaly_type", *tie, F.inline(rows))
    ranked = positions(long, ["model"], ["-score", *tie], "__pos")
    flag = (F.col("__pos") <= F.floor(F.lit(budget) * F.col("__pos_n"))).cast("int")
    return ranked.filter("is_anomaly = 1").groupBy("anomaly_type").agg(
        *[F.avg(F.when(F.col("model") == s, flag)).alias(s) for s in scores])


def scored_seeds(train: DataFrame, clean_test: DataFrame, detectors: list, id_col: str,
                 prepare: Callable[[DataFrame], DataFrame], seeds: tuple[int, ...] = (0, 1, 2, 3, 4),
                 rate: float = 0.02) -> DataFrame:
    """(model, seed, id, is_anomaly, anomaly_type, score), stored: each detector is fitted once and scores all seeds.

    A detector that draws at random takes its draws from the row's ``seed`` itself (``ForestDetector(seeds=...)``).
    """
    train = stage(prepare(train), "train")
    test = stage(prepare(inject_seeds(clean_test, id_col, rate, seeds)), "corrupted")
    rows = None
    for det in detectors:
        part = det.fit(train).score(test).select(
            F.lit(det.name).alias("model"), "seed", id_col, "is_anomaly", "anomaly_type", "score")
        rows = part if rows is None else rows.unionByName(part)
    return stage(rows, "scores")


def evaluate_detectors(train: DataFrame, clean_test: DataFrame, detectors: list, id_col: str,
                       prepare: Callable[[DataFrame], DataFrame], seeds: tuple[int, ...] = (0, 1, 2, 3, 4),
                       rate: float = 0.02, k: int = 50) -> DataFrame:
    """(model, seed, roc_auc, pr_auc, p_at_k) of all detectors and seeds, measured in one table of scores."""
    scores = scored_seeds(train, clean_test, detectors, id_col, prepare, seeds, rate)
    return ranking_metrics(scores, "score", "is_anomaly", k, (id_col,), ["model", "seed"])


def summarize_seeds(results: DataFrame, metrics: tuple[str, ...] = ("roc_auc", "pr_auc", "p_at_k")) -> DataFrame:
    """Mean and deviation over the seeds per model."""
    return results.groupBy("model").agg(
        *[F.avg(m).alias(f"{m}_mean") for m in metrics], *[F.stddev_samp(m).alias(f"{m}_std") for m in metrics])


def context_sizes(n_rows: int, first: int = 500) -> list[int]:
    """``first``, doubled while it is below all rows, and all rows."""
    sizes = []
    while first < n_rows:
        sizes.append(first)
        first *= 2
    return [*sizes, n_rows]


def context_ablation(train: DataFrame, test: DataFrame, detector, sizes: list[int], date: str, tie: list[str],
                     id_col: str, k: int = 50) -> DataFrame:
    """(context_rows, model, metrics): the detector fitted on the newest n training rows for several n.

    Contexts are prefixes of one order, so rows are ranked once; the scores of all contexts are measured in one table.
    """
    ranked = stage(positions(train, [], [f"-{c}" for c in (date, *tie)], "__pos"), "contexts")
    rows = None
    for n in sizes:
        context = ranked.filter(F.col("__pos") <= n).drop("__pos", "__pos_n")
        part = detector.fit(context).score(test).select(
            F.lit(n).alias("context_rows"), F.lit(detector.name).alias("model"), id_col, "is_anomaly", "score")
        rows = part if rows is None else rows.unionByName(part)
    return ranking_metrics(stage(rows, "scores"), "score", "is_anomaly", k, (id_col,), ["context_rows", "model"])
