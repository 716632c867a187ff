"""Per-combination statistics, their fallbacks, and the normalised amounts and counts built from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import scalars as X
from ..storage import stage
from .skew import group_context, lookup, percentiles, spread_lookup, with_scalars

FIT_FLOOR = 1e-6
APPLY_FLOOR = 0.1
COUNT_FLOOR = 0.10

QUARTILES = {"q25": 0.25, "q50": 0.5, "q75": 0.75}


def attach(df: DataFrame, table: DataFrame, keys: list[str], stored: bool) -> DataFrame:
    """Left join fitted statistics to rows of which a key may hold many; stored rows are not stored again to be counted."""
    return spread_lookup(df if stored else stage(df, "rows"), table, keys)


def median_iqr(df: DataFrame, keys: list[str], value: str, approx: bool = False) -> DataFrame:
    """Median and floored inter-quartile range per group."""
    q = percentiles(df, keys, value, QUARTILES, approx)
    return q.select(*keys, F.col("q50").alias("median"),
                    F.greatest(F.col("q75") - F.col("q25"), F.lit(FIT_FLOOR)).alias("iqr"))


def fit_amount_stats(df: DataFrame, keys: list[str] = S.KEYS, exact: bool = True, stored: bool = False) -> DataFrame:
    """Median and IQR of the signed log amount, median absolute deviation of the amount, and the row count.

    The log is increasing, so its quartiles and the raw median come from one ordering of the amounts.
    """
    logs = {name: X.signed_log1p for name in QUARTILES}
    amounts = df.select(*keys, "amount")
    amounts = amounts if stored or not exact else stage(amounts, "amounts")
    q = stage(percentiles(amounts, keys, "amount", {**QUARTILES, "median": 0.5}, not exact, maps=logs, stored=exact), "quartiles")
    gaps = spread_lookup(amounts, q.select(*keys, "median"), keys, q.select(*keys, F.col("n").alias("__n")))
    gaps = gaps.withColumn("gap", F.abs(F.col("amount") - F.col("median")))
    mad = percentiles(gaps, keys, "gap", {"mad": 0.5}, not exact, stored=exact).drop("n")
    return lookup(q, mad, keys).select(
        *keys, F.col("q50").alias("median_log"),
        F.greatest(F.col("q75") - F.col("q25"), F.lit(FIT_FLOOR)).alias("iqr_log"),
        F.greatest(F.col("mad"), F.lit(FIT_FLOOR)).alias("mad"), F.col("n").alias("count"))


def daily_counts(df: DataFrame, keys: list[str], day: str) -> DataFrame:
    return df.groupBy(*keys, day).agg(F.count(F.lit(1)).alias("count_day"))


def fit_count_stats(df: DataFrame, keys: list[str] = S.KEYS, day: str = S.VALUE_DATE, daily: DataFrame | None = None
                    ) -> DataFrame:
    """Median and floored IQR of the log daily count per combination (at most one value per calendar day)."""
    daily = (daily_counts(df, keys, day) if daily is None else daily).withColumn("__l", F.log1p("count_day"))
    q = daily.groupBy(*keys).agg(F.percentile("__l", F.array(*[F.lit(p) for p in QUARTILES.values()])).alias("q"))
    return q.select(*keys, F.col("q")[1].alias("count_median_log"),
                    F.greatest(F.col("q")[2] - F.col("q")[0], F.lit(COUNT_FLOOR)).alias("count_iqr_log"))


def fit_global_stats(df: DataFrame, keys: list[str] = S.KEYS, day: str = S.VALUE_DATE, exact: bool = True,
                     stored: bool = False, daily: DataFrame | None = None) -> DataFrame:
    """One row: the fallbacks for combinations that were not seen in training.

    ``stored`` rows are not stored again to be read twice; ``daily`` are their daily counts, if they are there already.
    """
    logs = {name: X.signed_log1p for name in QUARTILES}
    amounts = df if stored or not exact else stage(df.select("amount"), "amounts")
    levels = percentiles(amounts, [], "amount", QUARTILES, not exact, maps=logs, stored=exact)
    daily = daily_counts(df, keys, day) if daily is None else daily
    counts = percentiles(daily, [], "count_day", QUARTILES, maps={name: F.log1p for name in QUARTILES})
    both = with_scalars(levels, counts, "c")
    return both.select(
        F.col("q50").alias("median_log"),
        F.greatest(F.col("q75") - F.col("q25"), F.lit(FIT_FLOOR)).alias("iqr_log"),
        F.col("c.q50").alias("count_median_log"),
        F.greatest(F.col("c.q75") - F.col("c.q25"), F.lit(COUNT_FLOOR)).alias("count_iqr_log"))


def fit_combo_stats(df: DataFrame, keys: list[str] = S.KEYS, day: str = S.VALUE_DATE, exact: bool = True,
                    stored: bool = False, daily: DataFrame | None = None) -> DataFrame:
    """Amount and daily-count statistics per combination in one table."""
    return lookup(fit_amount_stats(df, keys, exact, stored), fit_count_stats(df, keys, day, daily), keys)


def amount_norm(amount: Column, median: Column, iqr: Column) -> Column:
    return (X.signed_log1p(amount) - median) / F.greatest(iqr, F.lit(APPLY_FLOOR))


def count_norm(count: Column, median: Column, iqr: Column, iqr_floor: float = COUNT_FLOOR,
               clip: tuple[float, float] = (-10.0, 10.0)) -> Column:
    norm = (F.log1p(count.cast("double")) - median) / F.greatest(iqr, F.lit(iqr_floor))
    return F.greatest(F.lit(clip[0]), F.least(F.lit(clip[1]), norm))


def amount_from_norm(norm: Column, median: Column, iqr: Column) -> Column:
    """Inverse of the normalised amount; unseen combinations use median 0 and IQR 1."""
    return X.inv_signed_log1p(norm * F.coalesce(iqr, F.lit(1.0)) + F.coalesce(median, F.lit(0.0)))


def count_from_norm(norm: Column, median: Column, iqr: Column, iqr_floor: float = COUNT_FLOOR) -> Column:
    return F.greatest(F.lit(0.0), F.expm1(norm * F.greatest(iqr, F.lit(iqr_floor)) + median))


def with_fallback(df: DataFrame, stats: DataFrame, fallback: DataFrame, cols: list[str], keys: list[str],
                  stored: bool) -> tuple[DataFrame, list[Column]]:
    """Rows with the named statistics of their key, else those of the one-row fallback, as columns to use."""
    own = stats.select(*keys, *[F.col(c).alias(f"__own_{c}") for c in cols])
    joined = with_scalars(attach(df, own, keys, stored), fallback.select(*cols))
    return joined, [F.coalesce(f"__own_{c}", f"__g.{c}") for c in cols]


def normalize_amount(df: DataFrame, stats: DataFrame, fallback: DataFrame | str, keys: list[str] = S.KEYS,
                     stored: bool = False) -> DataFrame:
    """Add ``y_norm``, the signed log amount in robust units of its combination.

    ``fallback`` is the one-row training table, or ``"batch"`` for the median and IQR of the rows being scored.
    """
    if isinstance(fallback, str):
        logs = {name: X.signed_log1p for name in QUARTILES}
        q = percentiles(df, [], "amount", QUARTILES, maps=logs)
        fallback = q.select(F.col("q50").alias("median_log"),
                            F.greatest(F.col("q75") - F.col("q25"), F.lit(FIT_FLOOR)).alias("iqr_log"))
    joined, (median, iqr) = with_fallback(df, stats, fallback, ["median_log", "iqr_log"], keys, stored)
    return joined.select(*df.columns, amount_norm(F.col("amount"), median, iqr).alias("y_norm"))


def add_count_norm(df: DataFrame, stats: DataFrame, fallback: DataFrame, keys: list[str] = S.KEYS,
                   day: str = S.VALUE_DATE, iqr_floor: float = COUNT_FLOOR, clip: tuple[float, float] = (-10.0, 10.0),
                   stored: bool = False) -> DataFrame:
    """Add the daily count of each row's combination in robust units, clipped."""
    if "trans_count_day" not in df.columns:
        df = group_context(df, [*keys, day], {"trans_count_day": F.count(F.lit(1))})
    joined, (median, iqr) = with_fallback(df, stats, fallback, ["count_median_log", "count_iqr_log"], keys, stored)
    norm = count_norm(F.col("trans_count_day"), median, iqr, iqr_floor, clip)
    return joined.select(*df.columns, norm.alias("count_norm"))


def invert_amount(df: DataFrame, stats: DataFrame, pred: str = "y_norm_pred", out: str = "amount_pred",
                  keys: list[str] = S.KEYS, stored: bool = False) -> DataFrame:
    """Amount that a predicted ``y_norm`` stands for."""
    joined = attach(df, stats.select(*keys, "median_log", "iqr_log"), keys, stored)
    value = amount_from_norm(F.col(pred), F.col("median_log"), F.col("iqr_log"))
    return joined.select(*df.columns, value.alias(out))


def invert_count(df: DataFrame, stats: DataFrame, fallback: DataFrame, pred: str = "count_norm_pred",
                 out: str = "trans_count_day_pred", keys: list[str] = S.KEYS, iqr_floor: float = COUNT_FLOOR,
                 stored: bool = False) -> DataFrame:
    """Daily count that a predicted ``count_norm`` stands for, never negative."""
    joined, (median, iqr) = with_fallback(df, stats, fallback, ["count_median_log", "count_iqr_log"], keys, stored)
    return joined.select(*df.columns, count_from_norm(F.col(pred), median, iqr, iqr_floor).alias(out))


def row_weights(df: DataFrame, stats: DataFrame, keys: list[str] = S.KEYS, stored: bool = False) -> DataFrame:
    """Weights that favour small amounts and rare combinations, with mean 1."""
    joined = attach(df, stats.select(*keys, F.col("count").alias("__c")), keys, stored)
    raw = 1.0 / (F.log1p(F.abs("amount")) + 1.0) / F.sqrt(F.coalesce("__c", F.lit(1)) + 1.0)
    weighted = joined.withColumn("row_weight", raw)
    scaled = with_scalars(weighted, weighted.agg(F.avg("row_weight").alias("m")))
    return scaled.select(*df.columns, (F.col("row_weight") / (F.col("__g.m") + 1e-9)).alias("row_weight"))


def col_weights(features: list[str], y_norm: float = 5.0, other: float = 1.0,
                count_norm: float | None = None) -> dict[str, float]:
    """Weight per reconstructed column, the normalised amount last."""
    weights = {c: other for c in features}
    if count_norm is not None and "count_norm" in weights:
        weights["count_norm"] = count_norm
    return {**weights, "y_norm": y_norm}


def matrix_weights(numeric: list[str], category: list[str], cat: float = 0.20, amount: float = 8.0,
                   zscore: float = 2.0) -> dict[str, float]:
    """Weights of the matrix variant: categories low, the amount and the z-score high, other numbers 1."""
    special = {"amount": amount, "amount_scaled": amount, "zscore_amount_30d": zscore}
    return {**{c: special.get(c, 1.0) for c in numeric}, **{c: cat for c in category}}


def combo_frequency(df: DataFrame, keys: list[str] = S.KEYS) -> DataFrame:
    """Rows per combination; missing keys form a group."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("combo_total_count"))


def volume_baseline(df: DataFrame, keys: list[str] = S.KEYS, day: str = "day") -> DataFrame:
    """Mean, standard deviation and number of active days of the daily count per combination."""
    daily = daily_counts(df, keys, day)
    return daily.groupBy(*keys).agg(
        F.avg("count_day").alias("mean_daily_count"), F.stddev_samp("count_day").alias("std_daily_count"),
        F.count(F.lit(1)).alias("active_days"))


def lookup_with_global(df: DataFrame, table: DataFrame, fallback: DataFrame, keys: list[str], col: str,
                       out: str, stored: bool = False) -> DataFrame:
    """Value of the row's key, else the global value."""
    joined = attach(df, table.select(*keys, F.col(col).alias("__own")), keys, stored)
    joined = with_scalars(joined, fallback.select(F.col(col).alias("v")))
    return joined.select(*df.columns, F.coalesce("__own", "__g.v").alias(out))


def lookup_checked(df: DataFrame, table: DataFrame, keys: list[str], null_safe: bool = False) -> DataFrame:
    """Left join that fails when the table holds a key twice."""
    names = [c for c in table.columns if c not in keys]
    merged = table.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("__copies"), *[F.first(c).alias(c) for c in names])
    checked = merged.withColumn(
        "__copies", F.when(F.col("__copies") > 1, F.raise_error(F.lit("baseline has duplicate keys"))).otherwise(1))
    out = spread_lookup(df, checked, keys, null_safe=null_safe)
    # The guard takes part in a value that is kept, so that it is evaluated.
    return out.withColumn(names[0], F.when(F.col("__copies").isNotNull(), F.col(names[0]))).drop("__copies")


def one_match(df: DataFrame, table: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Left join to the last matching row per key; the row count never grows."""
    names = [c for c in table.columns if c not in keys]
    row = F.struct(*order, *[c for c in names if c not in order])
    last = table.groupBy(*keys).agg(F.max(row).alias("__row"))
    last = last.select(*keys, *[F.col(f"__row.{c}").alias(c) for c in names])
    return spread_lookup(df, last, keys)


def mark_anomalies(df: DataFrame, anomalies: DataFrame, on: list[str], error: str = "recon_error") -> DataFrame:
    """Add ``is_anomaly`` and the error of the matching anomaly (the largest one when several match)."""
    found = anomalies.groupBy(*on).agg(F.max(error).alias(error))
    joined = spread_lookup(df, found, on)
    return joined.withColumn("is_anomaly", F.col(error).isNotNull().cast("int"))


def new_pairs(recent: DataFrame, history: DataFrame, cols: list[str]) -> DataFrame:
    """Distinct pairs of the recent rows that history does not hold."""
    return recent.select(*cols).distinct().join(history.select(*cols).distinct(), cols, "left_anti")
