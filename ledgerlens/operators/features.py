"""Row and daily-group features of bank transactions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import scalars as X
from .skew import group_context

TINY_MEAN = 1e-6

BASIC_FEATURES = [
    "posting_lag_days", "dow", "is_weekend", "month", "quarter", "cashbook_flag_derived",
    "month_sin", "month_cos", "dow_sin", "dow_cos", "log_amount",
    "amount_dev_loo_log", "amount_ratio_loo_slog", "identical_amounts_in_group",
    "single_transaction_group", "amount_sign",
]


CALENDAR = ["dow", "is_weekend", "day_of_month", "month", "quarter", "month_sin", "month_cos", "dow_sin", "dow_cos"]


def calendar_columns(day: Column) -> dict[str, Column]:
    """Calendar parts of a date, and month and weekday on circles."""
    parts = X.calendar(day)
    month_sin, month_cos = X.cyclical(parts["month"], 12)
    dow_sin, dow_cos = X.cyclical(parts["dow"], 7)
    return {**parts, "month_sin": month_sin, "month_cos": month_cos, "dow_sin": dow_sin, "dow_cos": dow_cos}


def dated_rows(df: DataFrame, lag_clamp: int | None = None) -> DataFrame:
    """Add the date, the amount as a number and the posting lag: what costs most to read from the text."""
    value = X.parse_date_key(F.col(S.VALUE_DATE))
    posting = X.parse_date_key(F.col(S.POSTING_DATE))
    dated = df.select("*", value.alias("__value"), posting.alias("__posting"))
    return dated.select(*df.columns, F.coalesce("__posting", "__value").alias("ts"),
                        X.coerce_numeric(F.col(S.AMOUNT)).alias("amount"),
                        X.posting_lag(F.col("__posting"), F.col("__value"), lag_clamp).alias("posting_lag_days"))


def row_columns(keys: list[str] = S.KEYS, wide_cashbook: bool = False) -> dict[str, Column]:
    """The other features that a row of ``dated_rows`` has by itself."""
    amount = F.col("amount")
    return {
        **calendar_columns(F.col("ts")),
        "cashbook_flag_derived": X.cashbook_flag(F.col(S.CASHBOOK), wide_cashbook),
        "log_amount": X.signed_log1p(amount),
        "amount_sign": X.amount_sign(amount),
        "combo_str": X.combo_key(*[F.col(k) for k in keys]),
    }


def row_features(df: DataFrame, keys: list[str] = S.KEYS, lag_clamp: int | None = None,
                 wide_cashbook: bool = False) -> DataFrame:
    """Features of a row by itself: one projection, no shuffle."""
    return dated_rows(df, lag_clamp).withColumns(row_columns(keys, wide_cashbook))


def _leave_one_out(n: Column, total: Column, amount: Column) -> dict[str, Column]:
    mean = F.when(n > 1, (total - amount) / F.greatest(n - 1, F.lit(1))).otherwise(total / n)
    # A mean this small would blow up the ratio; tiny negative means get -TINY_MEAN instead of an infinite ratio.
    guard = F.when(mean < 0, -TINY_MEAN).when(mean > 0, 2 * TINY_MEAN).otherwise(TINY_MEAN)
    safe = F.when(F.abs(mean) < TINY_MEAN, guard).otherwise(mean)
    return {
        "amount_dev_loo_log": F.log1p(F.abs(amount - mean)),
        "amount_ratio_loo_slog": X.signed_log1p(amount / safe),
    }


def group_columns() -> dict[str, Column]:
    """Comparison of ``amount`` with the others of its daily group, given as ``__size`` and ``__sum``."""
    n = F.col("__size")
    return {"trans_count_log": F.log1p(n.cast("double")), **_leave_one_out(n, F.col("__sum"), F.col("amount"))}


def group_flags() -> list[Column]:
    """Flags of a daily group, given as ``__size``, ``__min`` and ``__max``."""
    return [(F.col("__min") == F.col("__max")).cast("int").alias("identical_amounts_in_group"),
            (F.col("__size") == 1).cast("int").alias("single_transaction_group")]


def daily_group_features(df: DataFrame, keys: list[str] = S.KEYS, day: str = S.VALUE_DATE) -> DataFrame:
    """Daily count per key and the comparison of each amount with the others of its day (one grouped pass)."""
    keyed = df.withColumn("__day", F.coalesce(F.col(day).cast("string"), F.lit("")))
    grouped = group_context(keyed, [*keys, "__day"], {
        "__size": F.count(F.lit(1)), "__sum": F.sum("amount"), "__min": F.min("amount"), "__max": F.max("amount")})
    grouped = grouped.withColumn("trans_count_day", F.col("__size")).withColumns(group_columns())
    return grouped.select("*", *group_flags()).drop("__day", "__size", "__sum", "__min", "__max")


def engineer_basic_features(df: DataFrame, keys: list[str] = S.KEYS) -> DataFrame:
    return daily_group_features(row_features(df, keys), keys)


def group_mean_features(df: DataFrame, keys: list[str] = S.KEYS, day: str = S.VALUE_DATE) -> DataFrame:
    """Variant that compares with the mean of the whole group; missing values become 0."""
    amount = F.col(S.AMOUNT)
    value, posting = (X.parse_date_key(F.col(c)) for c in (S.VALUE_DATE, S.POSTING_DATE))
    grouped = group_context(df, [*keys, day], {
        "TransCountPerAccountDay": F.count(S.TXN_ID), "GroupSize": F.count(F.lit(1)),
        "GroupAmountMean": F.avg(amount), "__min": F.min(amount), "__max": F.max(amount),
    })
    mean, size = F.col("GroupAmountMean"), F.col("GroupSize")
    return grouped.withColumns({
        "IsBusinessDay_Value": X.is_business_day(value).cast("int"),
        "IsBusinessDay_Posting": X.is_business_day(posting).cast("int"),
        "Month_Value": F.month(value),
        "IdenticalAmountsInGroup": ((F.col("__min") == F.col("__max")) & (size > 1)).cast("int"),
        "AmountDeviation": F.when(size > 1, F.abs(amount - mean)).otherwise(0.0),
        "SingleTransactionGroup": (size == 1).cast("int"),
        "AmountRatioToGroupMean": F.coalesce(F.try_divide(amount, mean + 1e-8), F.lit(0.0)),
        "AmountSign": X.amount_is_credit(amount),
        "AbsAmount": F.abs(amount),
        "LogAbsAmount": X.log_abs(amount),
    }).drop("__min", "__max")


def same_amount_count(df: DataFrame, keys: list[str] = S.KEYS, day: str = "ts") -> DataFrame:
    """Rows with the same keys, day and amount."""
    keyed = df.withColumn("__day", F.coalesce(F.col(day).cast("string"), F.lit("")))
    counted = group_context(keyed, [*keys, "__day", "amount"],
                            {"same_amount_count_per_day": F.count(F.lit(1))})
    return counted.drop("__day")
