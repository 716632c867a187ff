"""Business rules: each adds flag and reason columns to the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import scalars as X
from .baselines import daily_counts, lookup_checked, volume_baseline
from ..storage import stage
from .skew import lookup, positions, spread_lookup

# The three wordings of the non-business-day reason (posting label, value label, sentence).
WORDINGS = {
    "short": ("Posting date", "Value date", "{label} {day} is a {why}."),
    "long": ("Posting date", "Value date", "{label} {day} is a non-business day ({why})."),
    "column": ("PostingDate", "ValueDate", "{label} {day} is a non-business day ({why})."),
}


def _combo_text(keys: list[str], code_label: str = "TxnCode") -> Column:
    a, b, c = (F.coalesce(F.col(k).cast("string"), F.lit("None")) for k in keys)
    return F.concat(F.lit("Account='"), a, F.lit("', BU='"), b, F.lit(f"', {code_label}='"), c, F.lit("'"))


def _sentence(pattern: str, label: str, day: Column, why: str) -> Column:
    before, after = pattern.split("{day}")
    fill = {"label": label, "why": why}
    return F.concat(F.lit(before.format(**fill)), F.date_format(day, "yyyy-MM-dd"), F.lit(after.format(**fill)))


def flag_non_business_days(df: DataFrame, value_col: str = S.VALUE_DATE, posting_col: str = S.POSTING_DATE,
                           holidays: Sequence | DataFrame | None = None, wording: str = "long") -> DataFrame:
    """Weekend or holiday on either date; the reason names the posting date first.

    ``holidays`` is a list of dates or a one-column table of them (bounded by the calendar, so it is broadcast).
    """
    value, posting = X.parse_date_key(F.col(value_col)), X.parse_date_key(F.col(posting_col))
    out = df.withColumns({"__v": value, "__p": posting})
    for d in ("__v", "__p"):
        if isinstance(holidays, DataFrame):
            days = holidays.select(F.col(holidays.columns[0]).cast("date").alias(d)).distinct()
            out = lookup(out, days.withColumn(f"{d}_h", F.lit(True)), [d], hint=True)
        elif holidays:
            out = out.withColumn(f"{d}_h", F.col(d).isin([F.lit(h).cast("date") for h in holidays]))
        else:
            out = out.withColumn(f"{d}_h", F.lit(False))
        out = out.withColumns({f"{d}_h": F.coalesce(f"{d}_h", F.lit(False)),
                               f"{d}_w": F.coalesce(F.weekday(d) >= 5, F.lit(False))})
    post_label, value_label, pattern = WORDINGS[wording]
    reason = (
        F.when(F.col("__p_w"), _sentence(pattern, post_label, F.col("__p"), "weekend"))
        .when(F.col("__p_h"), _sentence(pattern, post_label, F.col("__p"), "holiday"))
        .when(F.col("__v_w"), _sentence(pattern, value_label, F.col("__v"), "weekend"))
        .when(F.col("__v_h"), _sentence(pattern, value_label, F.col("__v"), "holiday"))
        .otherwise("")
    )
    return out.select(
        *df.columns, (F.col("__v_w") | F.col("__v_h")).cast("int").alias("is_nonbiz_value"),
        (F.col("__p_w") | F.col("__p_h")).cast("int").alias("is_nonbiz_post"), reason.alias("nonbiz_reason"))


def flag_posting_value_mismatch(df: DataFrame, value_col: str = S.VALUE_DATE, posting_col: str = S.POSTING_DATE,
                                keys: list[str] = S.KEYS) -> DataFrame:
    """Both dates readable and different."""
    value, posting = X.parse_date_key(F.col(value_col)), X.parse_date_key(F.col(posting_col))
    differs = F.coalesce(value != posting, F.lit(False))
    text = F.concat(F.lit("Posting date "), F.date_format(posting, "yyyy-MM-dd"), F.lit(" differs from value date "),
                    F.date_format(value, "yyyy-MM-dd"), F.lit(" for "), _combo_text(keys), F.lit("."))
    return df.withColumns({"is_posting_value_diff": differs.cast("int"),
                           "posting_diff_reason": F.when(differs, text).otherwise("")})


def flag_first_combo_transactions(df: DataFrame, baseline: DataFrame, keys: list[str] = S.KEYS) -> DataFrame:
    """Combinations history holds at most once; missing keys match missing keys."""
    joined = spread_lookup(df, baseline.select(*keys, F.col("combo_total_count").alias("__seen")), keys,
                           null_safe=True)
    seen = F.coalesce("__seen", F.lit(0))
    text = F.concat(F.lit("This appears to be the first transaction for combination ("), _combo_text(keys),
                    F.lit(") in historical data (count="), seen.cast("string"), F.lit(")."))
    return joined.select(*df.columns, seen.alias("hist_combo_count"), (seen <= 1).cast("int").alias("is_first_combo_txn"),
                         F.when(seen <= 1, text).otherwise("").alias("first_combo_reason"))


def with_day(df: DataFrame, day_col: str, out: str = "__day") -> DataFrame:
    """Add the readable date, with one far date standing for the unreadable ones so that they join."""
    return df.withColumn(out, F.coalesce(X.parse_date_key(F.col(day_col)), F.lit("9999-12-31").cast("date")))


def flag_daily_volume_spikes(df: DataFrame, keys: list[str] = S.KEYS, posting_col: str = S.POSTING_DATE,
                             min_history_days: int = 5, zscore_threshold: float = 3.0) -> DataFrame:
    """Days whose count is above mean + z * std of all days of the combination."""
    dated = with_day(df, posting_col)
    daily = daily_counts(dated, keys, "__day").withColumnRenamed("count_day", "group_count_today")
    stats = volume_baseline(dated, keys, "__day")
    joined = lookup(daily, stats, keys)
    std = F.coalesce("std_daily_count", F.lit(0.0))
    count, mean = F.col("group_count_today"), F.col("mean_daily_count")
    spike = (F.col("active_days") >= min_history_days) & F.when(std > 0, count > mean + zscore_threshold * std).otherwise(
        count > mean)
    text = F.concat(F.lit("On "), F.date_format("__day", "yyyy-MM-dd"), F.lit(", there were "), count.cast("string"),
                    F.lit(" transactions for ("), _combo_text(keys), F.lit("), vs typical "), X.fixed(mean, 2),
                    F.lit("±"), X.fixed(std, 2), F.lit(" per day."))
    scored = joined.select(
        *keys, "__day", "group_count_today", "mean_daily_count", std.alias("std_daily_count"), "active_days",
        spike.cast("int").alias("is_volume_spike"), F.when(spike, text).otherwise("").alias("volume_spike_reason"))
    return spread_lookup(dated, scored, [*keys, "__day"]).drop("__day")


def apply_simple_rules(df: DataFrame, keys: list[str] = S.KEYS, holidays=None, min_history_days: int = 5,
                       zscore_threshold: float = 3.0) -> DataFrame:
    """Non-business days and daily volume spikes together."""
    flagged = flag_non_business_days(df, holidays=holidays, wording="short")
    return flag_daily_volume_spikes(flagged, keys, min_history_days=min_history_days, zscore_threshold=zscore_threshold)


def _padded_percentile(counts: Column, width: Column, p: float) -> Column:
    """Percentile of the counts of active days padded with zeros to ``width`` days (at most the horizon)."""
    zeros = F.array_repeat(F.lit(0).cast("long"), F.greatest(width - F.size(counts), F.lit(0)).cast("int"))
    ordered = F.array_sort(F.concat(zeros, counts))
    at = F.lit(p) * (width - 1)
    low = F.get(ordered, F.floor(at).cast("int")).cast("double")
    high = F.get(ordered, F.ceil(at).cast("int")).cast("double")
    return F.when(width > 0, low + (high - low) * (at - F.floor(at)))


def _spike_columns(framed: DataFrame, keys: list[str], method: str, horizon: int, z_k: float, pct: float,
                   min_days: int) -> DataFrame:
    """Flag and reason from a daily table with sums over the trailing window of ``__w`` calendar days."""
    if method not in ("zscore", "percentile"):
        raise ValueError("method must be zscore or percentile")
    w, s, s2 = F.col("__w"), F.coalesce("__s", F.lit(0)), F.coalesce("__s2", F.lit(0))
    mean = F.when(w > 0, s / w)
    std = F.when(w > 1, F.sqrt(F.greatest(F.lit(0.0), (s2 - s * s / w) / (w - 1))))
    stats = framed.withColumns({
        "hist_mean_30d": F.coalesce(mean, F.lit(0.0)), "hist_std_30d": F.coalesce(std, F.lit(0.0)),
        "hist_pctl_30d": F.coalesce(_padded_percentile(F.col("__c"), w, pct), F.lit(0.0)),
        "hist_active_days": F.coalesce("__a", F.lit(0)),
    })
    count, m, sd, q = (F.col(c) for c in ("group_count_today", "hist_mean_30d", "hist_std_30d", "hist_pctl_30d"))
    if method == "zscore":
        over = F.when(sd > 0, count > m + z_k * sd).otherwise(count > m)
        typical = F.when(sd > 0, X.fixed(m + z_k * sd, 2)).otherwise(F.concat(X.fixed(m, 2), F.lit(" (std≈0)")))
    else:
        over, typical = count > q, X.fixed(q, 2)
    flag = (F.col("hist_active_days") >= min_days) & over
    text = F.concat(F.lit("Txn volume spike: "), count.cast("string"), F.lit(" today vs typical "), typical,
                    F.lit(" for "), _combo_text(keys, "Code"), F.lit(f" (last {horizon}d)."))
    return stats.select(*keys, "__day", "group_count_today", "hist_mean_30d", "hist_std_30d", "hist_pctl_30d",
                        "hist_active_days", flag.cast("int").alias("vol_spike_flag"),
                        F.when(flag, text).otherwise("").alias("vol_spike_reason"))


def flag_rolling_volume_spikes(df: DataFrame, keys: list[str] = S.KEYS, posting_col: str = S.POSTING_DATE,
                               method: str = "zscore", horizon_days: int = 30, z_k: float = 3.0, pct: float = 0.99,
                               min_history_days: int = 7) -> DataFrame:
    """Daily count against the trailing window of earlier days, empty days counting as zero.

    The missing days need no calendar table: sums over the active days and the number of calendar days are enough.
    """
    dated = with_day(df, posting_col)
    daily = daily_counts(dated, keys, "__day").withColumnRenamed("count_day", "group_count_today")
    numbered = daily.withColumn("__d", F.unix_date("__day"))
    key = Window.partitionBy(*keys).orderBy("__d")
    trail = key.rangeBetween(-horizon_days, -1)
    count = F.col("group_count_today")
    first = F.min("__d").over(key.rowsBetween(Window.unboundedPreceding, 0))
    framed = numbered.withColumns({
        "__s": F.sum(count).over(trail), "__s2": F.sum(count * count).over(trail),
        "__a": F.count(count).over(trail), "__c": F.collect_list(count).over(trail),
        "__w": F.least(F.lit(horizon_days), F.col("__d") - first),
    })
    scored = _spike_columns(framed, keys, method, horizon_days, z_k, pct, min_history_days)
    return spread_lookup(dated, scored, [*keys, "__day"]).drop("__day")


def flag_spikes_from_history(df: DataFrame, history: DataFrame, keys: list[str] = S.KEYS,
                             posting_col: str = S.POSTING_DATE, method: str = "zscore", horizon_days: int = 30,
                             z_k: float = 3.0, pct: float = 0.99, min_active_days: int = 7) -> DataFrame:
    """Like the rolling rule, with the earlier days taken from stored daily counts (keys, day, count)."""
    dated = with_day(df, posting_col)
    today = daily_counts(dated, keys, "__day").withColumnRenamed("count_day", "group_count_today")
    past = history.select(*keys, F.col("day").alias("__day"), F.col("count").alias("__h"))
    both = today.unionByName(past, allowMissingColumns=True).withColumn("__d", F.unix_date("__day"))
    trail = Window.partitionBy(*keys).orderBy("__d").rangeBetween(-horizon_days, -1)
    h = F.col("__h")
    framed = both.withColumns({
        "__s": F.sum(h).over(trail), "__s2": F.sum(h * h).over(trail), "__a": F.count(h).over(trail),
        "__c": F.collect_list(h).over(trail), "__w": F.lit(horizon_days),
    }).filter("group_count_today is not null")
    scored = _spike_columns(framed, keys, method, horizon_days, z_k, pct, min_active_days)
    return spread_lookup(dated, scored, [*keys, "__day"]).drop("__day")


def flag_extra_transactions(df: DataFrame, baseline: DataFrame, order_by: list[str], keys: list[str] = S.KEYS,
                            posting_col: str = S.POSTING_DATE, min_history_days: int = 5,
                            zscore_threshold: float = 3.0) -> DataFrame:
    """Flag the last rows of a day beyond the whole-number threshold of its combination.

    Statistics are filled for the groups with extra rows only, and ``group_key`` names such a group; the rows to
    review with it come from ``review_transactions``.
    """
    dated = with_day(df, posting_col)
    daily = daily_counts(dated, keys, "__day").withColumnRenamed("count_day", "group_count_today")
    joined = lookup_checked(daily, baseline.select(*keys, "mean_daily_count", "std_daily_count", "active_days"), keys)
    filled = joined.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("mean_daily_count", "std_daily_count", "active_days")})
    mean, std = F.col("mean_daily_count"), F.col("std_daily_count")
    limit = F.when(std > 0, mean + zscore_threshold * std).otherwise(mean)
    whole = F.greatest(F.lit(1).cast("long"), F.bround(limit, 0).cast("long"))
    extra = F.when(F.col("active_days") >= min_history_days,
                   F.greatest(F.lit(0).cast("long"), F.col("group_count_today") - whole)).otherwise(0)
    over = filled.withColumns({"threshold_int": whole, "extra_txn": extra}).filter("extra_txn > 0")
    names = ["group_count_today", "mean_daily_count", "std_daily_count", "active_days", "threshold_int", "extra_txn"]
    rows = stage(spread_lookup(dated, over.select(*keys, "__day", *names), [*keys, "__day"]), "extra")

    # Only groups with extra rows are ordered.
    busy = positions(rows.filter("extra_txn is not null"), [*keys, "__day"], [f"-{c}" for c in order_by], "__pos")
    last = F.col("__pos") <= F.col("extra_txn")
    text = F.concat(
        F.lit("This transaction is one of "), F.col("extra_txn").cast("string"), F.lit(" extra txns above the typical "),
        F.col("threshold_int").cast("string"), F.lit(" per day for ("), _combo_text(keys), F.lit("). Today had "),
        F.col("group_count_today").cast("string"), F.lit(" txns; baseline≈"), X.fixed(mean, 2), F.lit("±"),
        X.fixed(std, 2), F.lit("."))
    group = F.concat_ws("|", *keys, F.date_format("__day", "yyyyMMdd"))
    flagged = busy.select(
        *df.columns, *names[:4], last.cast("int").alias("is_volume_spike_txn"),
        F.when(last, text).otherwise("").alias("volume_spike_reason"), F.when(last, group).otherwise("").alias("group_key"))
    quiet = rows.filter("extra_txn is null").select(
        *df.columns, F.lit(0).cast("long").alias(names[0]), F.lit(0.0).alias(names[1]), F.lit(0.0).alias(names[2]),
        F.lit(0).cast("long").alias(names[3]), F.lit(0).alias("is_volume_spike_txn"),
        F.lit("").alias("volume_spike_reason"), F.lit("").alias("group_key"))
    return flagged.unionByName(quiet)


def review_transactions(df: DataFrame, flagged: DataFrame, keys: list[str] = S.KEYS,
                        posting_col: str = S.POSTING_DATE, id_col: str = S.TXN_ID) -> DataFrame:
    """Every transaction of the group-days that hold a flagged row, as (group_key, id) rows."""
    dated = with_day(df, posting_col)
    named = dated.select(F.concat_ws("|", *keys, F.date_format("__day", "yyyyMMdd")).alias("group_key"), id_col)
    groups = flagged.filter("group_key <> ''").groupBy("group_key").agg(F.lit(1).alias("__hit"))
    return spread_lookup(named, groups, ["group_key"]).filter("__hit = 1").drop("__hit")


def combine_reasons_columns(df: DataFrame, reason_cols: list[str], out_col: str = "anomaly_reason") -> DataFrame:
    """One numbered text of the reasons that are not blank."""
    texts = F.array(*[F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) for c in reason_cols if c in df.columns])
    parts = F.filter(texts, lambda t: t != "")
    numbered = F.transform(parts, lambda t, i: F.concat((i + 1).cast("string"), F.lit(") "), t))
    return df.withColumn(out_col, F.concat_ws(" ", numbered))


def any_rule(df: DataFrame, flags: list[str], cols: list[str] | None = None) -> DataFrame:
    """Rows with at least one rule flag set."""
    hit = F.lit(False)
    for c in flags:
        hit = hit | (F.coalesce(F.col(c).cast("int"), F.lit(0)) == 1)
    return df.filter(hit).select(*(cols or df.columns))
