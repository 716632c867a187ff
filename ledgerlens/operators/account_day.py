"""Account-day features, type attribution, consensus and scoring contexts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..storage import stage
from .skew import column_medians, lookup, percentiles, running, with_scalars


def account_day(df: DataFrame, day: str = "ts", amount: str = "amount", account: str = S.ACCOUNT,
                currency: str = S.CURRENCY, unit: str = S.UNIT, code: str = S.CODE) -> DataFrame:
    """One row per account, date and currency with the 17 numeric features.

    Sums and counts combine on the map side. The distinct counts read a table already reduced to (key, unit, code),
    so no row is expanded for them. The few columns needed are stored first, so what leads to the rows runs once.
    """
    keys = [account, "txn_date", currency]
    rows = stage(df.select(account, F.col(day).alias("txn_date"), currency, unit, code, amount), "day-rows")
    size, credit = F.abs(F.col(amount)), F.col(amount) >= 0
    zero = F.lit(0.0)
    sums = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("txn_count"), F.sum(size).alias("amount_sum"), F.avg(size).alias("amount_mean"),
        F.max(size).alias("amount_max"), F.stddev_pop(size).alias("amount_stddev"),
        F.count_if(credit).alias("credit_count"), F.count_if(~credit).alias("debit_count"),
        F.sum(F.when(credit, size).otherwise(zero)).alias("credit_amount_sum"),
        F.sum(F.when(credit, zero).otherwise(size)).alias("debit_amount_sum"),
        F.count_if(F.weekday("txn_date") >= 5).alias("weekend_txn_count"))
    parts = rows.groupBy(*keys, unit, code).agg(F.count(F.lit(1)).alias("c"))
    units = parts.groupBy(*keys, unit).agg(F.sum("c").alias("c")).groupBy(*keys).agg(
        F.count(unit).alias("unique_BU_count"), F.max("c").alias("top_bu_txn_count"))
    codes = parts.groupBy(*keys).agg(F.count_distinct(code).alias("unique_txn_code_count"))
    out = lookup(lookup(sums, units, keys), codes, keys)
    out = out.withColumns({
        "BU_concentration_ratio": F.col("top_bu_txn_count") / F.col("txn_count"),
        "unique_currency_count": F.lit(1),
        "credit_debit_ratio": F.col("credit_count") / (F.col("credit_count") + F.col("debit_count")),
        "net_amount": F.col("credit_amount_sum") - F.col("debit_amount_sum"),
    })
    return out.select(*keys, *[F.col(c).cast("double").alias(c) for c in S.DAY_FEATURES])


def data_profile(df: DataFrame, account: str = S.ACCOUNT, day: str = "txn_date") -> DataFrame:
    """(measure, n, mean, std, min, q25, q50, q75, max) of rows per account, accounts per day and txn_count."""
    per_account = df.groupBy(account).agg(F.count(F.lit(1)).alias("value"))
    per_day = df.groupBy(day).agg(F.count(F.lit(1)).alias("value"))
    named = [("rows per account", per_account), ("accounts active per day", per_day),
             ("txn_count", df.select(F.col("txn_count").alias("value")))]
    parts = [d.select(F.lit(n).alias("measure"), F.col("value").cast("double")) for n, d in named]
    long = parts[0].unionByName(parts[1]).unionByName(parts[2])
    q = percentiles(long, ["measure"], "value", {"min": 0.0, "q25": 0.25, "q50": 0.5, "q75": 0.75, "max": 1.0})
    moments = long.groupBy("measure").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))
    return lookup(moments, q, ["measure"]).select("measure", "n", "mean", "std", "min", "q25", "q50", "q75", "max")


def attribution_quantities() -> dict[str, Column]:
    """Derived quantities the anomaly types are judged on."""
    return {
        "a_txn_count": F.col("txn_count"),
        "a_amount_max": F.log1p(F.greatest(F.col("amount_max"), F.lit(0.0))),
        "a_amount_sum": F.log1p(F.greatest(F.col("amount_sum"), F.lit(0.0))),
        "a_net_amount_abs": F.log1p(F.abs("net_amount")),
        "a_unique_BU_count": F.col("unique_BU_count"),
        "a_BU_concentration_ratio": F.col("BU_concentration_ratio"),
        "a_unique_txn_code_count": F.col("unique_txn_code_count"),
        "a_weekend_ratio": F.col("weekend_txn_count") / F.greatest(F.col("txn_count"), F.lit(1.0)),
        "a_one_sidedness": F.abs(F.col("credit_debit_ratio") - 0.5) * 2,
    }


# Anomaly type and the quantity that shows it, in order of preference.
TYPE_RULES = [
    ("volume_spike", "txn_count"), ("large_amount", "amount_max"), ("large_amount", "amount_sum"),
    ("net_flow_extreme", "net_amount_abs"), ("bu_diversity", "unique_BU_count"),
    ("bu_concentration", "BU_concentration_ratio"), ("code_diversity", "unique_txn_code_count"),
    ("weekend_activity", "weekend_ratio"), ("one_sided_flow", "one_sidedness"),
]


class TypeAttributor:
    """Names the anomaly type of a row by its largest robust deviation from its account's history."""

    def __init__(self, accounts: DataFrame, overall: DataFrame, z_flag: float, account: str):
        self.accounts, self.overall, self.z_flag, self.account = accounts, overall, z_flag, account

    @classmethod
    def fit(cls, train: DataFrame, min_account_rows: int = 30, z_flag: float = 3.0, account: str = S.ACCOUNT
            ) -> "TypeAttributor":
        """Median and spread per account (an account has at most one row per day and currency) and overall."""
        quantities = attribution_quantities()
        names = list(quantities)
        rows = stage(train.select(account, *[c.cast("double").alias(n) for n, c in quantities.items()]), "attribution")
        medians = rows.groupBy(account).agg(
            F.count(F.lit(1)).alias("n"), F.avg("a_weekend_ratio").alias("weekend_habit"),
            *[F.median(c).alias(f"med_{c}") for c in names])
        gaps = lookup(rows, medians.select(account, *[f"med_{c}" for c in names]), [account])
        spreads = gaps.groupBy(account).agg(*[F.median(F.abs(F.col(c) - F.col(f"med_{c}"))).alias(f"mad_{c}") for c in names])
        accounts = lookup(medians, spreads, [account]).withColumn("known", (F.col("n") >= min_account_rows).cast("int"))

        center = column_medians(rows, [], names)
        around = with_scalars(rows, center).select(*[F.abs(F.col(c) - F.col(f"__g.{c}")).alias(c) for c in names])
        spread = column_medians(stage(around, "gaps"), [], names)
        overall = with_scalars(center, spread).select(
            *[F.col(c).alias(f"med_{c}") for c in names], *[F.col(f"__g.{c}").alias(f"mad_{c}") for c in names])
        return cls(stage(accounts.drop("n"), "accounts"), stage(overall, "overall"), z_flag, account)

    def label(self, df: DataFrame) -> DataFrame:
        """Add anomaly_type, top_feature, top_z and baseline_scope."""
        quantities = attribution_quantities()
        joined = lookup(df.withColumns(quantities), self.accounts, [self.account])
        joined = with_scalars(joined, self.overall)
        known = F.coalesce(F.col("known"), F.lit(0)) == 1
        habit = F.coalesce("weekend_habit", F.lit(1.0))
        entries = []
        for i, (kind, name) in enumerate(TYPE_RULES):
            c = f"a_{name}"
            wide = F.col(f"__g.mad_{c}")
            med = F.when(known, F.col(f"med_{c}")).otherwise(F.col(f"__g.med_{c}"))
            mad = F.when(known, F.col(f"mad_{c}")).otherwise(wide)
            scale = F.greatest(1.4826 * mad, 0.25 * 1.4826 * wide, F.lit(0.05))
            z = F.greatest(F.lit(-50.0), F.least(F.lit(50.0), (F.col(c) - med) / scale))
            allowed = habit < 0.05 if kind == "weekend_activity" else F.lit(True)
            entries.append(F.when((z >= self.z_flag) & allowed, F.struct(
                z.alias("z"), F.lit(-i).alias("i"), F.lit(kind).alias("kind"), F.lit(name).alias("name"))))
        # The largest z wins, the earlier rule on a tie.
        best = joined.withColumn("__best", F.array_max(F.array_compact(F.array(*entries))))
        return best.select(
            *df.columns, F.coalesce("__best.kind", F.lit("unusual_combination")).alias("anomaly_type"),
            F.col("__best.name").alias("top_feature"), F.coalesce(F.bround("__best.z", 2), F.lit(0.0)).alias("top_z"),
            F.when(known, "account").otherwise("global").alias("baseline_scope"))


def type_counts(flags: DataFrame) -> DataFrame:
    """(model, flagged, by_type): flagged rows per model with a map of type to count."""
    counts = flags.groupBy("model", "anomaly_type").agg(F.count(F.lit(1)).alias("c"))
    return counts.groupBy("model").agg(
        F.sum("c").alias("flagged"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("anomaly_type", "c")))).alias("by_type"))


def consensus(flags: DataFrame, models: list[str], report_types: tuple[str, ...] = ()) -> DataFrame:
    """One row per flagged row id: how many models agree, modal type and feature, largest z, and a score per model."""
    kept = flags.filter(F.col("anomaly_type").isin(*report_types)) if report_types else flags
    return kept.groupBy("row_id").agg(
        F.count("model").alias("n_models_flagged"), F.mode("anomaly_type", True).alias("anomaly_type"),
        F.mode("top_feature", True).alias("top_feature"), F.max("top_z").alias("max_top_z"),
        F.min_by("baseline_scope", "model").alias("baseline_scope"),
        *[F.max(F.when(F.col("model") == m, F.col("score"))).alias(f"score_{m}") for m in models])


def analyst_review(rows: DataFrame, agreed: DataFrame, row_id: str) -> DataFrame:
    """Flagged rows with their raw features, strongest agreement first."""
    joined = lookup(agreed.withColumnRenamed("row_id", row_id), rows, [row_id])
    return joined.orderBy(F.desc("n_models_flagged"), F.desc("max_top_z"), row_id)


def water_fill(sizes: DataFrame, cap: int, by: list[str], account: str = S.ACCOUNT, size: str = "n") -> DataFrame:
    """Rows each account may contribute under a cap: smallest histories first, what they leave goes to the others.

    Smallest first, an account is kept whole while its size fits an equal share of what is left; from the first that
    does not fit, the rest share the remainder equally and the last ones take the odd rows. Both parts follow from
    running sums, so nothing is allocated one account at a time.
    """
    ranked = running(sizes, by, [size, account], {"used": ("sum", F.col(size).cast("long")), "i": ("sum", F.lit(1).cast("long"))},
                     totals=True)
    left = F.col("i_total") - F.col("i")
    fits = (F.col("used_total") <= cap) | (F.col(size) <= F.floor((F.lit(cap) - F.col("used")) / left))
    ranked = ranked.withColumn("fits", fits)
    whole = F.sum(F.when(F.col("fits"), F.col(size)).otherwise(0)).alias("kept")
    n_whole = F.count_if("fits").alias("k")
    shared = ranked.groupBy(*by).agg(whole, n_whole, F.count(F.lit(1)).alias("m"))
    out = lookup(ranked, shared, by) if by else with_scalars(ranked, shared).select("*", "__g.*").drop("__g")
    rest, budget = F.col("m") - F.col("k"), F.lit(cap) - F.col("kept")
    share = F.floor(budget / F.greatest(rest, F.lit(1)))
    odd = (F.col("i") - F.col("k") >= rest - (budget - share * rest)).cast("long")
    alloc = F.when(F.col("fits"), F.col(size)).otherwise(share + odd)
    return out.select(*sizes.columns, alloc.cast("long").alias("alloc"))


def build_context(day: DataFrame, history: DataFrame, cap: int | None = None, policy: str = "newest",
                  account: str = S.ACCOUNT, date: str = "txn_date", tie: tuple[str, ...] = ()) -> DataFrame:
    """History of the accounts in ``day``: all of it, or under a cap the newest rows or a fair share per account."""
    present = lookup(history, day.select(account).distinct(), [account], how="left_semi")
    if cap is None:
        return present
    if policy == "newest":
        return present.orderBy(F.desc(date), *tie).limit(cap)
    sizes = present.groupBy(account).agg(F.count(F.lit(1)).alias("n"))
    shares = water_fill(stage(sizes, "sizes"), cap, [], account).select(account, "alloc")
    # An account has at most one row per day and currency, so the window is bounded by the calendar.
    newest = Window.partitionBy(account).orderBy(F.desc(date), *tie)
    ranked = lookup(present, shares, [account]).withColumn("__rn", F.row_number().over(newest))
    return ranked.filter(F.col("__rn") <= F.col("alloc")).drop("__rn", "alloc")


def gaussian_score(features: list[str], mean: str = "m_{}", std: str = "s_{}", floor: float = 1e-6) -> Column:
    """Negative log-likelihood of the features under independent normals."""
    parts = []
    for c in features:
        s = F.greatest(F.col(std.format(c)), F.lit(floor))
        parts.append(0.5 * F.pow((F.col(c) - F.col(mean.format(c))) / s, 2) + F.log(s) + 0.5 * math.log(2 * math.pi))
    return sum(parts[1:], parts[0])


def context_score(test: DataFrame, history: DataFrame, features: list[str], cap: int | None = None, min_context: int = 50,
                  account: str = S.ACCOUNT, date: str = "txn_date", tie: tuple[str, ...] = (S.CURRENCY,)) -> DataFrame:
    """Score each row against the history of the accounts active on its day, capped if asked; thin days get no score.

    The newest k rows of an account enter a day's mean and variance, so running sums per account answer every
    (day, account, k) with one lookup instead of copying history rows to each day.
    """
    newest = Window.partitionBy(account).orderBy(F.desc(date), *tie)
    upto = newest.rowsBetween(Window.unboundedPreceding, 0)
    sums = history.select(
        account, F.row_number().over(newest).cast("long").alias("alloc"),
        *[F.sum(c).over(upto).alias(f"x_{c}") for c in features],
        *[F.sum(F.col(c) * F.col(c)).over(upto).alias(f"y_{c}") for c in features])
    sizes = history.groupBy(account).agg(F.count(F.lit(1)).alias("n"))
    pairs = lookup(test.select(date, account).distinct(), sizes, [account], how="inner")
    if cap is None:
        shares = pairs.select(*pairs.columns, F.col("n").cast("long").alias("alloc"))
    else:
        shares = water_fill(stage(pairs, "pairs"), cap, [date], account).filter("alloc > 0")
    joined = lookup(shares, sums, [account, "alloc"])
    n = F.sum("alloc")
    stats = joined.groupBy(date).agg(
        n.alias("context_rows"), *[(F.sum(f"x_{c}") / n).alias(f"m_{c}") for c in features],
        *[F.sqrt(F.greatest(F.lit(0.0), (F.sum(f"y_{c}") - F.sum(f"x_{c}") * F.sum(f"x_{c}") / n) / (n - 1))).alias(f"s_{c}")
          for c in features])
    # One row per calendar day, so the statistics are broadcast.
    scored = lookup(test, stats.filter(F.col("context_rows") >= min_context), [date], hint=True)
    return scored.select(*test.columns, "context_rows", gaussian_score(features).alias("context_score"))


def calibrate_context(test: DataFrame, history: DataFrame, features: list[str], rows: int | None = None, p: float = 0.975,
                      account: str = S.ACCOUNT, date: str = "txn_date", tie: tuple[str, ...] = ()) -> DataFrame:
    """Threshold: percentile of the scores of the test accounts' history rows (the newest ``rows`` if given) under themselves."""
    sample = stage(build_context(test, history, rows, "newest", account, date, tie), "calibration")
    stats = sample.agg(*[F.avg(c).alias(f"m_{c}") for c in features], *[F.stddev_samp(c).alias(f"s_{c}") for c in features])
    scored = with_scalars(sample, stats).select(
        gaussian_score(features, "__g.m_{}", "__g.s_{}").alias("score"))
    return percentiles(scored, [], "score", {"threshold": p}).select("threshold")
