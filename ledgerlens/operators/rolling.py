"""Trailing 7- and 30-day baselines that never see the row they describe, and the as-of join to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..storage import stage
from .skew import running, spread_lookup

BASELINE_COLUMNS = [
    "txn_count_7d", "txn_count_30d", "mean_amount_30d", "std_amount_30d", "avg_posting_lag_30d",
]
# Statistics that combine over days: (operator, value).
PARTS = {
    "n": ("sum", lambda a, lag: F.lit(1).cast("long")),
    "s1": ("sum", lambda a, lag: a),
    "s2": ("sum", lambda a, lag: a * a),
    "lo": ("min", lambda a, lag: a),
    "hi": ("max", lambda a, lag: a),
    "lg": ("sum", lambda a, lag: lag.cast("double")),
}
AGG = {"sum": F.sum, "min": F.min, "max": F.max}


def _finish(get) -> dict[str, Column]:
    """Baseline columns from combined parts; ``get(part, days)`` returns the part over the trailing days."""
    n, s1, s2 = get("n", 30), get("s1", 30), get("s2", 30)
    spread = F.sqrt(F.greatest(F.lit(0.0), (s2 - s1 * s1 / n) / (n - 1)))
    std = F.when(n >= 2, F.when(get("lo", 30) == get("hi", 30), 0.0).otherwise(spread))
    return {
        "txn_count_7d": get("n", 7), "txn_count_30d": n, "mean_amount_30d": s1 / n,
        "std_amount_30d": std, "avg_posting_lag_30d": get("lg", 30) / n,
    }


def daily_parts(df: DataFrame, keys: list[str], ts: str = "ts", amount: str = "amount",
                lag: str = "posting_lag_days") -> DataFrame:
    """One row per key and day with the combinable statistics; at most one row per key and calendar day."""
    aggs = [AGG[op](f(F.col(amount), F.col(lag))).alias(p) for p, (op, f) in PARTS.items()]
    return df.groupBy(*keys, ts).agg(*aggs).withColumn("__d", F.unix_date(F.col(ts)))


def rolling_baselines(df: DataFrame, keys: list[str] = S.KEYS, mode: str = "row", tie: list[str] | None = None,
                      ts: str = "ts", amount: str = "amount", lag: str = "posting_lag_days") -> DataFrame:
    """Trailing statistics per key.

    ``mode="day"`` gives one row per key and day over the days before it. ``mode="row"`` gives one row per input row
    over everything up to the previous row in (day, ``tie``) order, inside that row's own trailing window.
    Days are aggregated first, so a window over a key never exceeds the calendar; only the order inside a day needs
    rows, and that is a running aggregate which splits hot days.
    """
    dated = df.filter(F.col(ts).isNotNull())
    days = daily_parts(dated, keys, ts, amount, lag)
    order = Window.partitionBy(*keys).orderBy("__d")
    if mode == "day":
        def over(part: str, n: int) -> Column:
            return AGG[PARTS[part][0]](part).over(order.rangeBetween(-n, -1))

        framed = days.select(*keys, ts, *[over(p, n).alias(f"{p}_{n}") for n in (7, 30) for p in PARTS])
        stats = _finish(lambda p, n: F.col(f"{p}_{n}"))
        counts = {c: F.coalesce(stats[c], F.lit(0)) for c in ("txn_count_7d", "txn_count_30d")}
        return framed.select(*keys, ts, *[c.alias(n) for n, c in {**stats, **counts}.items()])

    if not tie:
        raise ValueError("row mode needs tie-break columns that order the rows of a day")
    pieces, lagged = [], []
    for p, (op, _) in PARTS.items():
        for n in (7, 30):
            pieces.append(AGG[op](p).over(order.rangeBetween(-(n - 1), -1)).alias(f"b_{p}_{n}"))
            lagged.append(AGG[op](p).over(order.rangeBetween(-(n - 1), 0)).alias(f"t_{p}_{n}"))
    framed = days.select(*keys, ts, "__d", *pieces, *lagged)
    for p in PARTS:
        for n in (7, 30):
            framed = framed.withColumn(f"t_{p}_{n}", F.lag(f"t_{p}_{n}").over(order))
    framed = framed.drop("__d")
    inside = running(dated, [*keys, ts], tie,
                     {f"i_{p}": (op, f(F.col(amount), F.col(lag))) for p, (op, f) in PARTS.items()})
    joined = spread_lookup(stage(inside, "inside"), framed, [*keys, ts])
    first = F.col("i_n") == 0

    def get(part: str, n: int) -> Column:
        op = PARTS[part][0]
        before, seen = F.col(f"b_{part}_{n}"), F.col(f"i_{part}")
        if op == "sum":
            both = F.coalesce(before, F.lit(0)) + seen
        else:
            both = (F.least if op == "min" else F.greatest)(before, seen)
        return F.when(first, F.col(f"t_{part}_{n}")).otherwise(both)

    stats = _finish(get)
    return joined.select(*df.columns, *[c.alias(n) for n, c in stats.items()])


def last_per_day(baselines: DataFrame, keys: list[str], ts: str = "ts", order: list[str] = ()) -> DataFrame:
    """The newest baseline of each key and day."""
    values = [c for c in baselines.columns if c not in (*keys, ts)]
    row = F.struct(*order, *[c for c in values if c not in order])
    kept = baselines.groupBy(*keys, ts).agg(F.max(row).alias("__row"))
    return kept.select(*keys, ts, *[F.col(f"__row.{c}").alias(c) for c in values])


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], ts: str, cols: list[str],
              known: str | None = None) -> DataFrame:
    """Newest ``right`` row with the same keys and ``right.ts <= left.ts``; one row per (keys, ts) on the right.

    The answer depends on (keys, ts) alone: the distinct points of the left side and the right side are laid in one
    order, the newest value so far is carried as a running maximum of (ts, values), and rows look their point up, so a
    hot key or day is one point. ``known`` names a flag telling whether the key exists on the right at all.
    """
    carried = F.struct(F.col(ts).alias("__ts"), *cols)
    kind = left.select(*keys, ts).distinct().withColumn("__side", F.lit(1))
    base = right.select(*keys, ts, carried.alias("__base")).withColumn("__side", F.lit(0))
    kind = kind.withColumn("__base", F.lit(None).cast(base.schema["__base"].dataType))
    both = kind.unionByName(base, allowMissingColumns=True)
    seen = running(both, keys, [ts, "__side"],
                   {"__last": ("max", F.col("__base")), "__rows": ("sum", (F.lit(1) - F.col("__side")).cast("long"))},
                   totals=True)
    out = seen.filter("__side = 1")
    extra = [] if known is None else [(F.col("__rows_total") > 0).cast("int").alias(known)]
    points = stage(out.select(*keys, ts, *[F.col(f"__last.{c}").alias(c) for c in cols], *extra), "points")
    return spread_lookup(left, points, [*keys, ts], null_safe=True)


def zscore_30d(df: DataFrame, amount: str = "amount", known: str = "has_baseline", eps: float = 1e-6) -> DataFrame:
    """Distance of the amount from its 30-day baseline in standard deviations.

    A key without any baseline counts as mean 0 and deviation 0; a deviation of 0 gives 0 at the mean and 6 off it;
    a known key without enough history gives 0.
    """
    mean, std = (
        F.when(F.col(known) == 0, 0.0).otherwise(F.col(c)) for c in ("mean_amount_30d", "std_amount_30d")
    )
    gap = F.col(amount) - mean
    flat = F.when(F.abs(gap) <= eps, 0.0).otherwise(6.0)
    z = F.when(std <= eps, flat).otherwise(F.try_divide(gap, std))
    out = df.withColumn("zscore_amount_30d", F.coalesce(z, F.lit(0.0)))
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in BASELINE_COLUMNS})


def merge_with_baselines(df: DataFrame, baselines: DataFrame, keys: list[str] = S.KEYS, ts: str = "ts",
                         order: list[str] = ()) -> DataFrame:
    """As-of merge of the baselines and the z-score of each amount."""
    base = last_per_day(baselines, keys, ts, list(order))
    return zscore_30d(asof_join(df, base, keys, ts, BASELINE_COLUMNS, known="has_baseline"))


def update_baselines(old: DataFrame, new: DataFrame, keys: list[str] = S.KEYS, ts: str = "ts") -> DataFrame:
    """Old and new baselines with one row per key and time, the new one winning."""
    cols = [*keys, ts, *[c for c in old.columns if c not in (*keys, ts)]]
    both = old.select(*cols, F.lit(0).alias("__v")).unionByName(new.select(*cols, F.lit(1).alias("__v")))
    return last_per_day(both, keys, ts, ["__v"]).drop("__v")
