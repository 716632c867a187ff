"""Id maps, category encoders, scalers and grouped clipping: fit gives a table, apply joins it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import scalars as X
from ..storage import stage
from .skew import lookup, percentiles, positions, spread_lookup, with_scalars


def fit_id_map(df: DataFrame, col: str, oov: str = S.OOV) -> DataFrame:
    """Sorted distinct values numbered from 0, and one id after them for unseen values."""
    values = df.select(F.col(col).cast("string").alias("value")).filter(f"value <> '{oov}'").distinct()
    ids = positions(stage(values, "values"), [], ["value"], "id").select("value", (F.col("id") - 1).alias("id"))
    last = values.agg(F.count(F.lit(1)).alias("id")).select(F.lit(oov).alias("value"), "id")
    return ids.unionByName(last)


def apply_id_map(df: DataFrame, col: str, id_map: DataFrame, out: str, oov: str = S.OOV,
                 stored: bool = False) -> DataFrame:
    """Id of each value, the reserved id for unseen ones; fails when the map reserves none."""
    table = id_map.select(F.col("value").alias("__value"), F.col("id").alias(out))
    keyed = df.withColumn("__value", F.col(col).cast("string"))
    joined = spread_lookup(keyed if stored else stage(keyed, "keyed"), table, ["__value"])
    reserve = id_map.filter(F.col("value") == oov).select("id").scalar()
    missing = F.raise_error(F.lit(f"id map has no {oov}")).cast("long")
    return joined.drop("__value").withColumn("__oov", reserve).withColumn(
        out, F.when(F.col("__oov").isNull(), missing).otherwise(F.coalesce(out, "__oov"))).drop("__oov")


def fit_combo_map(df: DataFrame, keys: list[str] = S.KEYS) -> DataFrame:
    return fit_id_map(df.select(X.combo_key(*[F.col(k) for k in keys]).alias("combo")), "combo")


def apply_combo_map(df: DataFrame, id_map: DataFrame, keys: list[str] = S.KEYS, out: str = "combo_id",
                    stored: bool = False) -> DataFrame:
    named = df.withColumn("__combo", X.combo_key(*[F.col(k) for k in keys]))
    return apply_id_map(named, "__combo", id_map, out, stored=stored).drop("__combo")


def decode_ids(df: DataFrame, col: str, id_map: DataFrame, out: str) -> DataFrame:
    """Value of each id, null for an unknown id."""
    table = id_map.select(F.col("id").cast("long").alias("__id"), F.col("value").alias(out))
    return spread_lookup(df.withColumn("__id", F.col(col).cast("long")), table, ["__id"]).drop("__id")


def vocab_sizes(dfs: list[DataFrame], cols: list[str]) -> DataFrame:
    """One row: largest id plus one per column over all splits, at least 1."""
    tops = None
    for df in dfs:
        part = df.agg(*[F.max(c).alias(c) for c in cols])
        tops = part if tops is None else tops.unionByName(part)
    return tops.agg(*[F.greatest(F.lit(1).cast("long"), F.coalesce(F.max(c) + 1, F.lit(1)).cast("long")).alias(c)
                      for c in cols])


def check_ids(df: DataFrame, sizes: DataFrame, cols: list[str], where: str = "") -> DataFrame:
    """Pass the rows on, failing on an id outside its vocabulary."""
    out = with_scalars(df, sizes)
    for c in cols:
        bad = (F.col(c) < 0) | (F.col(c) >= F.col(f"__g.{c}"))
        out = out.withColumn(c, F.when(bad, F.raise_error(F.lit(f"{c} out of range {where}"))).otherwise(F.col(c)))
    return out.select(*df.columns)


def hash_bin(col: str, bins: int) -> Column:
    """md5 of ``column||token`` modulo the number of bins, folded four hex digits at a time."""
    digest = F.md5(F.concat(F.lit(f"{col}||"), F.col(col).cast("string")))
    rest = F.lit(0).cast("long")
    for i in range(0, 32, 4):
        rest = (rest * 65536 + F.conv(F.substring(digest, i + 1, 4), 16, 10).cast("long")) % bins
    return rest.cast("int")


class CategoryEncoder:
    """Category columns to numbers: ``onehot``, ``ordinal``, ``binary`` or ``hybrid`` (one-hot or hashed bins).

    Column names must be known when the plan is built, so the values of one-hot columns reach the driver; a column
    with more than ``max_columns`` values is refused there.
    """

    def __init__(self, kind: str, max_onehot: int = 10, hash_bins: int = 32, max_columns: int = 1000):
        if kind not in ("onehot", "ordinal", "binary", "hybrid"):
            raise ValueError(f"unknown encoder {kind}")
        self.kind, self.max_onehot, self.hash_bins, self.max_columns = kind, max_onehot, hash_bins, max_columns
        self.maps: dict[str, DataFrame] = {}
        self.values: dict[str, list[str]] = {}
        self.hashed: list[str] = []
        self.bits: dict[str, int] = {}

    def fit(self, df: DataFrame, cols: list[str]) -> "CategoryEncoder":
        self.cols = cols
        sizes = df.agg(*[F.count_distinct(F.coalesce(F.col(c).cast("string"), F.lit("nan"))).alias(c) for c in cols]).first()
        for c in cols:
            if self.kind == "hybrid" and sizes[c] > self.max_onehot:
                self.hashed.append(c)
            elif self.kind in ("onehot", "hybrid"):
                if sizes[c] > self.max_columns:
                    raise ValueError(f"{c} has {sizes[c]} values, too many for one-hot columns")
                rows = df.select(F.col(c).cast("string").alias("v")).distinct().filter("v is not null").collect()
                self.values[c] = sorted(r.v for r in rows)
            else:
                self.maps[c] = stage(fit_id_map(df, c), "id-map")
                self.bits[c] = max(1, int(sizes[c]).bit_length())
        return self

    def feature_names(self) -> list[str]:
        names = []
        for c in self.cols:
            if c in self.values:
                names += [f"{c}_{v}" for v in self.values[c]]
            elif c in self.hashed:
                names += [f"{c}__hash_{i}" for i in range(self.hash_bins)]
            elif self.kind == "binary":
                names += [f"{c}_{i}" for i in range(self.bits[c])]
            else:
                names.append(f"{c}_code")
        return names

    def transform(self, df: DataFrame) -> DataFrame:
        out, added = df, []
        for c in self.cols:
            if c in self.values:
                added += [F.coalesce(F.col(c).cast("string") == v, F.lit(False)).cast("int").alias(f"{c}_{v}")
                          for v in self.values[c]]
            elif c in self.hashed:
                out = out.withColumn(f"__bin_{c}", hash_bin(c, self.hash_bins))
                added += [(F.col(f"__bin_{c}") == i).cast("int").alias(f"{c}__hash_{i}") for i in range(self.hash_bins)]
            else:
                seen = self.maps[c].filter(F.col("value") != S.OOV)
                seen = seen.select(F.col("value").alias("__value"), F.col("id").alias(f"__id_{c}"))
                out = spread_lookup(out.withColumn("__value", F.col(c).cast("string")), seen, ["__value"]).drop("__value")
                code = F.coalesce(F.col(f"__id_{c}"), F.lit(-1))
                if self.kind == "ordinal":
                    added.append(code.alias(f"{c}_code"))
                else:
                    n = self.bits[c]
                    added += [F.shiftright(code + 1, n - 1 - i).bitwiseAND(F.lit(1)).cast("int").alias(f"{c}_{i}")
                              for i in range(n)]
        return out.select(*df.columns, *added)


class Standardizer:
    """Centre and scale chosen columns by the population deviation, optionally after log1p; others pass."""

    def __init__(self, cols: list[str], log: bool = False):
        self.cols, self.log = cols, log

    def _in(self, c: str) -> Column:
        return F.log1p(c) if self.log else F.col(c).cast("double")

    def fit(self, df: DataFrame) -> "Standardizer":
        self.stats = stage(df.agg(*[F.avg(self._in(c)).alias(f"m_{c}") for c in self.cols],
                                  *[F.stddev_pop(self._in(c)).alias(f"s_{c}") for c in self.cols]), "scale")
        return self

    def _scale(self, c: str) -> Column:
        s = F.col(f"__g.s_{c}")
        return F.when(s == 0, 1.0).otherwise(s)

    def transform(self, df: DataFrame) -> DataFrame:
        out = with_scalars(df, self.stats)
        scaled = {c: F.coalesce((self._in(c) - F.col(f"__g.m_{c}")) / self._scale(c), F.lit(0.0)) for c in self.cols}
        return out.withColumns(scaled).drop("__g")

    def inverse(self, df: DataFrame) -> DataFrame:
        out = with_scalars(df, self.stats)
        raw = {c: F.col(c) * self._scale(c) + F.col(f"__g.m_{c}") for c in self.cols}
        if self.log:
            raw = {c: F.expm1(v) for c, v in raw.items()}
        return out.withColumns(raw).drop("__g")


class MinMax:
    """Scale columns to 0..1 by their range; missing values become 0 and a constant column 0."""

    def __init__(self, cols: list[str]):
        self.cols = cols

    def fit(self, df: DataFrame) -> "MinMax":
        self.stats = stage(df.agg(*[F.min(c).alias(f"a_{c}") for c in self.cols],
                                  *[F.max(c).alias(f"b_{c}") for c in self.cols]), "range")
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        out = with_scalars(df, self.stats)
        scaled = {}
        for c in self.cols:
            low, span = F.col(f"__g.a_{c}"), F.col(f"__g.b_{c}") - F.col(f"__g.a_{c}")
            scaled[c] = F.coalesce((F.col(c) - low) / F.when(span == 0, 1.0).otherwise(span), F.lit(0.0))
        return out.withColumns(scaled).drop("__g")


def fit_group_bounds(df: DataFrame, keys: list[str], col: str, lo: float = 0.01, hi: float = 0.99,
                     min_rows: int = 10) -> DataFrame:
    """Clip bounds per group: the two percentiles, or the range of a group below ``min_rows``."""
    q = percentiles(df, keys, col, {"p_lo": lo, "p_hi": hi, "low": 0.0, "high": 1.0})
    small = F.col("n") < min_rows
    return q.select(*keys, "n", F.when(small, F.col("low")).otherwise(F.col("p_lo")).alias("lower"),
                    F.when(small, F.col("high")).otherwise(F.col("p_hi")).alias("upper"))


def clip_by_group(df: DataFrame, keys: list[str], col: str, bounds: DataFrame) -> DataFrame:
    """Hold the column within its group's bounds; the bounds stay on the rows as ``lower`` and ``upper``."""
    joined = spread_lookup(df, bounds.select(*keys, "lower", "upper"), keys)
    return joined.withColumn(col, F.greatest(F.col("lower"), F.least(F.col("upper"), F.col(col).cast("double"))))


def clip_counts(df: DataFrame, keys: list[str], col: str, bounds: DataFrame) -> DataFrame:
    """One row: how many values lie outside, below and above their group's bounds."""
    joined = spread_lookup(df, bounds.select(*keys, "lower", "upper"), keys)
    below, above = F.count_if(F.col(col) < F.col("lower")), F.count_if(F.col(col) > F.col("upper"))
    return joined.agg((below + above).alias("outside"), below.alias("below"), above.alias("above"))


def minmax_by_group(df: DataFrame, keys: list[str], col: str, bounds: DataFrame) -> DataFrame:
    """Clip, then scale each group to 0..1; a constant group becomes 0."""
    clipped = clip_by_group(df, keys, col, bounds)
    share = F.try_divide(F.col(col) - F.col("lower"), F.col("upper") - F.col("lower"))
    return clipped.withColumn(col, F.coalesce(share, F.lit(0.0))).drop("lower", "upper")


def heavy_tail_prep(df: DataFrame) -> DataFrame:
    """log1p of the amount features (negatives as 0) and signed log of the net amount."""
    logs = {c: F.log1p(F.greatest(F.col(c), F.lit(0.0))) for c in S.DAY_AMOUNTS}
    return df.withColumns({**logs, "net_amount": X.signed_log1p(F.col("net_amount"))})
