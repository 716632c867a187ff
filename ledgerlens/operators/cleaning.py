"""Header handling, checks, cleaning and de-duplication of transaction tables."""

from __future__ import annotations

import difflib
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import scalars as X
from .skew import with_scalars

# Canonical spelling of the headers the library understands.
CANONICAL = [
    S.ACCOUNT, S.UNIT, S.CODE, S.VALUE_DATE, S.POSTING_DATE, S.AMOUNT, S.TXN_ID,
    "IsCurrentDay", "IsMatched", S.CASHBOOK, "IsCashBook",
]


def normalize_headers(df: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """Rename headers that differ only in case, spaces, dashes or slashes, and back-fill the cash-book flag."""
    known = {c.lower(): c for c in CANONICAL}
    known.update(aliases or {})
    names = [known.get(re.sub(r"[ \-/]", "", c.strip().lower()), c.strip()) for c in df.columns]
    out = df.toDF(*names)
    if S.CASHBOOK not in out.columns and "IsCashBook" in out.columns:
        out = out.withColumn(S.CASHBOOK, F.col("IsCashBook"))
    return out


def resolve_columns(df: DataFrame, explicit: dict[str, str] | None = None,
                    wanted: tuple[str, ...] = (*S.KEYS, S.POSTING_DATE, S.VALUE_DATE, S.AMOUNT)) -> dict[str, str]:
    """Find the column meant by each wanted name: given by the caller, else contained, else the closest spelling."""
    explicit = explicit or {}

    def plain(text: str) -> str:
        return re.sub(r"[^a-z0-9]", "", text.lower())

    by_plain = {plain(c): c for c in df.columns}
    found = {}
    for want in wanted:
        if want in explicit:
            if explicit[want] not in df.columns:
                raise KeyError(f"column {explicit[want]!r} given for {want} is not in {df.columns}")
            found[want] = explicit[want]
            continue
        hits = [c for p, c in by_plain.items() if plain(want) in p]
        hits = hits or [by_plain[p] for p in difflib.get_close_matches(plain(want), list(by_plain), 1, 0.6)]
        if not hits:
            raise KeyError(f"no column like {want} in {df.columns}")
        found[want] = hits[0]
    return found


def require_columns(df: DataFrame, columns: list[str] = S.REQUIRED) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns {missing}, found {df.columns}")
    return df


def clean_transactions(df: DataFrame, drop_dupes: bool = True, order_by: list[str] | None = None) -> DataFrame:
    """Check required columns, drop repeated transaction ids and tidy the category columns."""
    out = df.toDF(*[c.strip() for c in df.columns])
    require_columns(out)
    if drop_dupes and S.TXN_ID in out.columns:
        out = dedupe_by_id(out, S.TXN_ID, order_by)
    tidy = [S.ACCOUNT, S.CODE, S.UNIT, S.CASHBOOK]
    return out.withColumns({c: X.clean_category(F.col(c)) for c in tidy})


def dedupe_by_id(df: DataFrame, id_col: str = S.TXN_ID, order_by: list[str] | None = None,
                 keep: str = "first") -> DataFrame:
    """One row per id: the first (or last) in the given order, other columns breaking ties.

    A ranked window of which only the first row is kept: each task drops its own repeats before the one shuffle, so rows
    that share an id, or have none, do not travel together.
    """
    return dedupe_rows(df, [id_col], order_by, keep)


def dedupe_rows(df: DataFrame, cols: list[str] | None = None, order_by: list[str] | None = None,
                keep: str = "last") -> DataFrame:
    """One row for each value of ``cols``: the last (or first) in the given order, other columns breaking ties."""
    if cols is None:
        return df.distinct()
    order = [*(order_by or []), *[c for c in df.columns if c not in (order_by or []) and c not in cols]]
    sides = [F.col(c).asc() if keep == "first" else F.col(c).desc() for c in order] or [F.lit(1)]
    ranked = df.withColumn("__rn", F.row_number().over(Window.partitionBy(*cols).orderBy(*sides)))
    return ranked.filter("__rn = 1").drop("__rn")


def drop_incomplete(df: DataFrame, cols: list[str], date_cols: tuple[str, ...] = (S.VALUE_DATE, S.POSTING_DATE)
                    ) -> DataFrame:
    """Rows with every key column present and every date readable."""
    out = df.dropna(subset=cols)
    for c in date_cols:
        out = out.filter(X.parse_date_key(F.col(c)).isNotNull())
    return out


def nonzero_deals(df: DataFrame) -> DataFrame:
    return df.filter((F.col("BuyAmount") != 0) & (F.col("SellAmount") != 0))


def burn_in_filter(df: DataFrame, minimum: int, col: str = "txn_count_30d") -> DataFrame:
    return df.filter(F.col(col) >= minimum)


def last_n_days(df: DataFrame, n: int, col: str = "txn_date") -> DataFrame:
    """Rows of the newest ``n`` distinct dates (the n dates form a bounded broadcast)."""
    days = df.select(col).distinct().orderBy(F.desc(col)).limit(n)
    return df.join(F.broadcast(days), col, "left_semi")


def align_features(df: DataFrame, features: list[str], carry: list[str] = ()) -> DataFrame:
    """Carry columns plus the features in order; features that are missing or null become 0."""
    cols = [
        F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) if c in df.columns else F.lit(0.0).alias(c)
        for c in features
    ]
    return df.select(*carry, *cols)


def exclude_features(features: list[str], ignored: set[str]) -> list[str]:
    return [c for c in features if c not in ignored]


def validate_account_day(df: DataFrame) -> DataFrame:
    """Issues of an account-day table as (issue, n_rows); one pass over the data, no row when all is well."""
    spark = df.sparkSession
    missing = [c for c in S.DAY_IDS + S.DAY_FEATURES if c not in df.columns]
    if missing:
        return spark.range(1).select(
            F.lit(f"missing columns: {', '.join(missing)}").alias("issue"), F.lit(len(missing)).cast("long").alias("n_rows"))

    def bad(c: Column) -> Column:
        return F.count_if(F.coalesce(c, F.lit(False)))

    nums = [F.col(c).cast("double") for c in S.DAY_FEATURES]
    checks = {
        "txn_count not positive": bad(F.col("txn_count") <= 0),
        "credit_count + debit_count differs from txn_count":
            bad(F.col("credit_count") + F.col("debit_count") != F.col("txn_count")),
    }
    for name, num in zip(S.DAY_FEATURES, nums):
        checks[f"missing values in {name}"] = F.count_if(num.isNull() | F.isnan(num))
        checks[f"infinite values in {name}"] = bad(F.abs(num) == float("inf"))
    pairs = F.array(*[F.struct(F.lit(k).alias("issue"), v.alias("n_rows")) for k, v in checks.items()])
    return df.agg(pairs.alias("p")).select(F.inline("p")).filter("n_rows > 0")


def clean_account_day(df: DataFrame) -> DataFrame:
    """Recompute the two ratios and turn missing or infinite numbers into 0."""
    fixed = df.withColumns({
        "BU_concentration_ratio": F.try_divide(F.col("top_bu_txn_count"), F.col("txn_count")),
        "credit_debit_ratio": F.try_divide(F.col("credit_count"), F.col("credit_count") + F.col("debit_count")),
    })

    def finite(name: str) -> Column:
        x = F.col(name).try_cast("double")
        return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x)

    return fixed.withColumns({c: finite(c) for c in S.DAY_FEATURES})


def drop_zero_variance(df: DataFrame, cols: list[str], minimum: float = 1e-9) -> list[str]:
    """Names of the columns that vary (one aggregate; the driver receives one row)."""
    row = df.agg(*[F.stddev_samp(c).alias(c) for c in cols]).first()
    return [c for c in cols if row[c] is not None and row[c] > minimum]


def scale_by(df: DataFrame, stats: DataFrame, formula: dict[str, Column]) -> DataFrame:
    """Apply expressions that refer to a one-row statistics table as ``__g``."""
    return with_scalars(df, stats).withColumns(formula).drop("__g")


def validate_requests(df: DataFrame, client: str) -> tuple[DataFrame, DataFrame]:
    """Check typed deal requests; good rows are cast, bad rows carry their errors and a status code.

    400 for a missing or unreadable field, 500 for another client or a date that is not ``yyyy-MM-dd``.
    """
    texts = ["Client", "FX_Instrument_Type", "BUnit", "Cpty", "PrimaryCurr", "BuyCurr", "SellCurr", "UniqueId"]
    numbers = ["BuyAmount", "SellAmount", "SpotRate", "ForwardPoints"]
    dates = ["DealDate", "MaturityDate"]
    require_columns(df, texts + numbers + dates)
    field_errors = [F.when(F.col(c).isNull(), F.lit(f"{c}: missing")) for c in texts + dates]
    field_errors += [F.when(F.col(c).try_cast("double").isNull(), F.lit(f"{c}: not a number")) for c in numbers]
    if "ContLeg" in df.columns:
        bad_leg = F.col("ContLeg").isNotNull() & F.col("ContLeg").try_cast("int").isNull()
        field_errors.append(F.when(bad_leg, F.lit("ContLeg: not a whole number")))
    late_errors = [F.when(F.col("Client") != client, F.lit(f"Client: expected {client}"))]
    late_errors += [
        F.when(F.col(c).isNotNull() & F.try_to_date(F.col(c).cast("string"), "yyyy-MM-dd").isNull(),
               F.lit(f"{c}: not a date")) for c in dates
    ]
    checked = df.withColumn("__f", F.array_compact(F.array(*field_errors)))
    checked = checked.withColumn("errors", F.concat("__f", F.array_compact(F.array(*late_errors))))
    code = F.when(F.size("__f") > 0, 400).when(F.size("errors") > 0, 500).otherwise(200)
    checked = checked.withColumn("status_code", code).drop("__f")
    good = checked.filter("status_code = 200").drop("errors")
    good = good.withColumns({c: F.col(c).cast("double") for c in numbers})
    good = good.withColumns({c: F.to_date(F.col(c).cast("string"), "yyyy-MM-dd") for c in dates})
    return good, checked.filter("status_code <> 200")


def valid_message(col: Column) -> Column:
    """1 to 64 letters and digits."""
    return F.coalesce(col.rlike(r"^[\p{L}\p{N}]{1,64}$"), F.lit(False))
