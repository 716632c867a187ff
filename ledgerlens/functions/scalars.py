"""Column expressions: amounts, dates, keys, flags and text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that count as a missing category, a missing reference and a set cash-book flag.
BLANKS = ["", "nan", "NaN", "None", "NULL", "null"]
NO_REFERENCE = ["", "0", "nan", "NaN"]
CASHBOOK_YES = ["cashbook", "y", "yes", "1", "true"]


def clean_category(col: Column) -> Column:
    text = F.trim(col.cast("string"))
    return F.when(text.isNull() | text.isin(BLANKS), "UNK").otherwise(text)


def parse_date_key(col: Column) -> Column:
    """``YYYYMMDD`` text or number to a date, anything else to null.

    Eight plain digits are cast as an ISO date, which costs less than the pattern's parser; the rest is left to that.
    """
    text = col.cast("string")
    iso = F.concat_ws("-", F.substring(text, 1, 4), F.substring(text, 5, 2), F.substring(text, 7, 2))
    plain = text.rlike("^[1-9][0-9]{7}\\z")
    return F.when(plain, iso.try_cast("date")).otherwise(F.try_to_date(text, "yyyyMMdd"))


def coerce_numeric(col: Column) -> Column:
    number = col.try_cast("double")
    return F.when(number.isNull() | F.isnan(number), 0.0).otherwise(number)


def signed_log1p(col: Column) -> Column:
    return F.signum(col) * F.log1p(F.abs(col))


def inv_signed_log1p(col: Column) -> Column:
    return F.signum(col) * F.expm1(F.abs(col))


def log_abs(col: Column) -> Column:
    return F.log1p(F.abs(col))


def amount_sign(col: Column) -> Column:
    return F.signum(col).cast("int")


def amount_is_credit(col: Column) -> Column:
    return (col >= 0).cast("int")


def calendar(day: Column) -> dict[str, Column]:
    """Calendar parts; Monday is 0."""
    return {
        "dow": F.weekday(day),
        "is_weekend": (F.weekday(day) >= 5).cast("int"),
        "day_of_month": F.dayofmonth(day),
        "month": F.month(day),
        "quarter": F.quarter(day),
    }


def cyclical(col: Column, period: float) -> tuple[Column, Column]:
    angle = F.lit(2.0) * F.pi() * (col.cast("double") / F.lit(float(period)))
    return F.sin(angle), F.cos(angle)


def posting_lag(posting: Column, value: Column, clamp: int | None = None) -> Column:
    lag = F.coalesce(F.datediff(posting, value), F.lit(0))
    return lag if clamp is None else F.greatest(F.lit(-clamp), F.least(F.lit(clamp), lag))


def combo_key(*cols: Column) -> Column:
    return F.concat_ws("|", *cols)


def split_combo(col: Column) -> list[Column]:
    parts = F.split(col, r"\|")
    return [F.get(parts, i) for i in range(3)]


def magnitude_bucket(col: Column) -> Column:
    """Order of magnitude, -9 for amounts that are practically zero, held within -9..9."""
    size = F.abs(col)
    power = F.floor(F.log10(size + 1e-9)).cast("int")
    return F.when(size < 1e-9, -9).otherwise(F.greatest(F.lit(-9), F.least(F.lit(9), power)))


def is_business_day(day: Column) -> Column:
    return F.coalesce(F.weekday(day) < 5, F.lit(False))


def cashbook_flag(col: Column, wide: bool = False) -> Column:
    """1 for "cashbook"; ``wide`` also accepts y / yes / 1 / true."""
    text = F.lower(F.trim(col.cast("string")) if wide else col.cast("string"))
    return F.coalesce(text.isin(CASHBOOK_YES if wide else CASHBOOK_YES[:1]), F.lit(False)).cast("int")


def matched_ref_flag(col: Column) -> Column:
    text = F.coalesce(F.trim(col.cast("string")), F.lit("nan"))
    return (~text.isin(NO_REFERENCE)).cast("int")


def current_day_flag(col: Column) -> Column:
    return F.coalesce(col.try_cast("int"), F.lit(0))


def tenor_days(deal: Column, maturity: Column) -> Column:
    return F.datediff(maturity, deal)


def face_value(primary: Column, buy_curr: Column, sell_curr: Column, buy: Column, sell: Column) -> Column:
    """Amount on the side of the primary currency, 0 when it is on neither side."""
    side = F.when(primary == buy_curr, F.abs(buy)).when(primary == sell_curr, F.abs(sell))
    return F.coalesce(side, F.lit(0.0))


def difference(pred: Column, actual: Column) -> tuple[Column, Column]:
    """Absolute and relative difference."""
    gap = F.abs(pred - actual)
    return gap, gap / (F.abs(actual) + 1e-9)


def range_flag(col: Column, lower: Column, upper: Column) -> Column:
    """0 inside the learned range, 1 outside it (or where no range is known)."""
    return F.when(col.between(lower, upper), 0).otherwise(1)


def match_key(ts: Column, combo: Column, amount: Column, digits: int = 2) -> Column:
    number = F.round(amount, digits).cast(f"decimal(38,{digits})").cast("string")
    return F.concat_ws("|", F.date_format(ts, "yyyy-MM-dd"), combo, number)


def month_name(month: Column) -> Column:
    return F.date_format(F.make_date(F.lit(2000), month.cast("int"), F.lit(1)), "MMM")


def weekday_name(dow: Column) -> Column:
    """Mon..Sun for 0..6 (2000-01-03 was a Monday)."""
    return F.date_format(F.date_add(F.lit("2000-01-03").cast("date"), dow.cast("int")), "EEE")


def format_rupees(col: Column) -> Column:
    return F.concat(F.lit("₹"), F.format_number(col, 2))


def whole(col: Column) -> Column:
    """Whole-number text, rounding half to even."""
    return F.bround(col.cast("double"), 0).cast("long").cast("string")


def fixed(col: Column, digits: int) -> Column:
    """Fixed-point text without thousands separators."""
    return F.format_string(f"%.{digits}f", col.cast("double"))


def squared_percent_error(actual: Sequence[Column], pred: Sequence[Column]) -> Column:
    """Mean over the columns of the squared relative error."""
    parts = [F.pow((p - a) / F.greatest(F.abs(a), F.lit(1e-9)), 2) for a, p in zip(actual, pred)]
    return sum(parts[1:], parts[0]) / F.lit(float(len(parts)))


def range_weighted_error(actual: Sequence[Column], pred: Sequence[Column], ranges: Sequence[Column]) -> Column:
    """Mean over the columns of the absolute error in percent of the column's range (at least 1)."""
    parts = [
        F.abs(p - a) * 100.0 / F.greatest(r, F.lit(1.0)) for a, p, r in zip(actual, pred, ranges)
    ]
    return sum(parts[1:], parts[0]) / F.lit(float(len(parts)))
