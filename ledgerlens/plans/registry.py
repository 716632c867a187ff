"""Named example queries with the SQL text that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under a name, with equivalent SQL where there is one."""
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return add


# Moves exact decimal ties (a mean of cents over 32 rows) off the rounding border, in Spark and in the SQL alike.
NUDGE = 3e-9


def present(df: DataFrame, *cols: str, digits: int = 6, nudge: list[str] = (), **rounded: int) -> DataFrame:
    """Columns for comparison: whole numbers as bigint, doubles rounded, dates as text."""
    out = []
    for c in cols or df.columns:
        kind = df.schema[c].dataType
        col = F.col(c)
        if isinstance(kind, (T.IntegerType, T.ShortType, T.ByteType, T.BooleanType, T.LongType)):
            col = col.cast("bigint")
        elif isinstance(kind, (T.DoubleType, T.FloatType, T.DecimalType)):
            value = F.round(col.cast("double") + (NUDGE if c in nudge else 0.0), rounded.get(c, digits))
            col = F.when(value == 0, F.lit(0.0)).otherwise(value)
        elif isinstance(kind, T.DateType):
            col = F.date_format(col, "yyyy-MM-dd")
        elif isinstance(kind, T.TimestampType):
            col = F.date_format(col, "yyyy-MM-dd HH:mm:ss")
        out.append(col.alias(c))
    return df.select(*out)
