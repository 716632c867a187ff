"""Reading and writing transaction tables, artefacts and event logs."""

from __future__ import annotations

import json
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S
from ..operators.cleaning import clean_transactions, normalize_headers


def read_table(spark: SparkSession, path: str, fmt: str | None = None, schema: T.StructType | None = None,
               infer: bool = True) -> DataFrame:
    """Read by extension (parquet, csv, json, orc) or by the given format; ``infer=False`` reads CSV as text."""
    fmt = fmt or os.path.splitext(path.rstrip("/"))[1].lstrip(".") or "parquet"
    reader = spark.read if schema is None else spark.read.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True).option("multiLine", True).option("escape", '"')
        if schema is None:
            reader = reader.option("inferSchema", infer)
    return reader.format(fmt).load(path)


def read_transactions(spark: SparkSession, path: str, fmt: str | None = None, drop_dupes: bool = True,
                      order_by: list[str] | None = None) -> DataFrame:
    """Read only the columns the library needs and clean them. Ids, codes and dates stay text, as written."""
    raw = normalize_headers(read_table(spark, path, fmt, infer=False))
    if dict(raw.dtypes).get(S.AMOUNT) == "string":
        raw = raw.withColumn(S.AMOUNT, F.col(S.AMOUNT).try_cast("double"))
    wanted = [c for c in (S.TXN_ID, *S.REQUIRED, S.CURRENCY) if c in raw.columns]
    order = order_by if order_by is not None else [c for c in (S.POSTING_DATE, S.VALUE_DATE) if c in wanted]
    return clean_transactions(raw.select(*wanted), drop_dupes, order)


def read_clients(spark: SparkSession, root: str) -> DataFrame:
    """Every parquet file below the client folders; the client is the last ``_`` part of the folder name."""
    files = spark.read.parquet(os.path.join(root, "[!_.]*"))
    folder = F.element_at(F.split(F.input_file_name(), "/"), -2)
    return files.withColumn("Client", F.upper(F.element_at(F.split(F.url_decode(folder), "_"), -1)))


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: list[str] = ()) -> None:
    """Write a result; an empty result still carries its columns."""
    writer = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True).option("escape", '"')
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def event_message(stage: Column, status: Column, payload: Column, response: Column) -> Column:
    """One JSON message with the four parts of an event."""
    return F.to_json(F.struct(stage.alias("stage"), status.alias("status"),
                              payload.alias("input_payload"), response.alias("response")))


def append_event(df: DataFrame, path: str) -> None:
    """Append one JSON message per row of (stage, status, input_payload, response)."""
    message = event_message(F.col("stage"), F.col("status"), F.col("input_payload"), F.col("response"))
    df.select(message.alias("log_entry")).write.mode("append").parquet(path)


class Artifacts:
    """Fitted tables (parquet) and settings (one JSON row) saved together and loaded once."""

    TABLES = ("combo_stats", "global_stats", "profile", "thresholds", "id_map")

    def __init__(self, tables: dict[str, DataFrame], meta: dict):
        self.tables, self.meta = tables, meta

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]

    def save(self, path: str) -> None:
        for name, table in self.tables.items():
            write_table(table, f"{path}/{name}")
        spark = next(iter(self.tables.values())).sparkSession
        spark.createDataFrame([(json.dumps(self.meta),)], "value string").coalesce(1).write.mode("overwrite").text(
            f"{path}/meta")

    @classmethod
    def load(cls, spark: SparkSession, path: str, tables: tuple[str, ...] = TABLES,
             defaults: dict | None = None) -> "Artifacts":
        lines = spark.read.text(f"{path}/meta").collect()
        if len(lines) != 1:
            raise ValueError(f"no settings under {path}")
        meta = {**(defaults or {}), **json.loads(lines[0].value)}
        return cls({t: spark.read.parquet(f"{path}/{t}") for t in tables}, meta)
