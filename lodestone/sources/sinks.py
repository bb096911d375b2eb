"""Sinks: CSV safe for spreadsheets, JSON, Parquet, and an append log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T


def write_csv(df: DataFrame, path: str) -> None:
    """All columns as text; values that a spreadsheet would run get a quote before them."""
    df.select(*(F.when(F.col(c).isNotNull(), T.csv_safe(c)).alias(c) for c in df.columns)).write.csv(path, header=True, mode="errorifexists")


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    df.write.parquet(path, mode="errorifexists", partitionBy=partition_by, compression="snappy")


def write_json(df: DataFrame, path: str) -> None:
    df.write.json(path, mode="errorifexists", ignoreNullFields=False)


def append_log(df: DataFrame, path: str) -> None:
    df.write.parquet(path, mode="append")


def newest(spark: SparkSession, path: str, key: str, order: str) -> DataFrame:
    """The last row of each key of an append log."""
    log = spark.read.parquet(path)
    return log.groupBy(F.col(key).alias("_k")).agg(F.max_by(F.struct(*log.columns), F.col(order)).alias("row")).select("row.*")
