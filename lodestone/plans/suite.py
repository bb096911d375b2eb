"""Named queries over the driver's tables, and the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import cleaning, governing, integration, matching, profiling, ranking, records

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
for module in (ranking, profiling, matching, integration, cleaning, records, governing):
    QUERIES |= module.QUERIES
    ORACLE_SQL |= module.ORACLE_SQL
