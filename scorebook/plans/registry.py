"""Registry of named queries and the SQL each can be compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def plain(df: DataFrame) -> DataFrame:
    """Dates as ISO text and decimals as doubles, so any client compares them alike."""
    casts = {}
    for f in df.schema.fields:
        if isinstance(f.dataType, T.DateType):
            casts[f.name] = F.col(f.name).cast("string")
        elif isinstance(f.dataType, T.DecimalType):
            casts[f.name] = F.col(f.name).cast("double")
    return df.withColumns(casts) if casts else df


def query(name: str, sql: str | None = None):
    def keep(fn: Callable[[SparkSession, str], DataFrame]):
        assert name not in QUERIES, name
        QUERIES[name] = lambda spark, d: plain(fn(spark, d))
        if sql is not None:
            SQL[name] = sql
        return fn
    return keep
