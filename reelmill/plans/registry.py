"""Where queries and the SQL they are held against are collected."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function as the query of its name; sql gives the same rows in DuckDB."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, *columns: str, digits: int = 9) -> DataFrame:
    """Shares and means to nine decimals: the order of adding shows beyond."""
    return df.withColumns({c: F.round(F.col(c), digits) for c in columns})


def r9(c: Column) -> Column:
    return F.round(c, 9)
