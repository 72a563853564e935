"""Queries by name, with the SQL of the same result where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(build: Query) -> Query:
        QUERIES[name] = build
        if sql is not None:
            SQL[name] = sql
        return build

    return register


def rounded(column: str | Column, alias: str) -> Column:
    """Six places: sums of doubles depend on the order of their terms."""
    column = F.col(column) if isinstance(column, str) else column
    return F.round(column.cast("double"), 6).alias(alias)


def plain(df: DataFrame, *more: str) -> DataFrame:
    """Positions as doubles beside the named columns."""
    return df.select(*more, *[F.col(f"position.{a}").cast("double").alias(a) for a in "xyz"])


def joined(array: str, alias: str) -> Column:
    return F.array_join(array, ",").alias(alias)
