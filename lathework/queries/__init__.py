"""The core's queries over the given tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL if it has one."""

    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return register


def read(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


def norm_sql(x: str) -> str:
    """functions.text.normalize in SQL."""
    folded = f"replace(replace(lower({x}), 'ß', 'ss'), 'ς', 'σ')"
    return rf"trim(regexp_replace({folded}, '[\s\p{{Z}}\x{{85}}\x{{1c}}-\x{{1f}}]+', ' ', 'g'))"
