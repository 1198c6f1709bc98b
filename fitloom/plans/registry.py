"""Where queries are registered, and what they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fitloom.functions.scalars import rounded

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL where there is one."""

    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r(sql: str, places: int = 4) -> str:
    """The rounding helper in SQL."""
    p = f"1e{places}::DOUBLE"
    return f"(floor(({sql}) * {p} + 0.5) / {p})"


def rounded_all(df: DataFrame, places: int, *columns: str) -> DataFrame:
    return df.withColumns({c: rounded(F.col(c), places) for c in columns})
