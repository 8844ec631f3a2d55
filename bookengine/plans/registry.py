"""All queries of the book operators and the SQL that each is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, **types: str) -> Callable[[Query], Query]:
    """Register a function under its name, with the SQL that must give the same rows; ``types`` are casts of its columns."""
    if sql is not None and types:
        sql = f"SELECT * REPLACE ({', '.join(f'{name}::{kind} AS {name}' for name, kind in types.items())}) FROM ({sql})"

    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
