"""Registry of queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The tables of a directory by name, each read when it is used."""

    def __init__(self, spark: SparkSession, at: str):
        self.spark, self.at = spark, at

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.at}/{name}.parquet")


def query(sql: str | None = None):
    """Register a function of Tables under its name, with SQL of the same columns."""

    def add(fn: Callable[[Tables], DataFrame]):
        if fn.__name__ in QUERIES:
            raise ValueError(f"duplicate query: {fn.__name__}")
        QUERIES[fn.__name__] = lambda spark, at: fn(Tables(spark, at))
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add
