"""Registry of check queries: each pairs a Spark plan with the SQL that must give the same rows."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerline.session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """Lazy access to the given parquet tables.

    The setting ``spark.ledgerline.read.partitions`` deals a table of few row groups over that many tasks; without it the file splits decide.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        table = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        parts = self.spark.conf.get("spark.ledgerline.read.partitions", None)
        return table.repartition(int(parts)) if parts else table


def check(name: str, sql: str | None = None):
    """Register ``fn(tables)`` under ``name`` with its reference SQL."""

    def register(fn: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(Tables(configure(spark), folder))

        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return fn

    return register
