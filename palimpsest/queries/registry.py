"""The registry of queries: each is a function of the tables, with the SQL that says the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from palimpsest.sources.derived import load, oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
FUNCTIONS: dict[str, Callable[[Tables], DataFrame]] = {}


class Tables:
    """Base and derived tables of one folder, by name."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getitem__(self, name: str) -> DataFrame:
        return load(self.spark, self.sf_dir, name)


def query(sql: str | None = None) -> Callable[[Callable[[Tables], DataFrame]], Callable[[Tables], DataFrame]]:
    def add(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        FUNCTIONS[f.__name__] = f
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLE_SQL[f.__name__] = oracle(sql)
        return f

    return add
