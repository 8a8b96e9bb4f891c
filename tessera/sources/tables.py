"""The relational tables of a folder, one Parquet file or folder each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Tables:
    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def registry(queries: dict[str, Callable[[SparkSession, str], DataFrame]], sqls: dict[str, str]):
    """A decorator that names a function of Tables as a query, with the SQL that it is compared with."""

    def query(sql: str | None):
        def register(f: Callable[[Tables], DataFrame]):
            queries[f.__name__] = lambda spark, folder: f(Tables(spark, folder))
            if sql:
                sqls[f.__name__] = sql
            return f

        return register

    return query
