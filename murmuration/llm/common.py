"""Helpers that several operators of this package share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from murmuration.session import delete_folder, new_folder, scratch

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register ``function(spark, folder)``; without ``sql`` a test holds it against a brute-force version."""

    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql.strip()
        return function

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


class Tables:
    """Intermediate tables in the shared folder, each of which can be dropped once nothing reads it any more."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.paths: dict[str, str] = {}

    def put(self, name: str, df: DataFrame) -> DataFrame:
        """Compute ``df`` into a table and read it from there: later steps depend on no executor."""
        path = new_folder(self.spark, name)
        df.write.parquet(path)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def put_result(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """``put`` of what ``make`` returns; tables that it stores on the way are removed."""
        path = new_folder(self.spark, name)
        with scratch(self.spark):
            df = make()
            df.write.parquet(path)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Remove tables that nothing reads any more; of each name the last, and no error if there is none."""
        for name in names:
            if name in self.paths:
                delete_folder(self.spark, self.paths.pop(name))
