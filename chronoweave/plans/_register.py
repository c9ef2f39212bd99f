"""A table of queries: each is a function of (spark, sf_dir) under a name, most with SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Register:
    def __init__(self):
        self.queries: dict = {}
        self.sql: dict[str, str] = {}

    def __call__(self, name: str, sql: str | None = None):
        def keep(f):
            self.queries[name] = f
            if sql:
                self.sql[name] = sql
            return f

        return keep
