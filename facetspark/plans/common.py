"""What the query modules share: a register of queries with their oracle SQL, and the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


class Register:
    """Collects query functions by name, with the DuckDB SQL of their results where there is any."""

    def __init__(self):
        self.queries: dict = {}
        self.oracles: dict[str, str] = {}

    def __call__(self, sql: str | None = None):
        def add(f):
            self.queries[f.__name__] = f
            if sql:
                self.oracles[f.__name__] = sql
            return f

        return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
