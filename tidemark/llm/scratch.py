"""Lineage cuts: tables written to the folder the cluster shares.

Every multi-pass operator writes its intermediate tables below
``spark.checkpoint.dir`` and reads them back. A lost executor then costs only
the tasks it was running; nothing lives on a single machine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.sources.shared import remove, shared_path


class Scratch:
    """The tables one call of an operator writes. ``drop()`` deletes those that
    no longer feed the result; the others go with the application."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self.paths = spark, name, {}

    def path(self, name: str) -> str:
        self.paths[name] = shared_path(self.spark, f"{self.name}-{name}")
        return self.paths[name]

    def stage(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        path = self.path(name)
        df.write.option("compression", codec).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            remove(self.spark, self.paths.pop(name))
