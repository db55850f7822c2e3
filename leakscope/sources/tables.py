"""Table loader for a folder of parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table as it lies there; splits follow ``spark.sql.files.maxPartitionBytes``."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
