"""Labelled corpus files: text, label, spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_labelled(spark: SparkSession, path: str) -> DataFrame:
    """CSV rows with spans as arrays; spans that do not parse are no spans, a missing text is
    an empty one."""
    rows = (spark.read.schema("text string, label int, spans string")
            .option("header", "true").option("multiLine", "true").option("quote", '"')
            .option("escape", '"').csv(path))
    return rows.fillna("", ["text"]).withColumn("spans", F.coalesce(
        F.from_json("spans", "array<array<int>>"), F.array().cast("array<array<int>>")))


def write_labelled(corpus: DataFrame, path: str) -> None:
    (corpus.select("text", "label", F.to_json("spans").alias("spans"))
     .write.mode("overwrite").option("header", "true").option("quote", '"')
     .option("escape", '"').csv(path))


def write_metrics(metrics: DataFrame, path: str) -> None:
    metrics.write.mode("overwrite").json(path)
