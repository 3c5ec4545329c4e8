"""Readers of the tables an engine run is given."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of ``folder`` (a path of any file system Spark can read)."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
