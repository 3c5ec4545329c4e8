"""The link graph as a stored pair of tables with a fingerprint."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.operators.links import inbound_degree

VERSION = 3


class StaleGraph(ValueError):
    """The stored graph is of another version or archive."""


def write_graph(edges: DataFrame, path: str, archive_uuid: str, force: bool = False) -> None:
    """Writes edges (sorted by target, for pruned reads), nodes with their inbound degree, and the fingerprint last.

    A folder without a fingerprint is no graph, so a job that dies midway leaves none behind.
    """
    spark = edges.sparkSession
    mode = "overwrite" if force else "errorifexists"
    kept = edges.where("source <> target").dropDuplicates(["source", "target"])
    kept.repartitionByRange("target").sortWithinPartitions("target", "source").write.mode(mode).parquet(f"{path}/edges")
    stored = spark.read.parquet(f"{path}/edges")
    nodes = stored.select(F.col("source").alias("path")).union(stored.select("target"))
    inbound_degree(stored, nodes).write.mode(mode).parquet(f"{path}/nodes")
    meta = spark.range(1).select(F.lit(VERSION).alias("version"), F.lit(archive_uuid).alias("uuid"), F.lit(stored.count()).alias("edges"))
    meta.write.mode(mode).parquet(f"{path}/meta")


def open_graph(spark: SparkSession, path: str, archive_uuid: str) -> tuple[DataFrame, DataFrame]:
    """(edges, nodes) of a stored graph of this version and archive."""
    meta = spark.read.parquet(f"{path}/meta").first()
    if meta["version"] != VERSION or meta["uuid"] != archive_uuid:
        raise StaleGraph("the stored link graph is of another version or archive")
    return spark.read.parquet(f"{path}/edges"), spark.read.parquet(f"{path}/nodes")


def linkers(edges: DataFrame, nodes: DataFrame, target: str, limit: int = 10, offset: int = 0) -> DataFrame:
    """Pages that link ``target``, most linked first; the filter reaches the sorted edge files."""
    hit = edges.where(F.col("target") == target).select(F.col("source").alias("path"), "anchor")
    return hit.join(nodes, "path").select("path", "anchor", "inbound_degree").orderBy(F.desc("inbound_degree"), "path").offset(offset).limit(limit)
