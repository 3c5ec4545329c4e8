"""The link graph built from a stream of pages: a segment a batch, and the changes of degrees.

Each batch writes three tables under its own number: the pages it holds (a page sent
again replaces its earlier edges, one without links or marked as removed has none), their
edges, and by how much the inbound degree of each target changes.  A batch that is run
again overwrites its own segment and reads only earlier ones, so it gives the same again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from textquarry.operators import graph_store as GS

PAGES, EDGES, DEGREES = "path string, batch long", "source string, target string, anchor string, batch long", "target string, delta long, batch long"


def _segments(spark: SparkSession, folder: str, name: str, schema: str, before: int | None = None) -> DataFrame:
    """The rows of all batches of a table, or of those before one."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).option("basePath", f"{folder}/{name}").parquet(f"{folder}/{name}")
    return rows if before is None else rows.where(F.col("batch") < before)


def edges_of(spark: SparkSession, folder: str, before: int | None = None) -> DataFrame:
    """source, target, anchor as of the newest batch of each page; the number of the batch is a folder, so earlier states prune files."""
    newest = _segments(spark, folder, "pages", PAGES, before).groupBy("path").agg(F.max("batch").alias("batch"))
    rows = _segments(spark, folder, "edges", EDGES, before)
    return rows.join(newest.withColumnRenamed("path", "source"), ["source", "batch"]).select("source", "target", "anchor")


def degrees_of(spark: SparkSession, folder: str) -> DataFrame:
    """path, inbound_degree: the sums of all changes; targets that lost their last link are gone."""
    total = _segments(spark, folder, "degrees", DEGREES).groupBy(F.col("target").alias("path")).agg(F.sum("delta").alias("inbound_degree"))
    return total.where("inbound_degree <> 0")


def build(pages: DataFrame, links: Callable[[DataFrame], DataFrame], folder: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Starts the build over a stream of pages (path, and what ``links`` reads); ``links`` gives source, target, anchor of a batch.

    Of a page that stands in a batch several times all its edges count once.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        put = lambda df, name: df.write.mode("overwrite").parquet(f"{folder}/{name}/batch={batch_id}")
        own = batch.select("path").distinct()
        old = edges_of(spark, folder, batch_id).join(own.withColumnRenamed("path", "source"), "source", "left_semi")
        put(links(batch).where("source <> target").dropDuplicates(["source", "target"]), "edges")
        new = spark.read.parquet(f"{folder}/edges/batch={batch_id}")
        change = new.select("target", F.lit(1).alias("d")).unionByName(old.select("target", F.lit(-1).alias("d")))
        put(change.groupBy("target").agg(F.sum("d").cast("long").alias("delta")).where("delta <> 0"), "degrees")
        put(own, "pages")  # the last table: a batch counts once its pages are written

    writer = pages.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def merge(spark: SparkSession, folder: str, path: str, archive_uuid: str) -> str:
    """Writes the graph of all batches as one stored graph; its fingerprint: number of edges and sum of their hashes."""
    edges = edges_of(spark, folder)
    GS.write_graph(edges, path, archive_uuid, force=True)
    return fingerprint(spark.read.parquet(f"{path}/edges"))


def fingerprint(edges: DataFrame) -> str:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("source", "target").cast("decimal(20,0)")).alias("h")).first()
    return f"{r['n']}:{r['h']}"
