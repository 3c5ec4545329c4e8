"""Structured Streaming: changes of snapshots, and windows over events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from textquarry.operators.changes import diff

REMEMBERED_REMOVALS = 1024


def watch(snapshots: DataFrame, publish: Callable[[DataFrame, int], None], state_path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Publishes what each batch of snapshot rows (path, mtime, size) changes against the last state.

    The state is a table in shared storage, written anew beside the old one for each
    batch and named by its batch, so a batch that is run again after a failure
    starts from the same state.  An entry that comes back after its removal with
    other values counts as changed; the newest removals are remembered for that.  Rows
    with a column ``complete`` that is false are an incomplete scan: it removes nothing.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        last = _last_state(spark, state_path, batch_id)
        whole = "complete" not in batch.columns or batch.where("not complete").isEmpty()
        batch = batch.where("path is not null")
        latest = batch.groupBy("path").agg(F.max(F.struct("mtime", "size")).alias("x")).select("path", "x.mtime", "x.size")
        if last is None:
            last = latest.limit(0).withColumn("removed", F.lit(False))
        changes = diff(last.where("not removed"), latest, whole)
        gone = last.where("removed").select("path", "mtime", "size")
        back = changes.where("change = 'added'").join(gone, "path").join(latest.select("path", F.col("mtime").alias("m"), F.col("size").alias("s")), "path")
        again = back.where("m <> mtime or s <> size").select("path", F.lit("changed").alias("again"))
        out = changes.join(again, "path", "left").select("path", F.coalesce("again", "change").alias("change"))
        publish(out, batch_id)
        lost = last.where("not removed").join(latest.select("path"), "path", "left_anti").select("path", "mtime", "size")
        old = gone.join(latest.select("path"), "path", "left_anti")
        kept = lost.unionByName(old).orderBy(F.desc("mtime"), "path").limit(REMEMBERED_REMOVALS)
        if not whole:  # what was not seen may still be there
            latest, kept = latest.unionByName(lost), old.orderBy(F.desc("mtime"), "path").limit(REMEMBERED_REMOVALS)
        state = latest.withColumn("removed", F.lit(False)).unionByName(kept.withColumn("removed", F.lit(True)))
        state.write.mode("overwrite").parquet(f"{state_path}/batch={batch_id:09d}")

    writer = snapshots.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def _last_state(spark: SparkSession, path: str, batch_id: int) -> DataFrame | None:
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return None
    ids = sorted(int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(folder) if s.getPath().getName().startswith("batch="))
    ids = [i for i in ids if i < batch_id]
    return spark.read.parquet(f"{path}/batch={ids[-1]:09d}") if ids else None


def tumbling(events: DataFrame, width: str = "1 day", late: str = "1 day", ts: str = "ts") -> DataFrame:
    """Counts and sums by window and type; rows later than ``late`` behind the newest are dropped by the watermark."""
    rows = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    w = F.window(ts, width)
    return rows.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 day", ts: str = "ts", key: str = "user_id") -> DataFrame:
    """Sessions of each key: start, end and number of events."""
    rows = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    w = F.session_window(ts, gap)
    return rows.groupBy(key, w.alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
