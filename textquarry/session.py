"""Session helpers: the shared work folder, scratch tables, sized broadcasts."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: A side is broadcast only if its estimated size in memory is below this: for files, their size times COMPRESSED.
BROADCAST_LIMIT, COMPRESSED = 32 << 20, 4
#: Rows that are broadcast where a size cannot be estimated.
FEW_ROWS = 20_000

_folders: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share.

    It is the one the cluster names in ``spark.checkpoint.dir``; only a local session
    without that setting (tests, a laptop) gets a folder of its own.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not re.fullmatch(r"local(\[.*\])?", master):
        raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
    key = spark.sparkContext.applicationId
    if key not in _folders:
        _folders[key] = "file://" + tempfile.mkdtemp(prefix="textquarry-")
        spark.sparkContext.setCheckpointDir(_folders[key])
    return _folders[key]


class Scratch:
    """Tables written to the shared folder to cut lineage.

    Tasks can be recomputed from these tables when an executor is lost. The
    folder is removed when the interpreter ends, or by ``drop``.

    In a mounted folder (``file:``) files are written by Hadoop's raw local file
    system: its usual one starts four ``chmod`` processes for each file and writes a
    ``.crc`` file beside it.  Other stores are not touched by these options.
    """

    RAW = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/textquarry-{label}-{uuid.uuid4().hex[:12]}"
        self._n = 0
        atexit.register(self.drop)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        self._n += 1
        path = f"{self.root}/{self._n:03d}-{name}"
        df.write.mode("overwrite").options(compression="zstd", **self.RAW).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def forget(self, df: DataFrame | None) -> None:
        """Delete one table that nothing reads any more."""
        path = getattr(df, "_scratch_path", None)
        if path:
            self._delete(path)

    def drop(self) -> None:
        try:
            self._delete(self.root)
        except Exception:  # the session may be gone at exit
            pass
        atexit.unregister(self.drop)

    def _delete(self, path: str) -> None:
        sc = self.spark.sparkContext
        if sc._jsc is None:
            return
        p = sc._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of a frame, in bytes."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def small(df: DataFrame, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """``broadcast(df)`` if its estimated size is below ``limit``, else ``df`` unchanged.

    The plan's estimate of a table is the size of its compressed files, so ``COMPRESSED`` times as much is reckoned with.
    """
    from pyspark.sql import functions as F

    return F.broadcast(df) if plan_bytes(df) * COMPRESSED <= limit else df


def few(df: DataFrame, rows: int = FEW_ROWS) -> bool:
    """Whether a frame has at most ``rows`` rows, counted up to there.

    For frames that come from an ``explode``: estimates do not know how many rows it makes.
    """
    return df.limit(rows + 1).count() <= rows
