"""Change detection between snapshots (path, mtime, size)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def diff(before: DataFrame, after: DataFrame, complete: bool = True) -> DataFrame:
    """path, change: added, removed or changed.  An incomplete scan removes nothing."""
    b = before.select("path", F.col("mtime").alias("m0"), F.col("size").alias("s0"), F.lit(True).alias("__b"))
    a = after.select("path", F.col("mtime").alias("m1"), F.col("size").alias("s1"), F.lit(True).alias("__a"))
    both = b.join(a, "path", "full_outer")
    kind = F.when(F.col("__b").isNull(), "added").when(F.col("__a").isNull(), "removed").when(~(F.col("m0").eqNullSafe(F.col("m1")) & F.col("s0").eqNullSafe(F.col("s1"))), "changed")
    out = both.select("path", kind.alias("change")).where("change is not null")
    return out if complete else out.where("change <> 'removed'")
