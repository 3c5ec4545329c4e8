"""Hits of several archives made into one short ranking: fusion, promotion, demotion, relevance and leakage floors.

Every frame here is a page of hits: at most ``k`` rows an archive going in, a handful coming out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textquarry.functions import text as T
from textquarry.operators import promotion as PM
from textquarry.operators.search import RRF_K

COLUMNS = ("archive", "path", "title", "score", "relevance", "promoted")


def fuse(hits: DataFrame, several: bool, keep: int = 5) -> DataFrame:
    """The best ``keep`` of the archives' rankings (archive, ord, path, title, relevance, rn) with their new rank.

    One archive keeps its ranking.  Several are fused by reciprocal ranks; a path
    belongs to the archive that ranks it best, then to the earlier one; ties go by path.
    """
    if not several:
        return hits.where(F.col("rn") <= keep).select("archive", "path", "title", F.col("relevance").alias("score"), "relevance", F.lit(False).alias("promoted"), "rn")
    owner = F.min(F.struct("rn", "ord", "archive", "title", "relevance")).alias("o")
    rows = hits.groupBy("path").agg(F.round(F.sum(F.lit(1.0) / (F.lit(RRF_K) + F.col("rn"))), 9).alias("score"), owner)
    rows = rows.select("o.archive", "path", "o.title", "score", "o.relevance", F.lit(False).alias("promoted")).orderBy(F.desc("score"), "path").limit(keep)
    return rows.withColumn("rn", F.row_number().over(Window.orderBy(F.desc("score"), "path")))


def promote(top: DataFrame, found: DataFrame, query: str) -> DataFrame:
    """``top`` with the canonical title ``found`` (archive, path, title; one row or none) in front, unless rank 1 already is one."""
    strong = PM.strong_canonical(F.lit(query), F.col("path"), F.replace("path", F.lit("_"), F.lit(" ")))
    settled = top.where((F.col("rn") == 1) & strong).select(F.lit(1).alias("__s"))
    new = found.join(F.broadcast(settled), how="left_anti").select("archive", "path", F.col("title").alias("__t"), F.lit(True).alias("__p"))
    rows = top.join(F.broadcast(new), ["archive", "path"], "full")
    rows = rows.select("archive", "path", F.coalesce("title", "__t").alias("title"), F.coalesce("score", F.lit(1.0)).alias("score"), "relevance", F.coalesce("__p", F.lit(False)).alias("promoted"), F.when(F.col("__p"), 0).otherwise(F.col("rn")).alias("rn"))
    return _numbered(rows, F.col("rn"))


def _numbered(rows: DataFrame, *order) -> DataFrame:
    return rows.withColumn("rn", F.row_number().over(Window.orderBy(*order)))


def demote(top: DataFrame) -> DataFrame:
    """List articles that were not promoted go behind all others."""
    return _numbered(top, (T.is_list_article(F.col("path")) & ~F.col("promoted")).cast("int"), "rn")


def relevance_floor(top: DataFrame, share: float = 0.25) -> DataFrame:
    """Hits of one archive with at least a share of the first one's relevance; all of them where the first has none."""
    first = F.first("relevance").over(Window.orderBy("rn").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = top.withColumn("__f", first).where(F.col("__f").isNull() | F.col("relevance").isNull() | (F.col("relevance") >= share * F.col("__f"))).drop("__f")
    return _numbered(rows, "rn")


def leakage_floor(top: DataFrame, query: str, most: int = 2, least: int = 1) -> DataFrame:
    """Hits of several archives without off-topic ones of secondary archives.

    The primary archive has the path that shares most words with the query (ties: the
    best ranked; without any, that of the first hit).  Promoted hits stay, but for single
    words at the query's end from secondary archives; of the others each secondary archive keeps
    ``most``, with ``least`` shared words unless no hit has any.  One hit always stays.
    """
    q = T.relevance_tokens(F.lit(query))
    rows = top.withColumn("overlap", F.size(F.array_intersect(T.relevance_tokens(F.col("path")), q)))
    every = Window.orderBy("rn").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    best = F.max("overlap").over(Window.partitionBy("archive"))
    seen = F.min("rn").over(Window.partitionBy("archive"))
    rows = rows.withColumns({"__b": best, "__s": seen})
    rows = rows.withColumn("__m", F.max(F.struct("__b", (-F.col("__s")).alias("s"), "archive")).over(every))
    rows = rows.withColumns({"__own": F.col("archive") == F.col("__m.archive"), "__blind": F.col("__m.__b") == 0})
    tail = PM.tail_hijack(F.lit(query), PM.bare(F.col("path")), 1)
    rows = rows.withColumn("__leak", ~F.col("__own") & F.col("promoted") & tail)
    rows = rows.withColumn("__free", (F.col("__own") | F.col("promoted")) & ~F.col("__leak"))
    rows = rows.withColumn("__fit", ~F.col("__own") & ~F.col("promoted") & (F.col("__blind") | (F.col("overlap") >= least)))
    rank = F.sum(F.col("__fit").cast("int")).over(Window.partitionBy("archive").orderBy("rn").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumn("__keep", F.when(F.size(q) == 0, True).otherwise(F.col("__free") | (F.col("__fit") & (rank <= most))))
    rows = rows.withColumn("__any", F.max("__keep").over(every)).where(F.col("__keep") | (~F.col("__any") & (F.col("rn") == 1)))
    return _numbered(rows.select(*COLUMNS, "rn"), "rn")


def select_hits(hits: DataFrame, found: DataFrame, query: str, several: bool, keep: int = 5) -> DataFrame:
    """The stages in their order: fuse, promote, demote list articles, then the floor that fits the number of archives."""
    top = demote(promote(fuse(hits, several, keep), found, query))
    return leakage_floor(top, query) if several else relevance_floor(top)
