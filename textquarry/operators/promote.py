"""Canonical titles put before ranked hits: splice, prefix probe, promotion by tails of the query."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textquarry.functions import text as T
from textquarry.operators import titles as TI
from textquarry.session import small

CANONICAL = "(canonical title match)"


def splice(hits: DataFrame, titles: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """A page of ranked hits (path, title, snippet, rn) with the entry titled as the query in front.

    List articles go behind others; a hit that is the canonical entry moves up; else
    it is put in, unless a hit's title without its site already equals the query.
    """
    q = F.lit(query.lower())
    hits = hits.withColumn("__list", T.is_list_article(F.col("path")).cast("int"))
    canon = titles.where(F.lower("title") == q).orderBy(F.length("path"), "path").limit(1).select(F.col("path").alias("path"), F.col("title"))
    same = hits.where(F.lower(T.site_title(F.col("title"))) == q).select("path").limit(1)
    new = canon.join(hits.select("path"), "path", "left_anti").join(F.broadcast(same.select(F.lit(1).alias("__x"))), how="left").where("__x is null")
    new = new.select("path", "title", F.lit(CANONICAL).alias("snippet"), F.lit(0).alias("rn"), F.lit(-1).alias("__list"))
    moved = hits.join(F.broadcast(canon.select("path", F.lit(-1).alias("__c"))), "path", "left").withColumn("__list", F.coalesce("__c", "__list")).drop("__c")
    rows = moved.select("path", "title", "snippet", "rn", "__list").unionByName(new)
    return rows.withColumn("new_rn", F.row_number().over(Window.orderBy("__list", "rn"))).where(F.col("new_rn") <= limit).drop("__list")


def prefix_probe(titles: DataFrame, prefix: str) -> DataFrame:
    """At most one row: the title of a ``(…)`` family without its bracket if it exists, else the shortest with the prefix."""
    low = F.lower("title")
    rows = titles.where(low.startswith(prefix.lower())).select("path", "title", F.trim(F.regexp_replace("title", r"[ _]\([^)]*\)$", "")).alias("root"))
    roots = rows.where("root <> title").select(F.col("root").alias("title"), F.lit(0).alias("kind")).distinct()
    known = rows.join(roots, "title", "left").select("path", "title", F.coalesce("kind", F.lit(1)).alias("kind"))
    return known.orderBy("kind", F.length("title"), "title").limit(1).select("path", "title")


def by_tails(topics: DataFrame, titles: DataFrame, most: int = 4) -> DataFrame:
    """topic, tail, tail_ord, key, title: for each topic the title that its longest tail names."""
    t = TI.tails(topics, most)
    named = titles.select("key", "title", F.array_join(T.words(F.col("title")), " ").alias("tail"))
    hits = named.join(small(t), "tail")
    best = hits.groupBy("topic").agg(F.min(F.struct("tail_ord", "key", "title", "tail")).alias("b"))
    return best.select("topic", "b.tail", "b.tail_ord", "b.key", "b.title")
