"""Title lookup: exact, tiered, prefix and typo-tolerant."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textquarry.functions import text as T
from textquarry.session import small

#: Scores of the tiers.
DIRECT, TYPO = 1.0, 0.85


def lookup(titles: DataFrame, topics: DataFrame, title: str = "title", key: str = "id", path: str = "path") -> DataFrame:
    """topic, key, score, match_type: the best tier at which each title answers each topic.

    Tiers: the title itself; the path's spellings (with ``_`` for spaces, in the
    usual cases, as they are or under ``C/`` and ``A/``); the same without case or site; a topic of one word with one typo, where no
    better tier has a hit.  Each tier is an equality join on a derived key; typo
    pairs meet on the deletion neighbourhood of both words, not by comparing all.
    """
    t = titles.select(F.col(key).alias("key"), F.col(title).alias("title"), F.col(path).alias("path"))
    q = topics.select("topic").distinct()
    spelt = q.select("topic", F.explode(F.array_distinct(F.array(*[F.replace(c, F.lit(" "), F.lit("_")) for c in (F.col("topic"), F.concat(F.upper(F.substring("topic", 1, 1)), F.substring(F.col("topic"), F.lit(2), F.length("topic"))), F.initcap("topic"), F.lower("topic"), F.upper("topic"))]))).alias("path"))
    exact = t.join(small(q), F.col("title") == F.col("topic")).select("topic", "key", F.lit(1).alias("tier"))
    spelt = spelt.select("topic", F.explode(F.array(*[F.concat(F.lit(ns), "path") for ns in ("", "C/", "A/")])).alias("path"))
    direct = t.join(small(spelt), "path").select("topic", "key", F.lit(2).alias("tier"))
    folded = t.select("key", F.explode(F.array_distinct(F.array(F.lower("title"), F.lower(T.site_title(F.col("title")))))).alias("f"))
    nocase = folded.join(small(q.select("topic", F.lower("topic").alias("f"))), "f").select("topic", "key", F.lit(3).alias("tier"))
    found = exact.unionByName(direct).unionByName(nocase)
    answered = found.select("topic").distinct()
    typo = typos(t.select("key", "title"), q.join(answered, "topic", "left_anti")).select("topic", "key", F.lit(4).alias("tier"))
    best = found.unionByName(typo).groupBy("topic", "key").agg(F.min("tier").alias("tier"))
    name = F.when(F.col("tier") <= 2, "direct").when(F.col("tier") == 3, "fuzzy_suggest").otherwise("typo_corrected")
    return best.select("topic", "key", F.when(F.col("tier") == 4, TYPO).otherwise(DIRECT).alias("score"), name.alias("match_type"))


def _neighbours(df: DataFrame, word: str) -> DataFrame:
    """The word and each spelling with one letter left out, as ``nb``: words one edit or swap apart share one."""
    w = F.lower(F.col(word))
    cut = F.transform(F.sequence(F.lit(1), F.greatest(F.length(w), F.lit(1))), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))
    return df.withColumn("nb", F.explode(F.array_distinct(F.concat(F.array(w), cut))))


def typos(titles: DataFrame, topics: DataFrame) -> DataFrame:
    """topic, key, title of titles one typo away from topics of one word."""
    q = _neighbours(topics.where(~F.col("topic").rlike(r"\s")), "topic")
    pairs = _neighbours(titles, "title").join(small(q), "nb").select("topic", "key", "title").distinct()
    return pairs.where(T.one_typo(F.col("topic"), F.col("title")))


def results(found: DataFrame, titles: DataFrame, cap: int = 10, archive: str = "archive", key: str = "id") -> DataFrame:
    """The page of a title lookup: topic, archive, path, title, score, match_type; best first, each path of an archive once, ``cap`` a topic.

    ``found`` is what ``lookup`` gives; ``titles`` has key, archive, path, title.
    """
    rows = found.join(titles.select(F.col(key).alias("key"), F.col(archive).alias("archive"), "path", "title"), "key")
    once = rows.groupBy("topic", "archive", "path").agg(F.max(F.struct("score", "match_type", "title")).alias("b")).select("topic", "archive", "path", "b.title", "b.score", "b.match_type")
    w = Window.partitionBy("topic").orderBy(F.desc("score"), "archive", "path")
    return once.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= cap)


def with_promotion(found: DataFrame, promoted: DataFrame, cap: int = 10) -> DataFrame:
    """The pages of ``results`` with the title each topic is promoted to in front: moved there if it is on the page, else put in.

    ``promoted`` has topic, archive, path, title; a topic without one keeps its page.
    """
    new = promoted.select("topic", "archive", "path", F.col("title").alias("__t"), F.lit(True).alias("__p"))
    rows = found.join(new, ["topic", "archive", "path"], "full")
    rows = rows.select("topic", "archive", "path", F.coalesce("title", "__t").alias("title"), F.coalesce("score", F.lit(DIRECT)).alias("score"), F.coalesce("match_type", F.lit("promoted")).alias("match_type"), F.when(F.col("__p"), 0).otherwise(F.col("rn")).alias("__o"))
    w = Window.partitionBy("topic").orderBy("__o")
    return rows.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= cap).drop("__o")


def respelt(titles: DataFrame, topics: DataFrame) -> DataFrame:
    """topic, variant, key, title: titles that begin with a word one typo away from a topic of one word."""
    first = titles.select("key", "title", F.lower(F.regexp_extract("title", r"^[\p{L}\p{N}]+", 0)).alias("word")).where("word <> ''")
    hits = typos(first.select(F.struct("key", "title").alias("key"), F.col("word").alias("title")), topics)
    whole = hits.select("topic", F.col("title").alias("variant"), "key.key", "key.title")
    return whole.where(T.starts_with_word(F.lower("title"), F.col("variant")))


def suggest_ranked(hits: DataFrame, titles: DataFrame, prefix: str, limit: int = 10) -> DataFrame:
    """path, title, match_type, rn: suggestions from full-text ``hits`` (path, title, rn) by title, else from the title index.

    Of the first five times ``limit`` hits those whose title holds the prefix, in the
    order of hits; titles that start with it go first, then shorter ones.  Without any, the title index answers.
    """
    p = prefix.lower().strip()
    low = F.lower("title")
    kind = lambda name: F.when(low.startswith(p), f"{name}_start_match").otherwise(f"{name}_contains_match")
    pool = hits.where((F.col("rn") <= 5 * limit) & (F.trim("title") != "") & ~T.is_pseudo_entry(F.col("path"), F.col("title"), True))
    pool = pool.groupBy("title").agg(F.min(F.struct("rn", "path")).alias("m")).select("title", "m.path", "m.rn").where(low.contains(p))
    first = pool.orderBy("rn").limit(limit).select("path", "title", kind("search").alias("match_type"), F.col("rn").cast("long").alias("o"))
    index = titles.where(low.contains(p) & (F.length(F.trim("title")) >= 2) & ~T.is_pseudo_entry(F.col("path"), F.col("title")))
    index = index.select("path", "title", kind("title").alias("match_type"), F.lit(0).cast("long").alias("o"))
    start = F.when(F.col("match_type").endswith("start_match"), 0).otherwise(1)
    index = index.orderBy(start, F.length("title"), "title", "path").limit(limit)
    none = first.agg(F.count("*").alias("n")).where("n = 0").select(F.lit(True).alias("__none"))
    rows = first.unionByName(index.join(F.broadcast(none)).drop("__none"))  # one row or none
    # At most ``limit`` rows are numbered.
    return rows.withColumn("rn", F.row_number().over(Window.orderBy(start, F.length("title"), "o", "title", "path"))).drop("o")


def suggest(titles: DataFrame, prefix: str, limit: int = 10, title: str = "title", key: str = "id") -> DataFrame:
    """Titles that start with the prefix, then those that contain it; shorter ones first."""
    low, p = F.lower(F.col(title)), prefix.lower()
    kind = F.when(low.startswith(p), "title_start_match").otherwise("title_contains_match")
    rows = titles.where(low.contains(p)).select(F.col(key), F.col(title), kind.alias("match_type"), F.when(low.startswith(p), 0).otherwise(1).alias("__k"))
    return rows.orderBy("__k", F.length(title), title, key).limit(limit).drop("__k")


def tails(topics: DataFrame, most: int = 4) -> DataFrame:
    """topic, tail, tail_ord: the trailing runs of up to ``most`` words, longest first."""
    w = F.col("__w")
    n = F.least(F.size(w), F.lit(most))
    rows = topics.select("topic", T.words(F.col("topic")).alias("__w")).where(F.size("__w") > 0)
    rows = rows.select("topic", "__w", F.explode(F.sequence(F.lit(1), n)).alias("len"))
    return rows.select("topic", F.array_join(F.slice(w, F.size(w) - F.col("len") + 1, F.col("len")), " ").alias("tail"), (n - F.col("len") + 1).alias("tail_ord"))


def windows(topics: DataFrame, most: int = 4) -> DataFrame:
    """topic, start, len, gram: all runs of up to ``most`` words."""
    w = F.col("__w")
    rows = topics.select("topic", T.words(F.col("topic")).alias("__w")).where(F.size("__w") > 0)
    rows = rows.select("topic", "__w", F.explode(F.sequence(F.lit(1), F.least(F.size(w), F.lit(most)))).alias("len"))
    rows = rows.select("topic", "__w", "len", F.explode(F.sequence(F.lit(1), F.size(w) - F.col("len") + 1)).alias("start"))
    return rows.select("topic", "start", "len", F.array_join(F.slice(w, F.col("start"), F.col("len")), " ").alias("gram"))
