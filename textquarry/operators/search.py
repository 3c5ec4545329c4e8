"""Ranked full-text search over a documents table, and what is done with rankings.

Scores are BM25 with k1 = 1.2, b = 0.75 and idf = ln(1 + (N - df + 0.5) / (df + 0.5)), rounded
to six places; ties go by id.  Query terms are few, so term counts are taken inside
each row: a search reads the table once for the statistics and once for the scores
and exchanges only partial sums and top rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textquarry.functions import text as T

K1, B, RRF_K = 1.2, 0.75, 60


def parsed_query(query: str) -> list[str]:
    """Distinct terms of a query in order; operators and quotes are not interpreted."""
    import re

    return list(dict.fromkeys(re.findall(r"[^\W_]+", query.lower())))


def bm25(docs: DataFrame, query: str, text: str = "text", where: Column | None = None) -> DataFrame:
    """Rows that hold a query term, with ``score``; none for a query without words.  ``where`` filters rows, not the statistics."""
    terms = parsed_query(query)
    if not terms:  # nothing is asked for
        return docs.where("false").withColumn("score", F.lit(0.0))
    source = F.coalesce(F.col(text), F.lit(""))
    count = lambda t: F.size(F.filter("__t", lambda x: x == t))

    def counted(rows: DataFrame) -> DataFrame:
        # Made by a generator of one row, as filters on plain columns would be pushed below and tokenise again for each term.
        counts = F.struct(*[count(t).alias(f"__n{i}") for i, t in enumerate(terms)], F.size("__t").alias("__dl"))
        return rows.withColumn("__t", T.words(source)).select(*docs.columns, F.inline(F.array(counts)))

    stats = counted(docs).agg(F.count("*").alias("n"), F.avg("__dl").alias("avgdl"), *[F.count_if(F.col(f"__n{i}") > 0).alias(f"df{i}") for i in range(len(terms))]).first()
    n, avgdl = stats["n"], stats["avgdl"] or 1.0
    parts = []
    for i in range(len(terms)):
        df = stats[f"df{i}"]
        idf = F.log(F.lit(1.0) + F.lit((n - df + 0.5) / (df + 0.5)))
        tf = F.col(f"__n{i}").cast("double")
        parts.append(idf * (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * F.col("__dl") / F.lit(avgdl))))
    score = reduce(lambda a, b: a + b, parts)
    # A text that holds a term as a token contains it: a cheap filter of what is tokenised for scores.
    likely = docs.where(reduce(lambda a, b: a | b, [F.lower(source).contains(t) for t in terms]))
    hits = counted(likely if where is None else likely.where(where))
    hits = hits.where(reduce(lambda a, b: a | b, [F.col(f"__n{i}") > 0 for i in range(len(terms))]))
    return hits.withColumn("score", F.round(score, 6)).select(*docs.columns, "score")


def page(ranked: DataFrame, limit: int = 10, offset: int = 0, by: str = "doc_id") -> DataFrame:
    """Rows ``offset`` + 1 to ``offset`` + ``limit`` of a ranking, with their rank ``rn``.

    The rows up to the end of the page are the top of a distributed sort; only they are numbered.
    """
    top = ranked.orderBy(F.desc("score"), by).limit(offset + limit)
    return top.withColumn("rn", F.row_number().over(Window.orderBy(F.desc("score"), by))).where(F.col("rn") > offset)


def scan_page(ranked: DataFrame, keep: Column, limit: int, skip: int = 0, cap: int = 10_000, by: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(page, one row about it): rows ``skip`` + 1 on of those that pass a filter, among the first ``cap`` of a ranking.

    The row has scanned, matched, total_is_lower_bound (the ranking goes on beyond the cap) and next_skip (null at the end).
    """
    top = page(ranked, cap, by=by)
    kept = top.where(keep).withColumn("n", F.row_number().over(Window.orderBy("rn")))
    got = kept.where((F.col("n") > skip) & (F.col("n") <= skip + limit)).drop("n")
    about = top.agg(F.count("*").alias("scanned"), F.count_if(keep).alias("matched"))
    total = ranked.limit(cap + 1).agg((F.count("*") > cap).alias("total_is_lower_bound"))  # one row
    about = about.join(F.broadcast(total)).withColumn("next_skip", F.when(F.col("matched") > skip + limit, F.lit(skip + limit)))
    return got, about


def top_per_group(ranked: DataFrame, group: str, k: int, by: str = "doc_id") -> DataFrame:
    """The ``k`` best of each group, with rank ``rn``; a group limit runs before the exchange."""
    w = Window.partitionBy(group).orderBy(F.desc("score"), by)
    return ranked.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k)


def rrf(lists: DataFrame, key: str = "doc_id", rank: str = "rn", k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of ranked lists: key, rrf_score, n_lists."""
    return lists.groupBy(key).agg(F.round(F.sum(F.lit(1.0) / (F.lit(k) + F.col(rank))), 9).alias("rrf_score"), F.count("*").alias("n_lists"))


def canonical_first(rows: DataFrame, canon: str, order: str) -> DataFrame:
    """The first row of each canonical path."""
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy(canon).orderBy(order))).where("rn = 1").drop("rn")


def lookbehind(rows: DataFrame, group: str, canon: str, order: str, span: int = 8) -> DataFrame:
    """``suppressed``: whether the canonical path stood among the ``span`` rows before, within the group.

    ``rows`` are pages of ranked hits, so a group has few of them.
    """
    w = Window.partitionBy(group).orderBy(order).rowsBetween(-span, -1)
    return rows.withColumn("suppressed", F.array_contains(F.collect_list(canon).over(w), F.col(canon)))


def leakage_floor(hits: DataFrame, query: str, path: str, archive: str = "source", by: str = "doc_id", most: int = 2) -> DataFrame:
    """Hits without weak hits of secondary archives.

    The primary archive has the hit whose path shares most tokens with the query
    (then the best score); of any other, at most ``most`` hits stay, and only those
    that share a token, unless no hit of any archive does.
    """
    overlap = F.size(F.array_intersect(T.relevance_tokens(F.col(path)), T.relevance_tokens(F.lit(query))))
    hits = hits.withColumn("overlap", overlap)
    best = hits.groupBy(archive).agg(F.max(F.struct("overlap", "score", (-F.col(by)).alias("o"))).alias("b"))
    top = best.orderBy(F.desc("b")).limit(1).select(F.col(archive).alias("__primary"), F.col("b.overlap").alias("__most"))
    marked = hits.join(F.broadcast(top))  # one row
    kept = marked.where((F.col(archive) == F.col("__primary")) | (F.col("overlap") >= 1) | (F.col("__most") == 0))
    kept = kept.withColumn("__n", F.row_number().over(Window.partitionBy(archive).orderBy(F.desc("score"), by)))
    return kept.where((F.col(archive) == F.col("__primary")) | (F.col("__n") <= most)).withColumn("is_primary", F.col(archive) == F.col("__primary")).drop("__primary", "__most", "__n")


def shared_words(query: Column, text: Column) -> Column:
    """The share of the query's words that stand in a text: a plain scorer of pairs."""
    q = F.array_distinct(T.words(query))
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, T.words(text))) / F.size(q)).otherwise(0.0)


def rerank(ranked: DataFrame, query: str, text: str, scorer=shared_words, least: int = 4, cut: tuple[int, int] = (256, 512)) -> DataFrame:
    """A page of hits by a scorer of (query, text): ``rerank_score`` and ``new_rn``.

    Queries of fewer than ``least`` words keep their ranking; query and texts are cut to what a model reads.
    """
    if len(parsed_query(query)) < least:
        return ranked.withColumn("rerank_score", F.lit(None).cast("double")).withColumn("new_rn", F.col("rn"))
    rows = ranked.withColumn("rerank_score", F.round(scorer(F.lit(query[: cut[0]]), F.substring(text, 1, cut[1])), 6))
    return rows.withColumn("new_rn", F.row_number().over(Window.orderBy(F.desc("rerank_score"), "rn")))


def weak_result(hits: DataFrame, query: str, title: str) -> DataFrame:
    """One row: hits, strong (hits sharing a stem with the query), low_relevance."""
    q = T.relevance_tokens(F.lit(query))
    strong = F.exists(T.relevance_tokens(T.fold(F.col(title))), lambda a: F.exists(q, lambda b: T.shares_stem(a, b)))
    return hits.agg(F.count("*").alias("hits"), F.count_if(strong).alias("strong")).withColumn("low_relevance", (F.col("hits") > 0) & (F.col("strong") == 0))
