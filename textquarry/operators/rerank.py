"""Re-ranking by a model: a scorer that each task loads once, over batches of pairs, with the old order as a fallback.

A scorer is made by a function without arguments (it loads the model) and maps lists of
queries and texts to scores.  Where it cannot be loaded, raises, or gives scores that
are not finite, the rows keep the order they had.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textquarry.operators.search import parsed_query

Scorer = Callable[[list[str], list[str]], list[float]]
#: Words a query must have, and characters of query and text that a model reads.
LEAST_WORDS, QUERY_CHARS, TEXT_CHARS, BATCH = 4, 256, 512, 32


def _scores(load: Callable[[], Scorer]):
    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = None
        failed = False
        for batch in batches:
            queries, texts = batch.column("__query").to_pylist(), batch.column("__text").to_pylist()
            out: list[float | None] = []
            for a in range(0, len(texts), BATCH):
                got = None
                if not failed:
                    try:
                        scorer = load() if scorer is None else scorer
                        got = [float(s) for s in scorer(queries[a : a + BATCH], texts[a : a + BATCH])]
                    except Exception:  # whatever a model raises, the ranking stands
                        failed = True
                if got is None or len(got) != len(texts[a : a + BATCH]) or not all(map(math.isfinite, got)):
                    got = [None] * len(texts[a : a + BATCH])
                out += got
            yield pa.RecordBatch.from_arrays([batch.column("__row"), pa.array(out, pa.float64())], ["__row", "__s"])

    return scores


def rerank(ranked: DataFrame, query: str, text: str, load: Callable[[], Scorer], key: list[str], score: str = "score", order: str = "rn") -> DataFrame:
    """``ranked`` (one page of hits) with ``order`` numbered anew and ``score`` of the model, if it scored every row; else as it is.

    Queries of fewer than ``LEAST_WORDS`` words keep their ranking.
    """
    if len(parsed_query(query)) < LEAST_WORDS:
        return ranked
    own = F.struct(*key)
    pairs = ranked.select(own.alias("__row"), F.lit(query[:QUERY_CHARS]).alias("__query"), F.substring(F.coalesce(text, F.lit("")), 1, TEXT_CHARS).alias("__text"))
    kind = pairs.schema["__row"].dataType.simpleString()
    scored = pairs.mapInArrow(_scores(load), f"__row {kind}, __s double")
    # A page of hits: its windows have a few rows.
    every = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = ranked.withColumn("__row", own).join(scored, "__row").withColumn("__all", F.count_if(F.col("__s").isNull()).over(every) == 0)
    rows = rows.withColumn("__n", F.row_number().over(Window.orderBy(F.when(F.col("__all"), -F.col("__s")), order)))
    return rows.withColumns({score: F.when(F.col("__all"), F.col("__s")).otherwise(F.col(score)), order: F.col("__n")}).drop("__row", "__s", "__all", "__n")


def redistributed(reranked: DataFrame, archive: str = "archive", order: str = "rn") -> DataFrame:
    """Hits of several archives that were re-ranked together, given back to their archives: ``archive_rn`` is the rank within each."""
    return reranked.withColumn("archive_rn", F.row_number().over(Window.partitionBy(archive).orderBy(order)))
