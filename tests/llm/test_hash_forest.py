import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from textquarry.llm.hash_forest import nearest
from textquarry.llm.registry import QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int, score string"


def vectors(rng, n, dim):
    return [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(n)]


def brute(rows, k, step):
    """query_id, rank, vec_id, score by all pairs in double precision."""
    rows = {i: np.array(np.array(v, np.float32), float) for i, v in rows}
    unit = {i: v / math.sqrt((v * v).sum()) for i, v in rows.items()}
    out = []
    for q in sorted(i for i in rows if i % step == 0):
        near = sorted((-round(float(unit[q] @ unit[i]), 12), i) for i in rows if i != q)[:k]
        out += [(q, r, i, -s) for r, (s, i) in enumerate(near, 1)]
    return out


def rounded(df):
    return sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 12) + 0.0) for r in df.collect())


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "clash") for i, v in rows], SCHEMA)


@pytest.mark.parametrize("options", [{}, {"directory": 3}, {"slice_rows": 16, "bucket_rows": 32, "directory": 5}, {"query_rows": 3, "slice_rows": 8}])
def test_all_candidates_give_exact_results(spark, options):
    """When the ascent goes up to the roots, the result is that of all pairs."""
    rng = random.Random(3)
    rows = list(enumerate(vectors(rng, 150, 6)))
    rows += [(150 + i, rows[5][1]) for i in range(40)] + [(190 + i, [x * 4 for x in rows[7][1]]) for i in range(5)]
    got = nearest(frame(spark, rows), F.col("vec_id") % 10 == 0, trees=4, candidates=10**6, **options)
    assert rounded(got) == [(a, b, c, d + 0.0) for a, b, c, d in brute(rows, 5, 10)]


@pytest.mark.parametrize("directory", [2, 14])
def test_clusters_are_found_at_deep_levels(spark, directory):
    rng = random.Random(5)
    rows = []
    for c, centre in enumerate(vectors(rng, 40, 16)):
        rows += [(c * 10 + j, [x + rng.gauss(0, 0.03) for x in centre]) for j in range(10)]
    got = rounded(nearest(frame(spark, rows), F.col("vec_id") % 20 == 0, candidates=160, trees=12, directory=directory))
    want = brute(rows, 5, 20)
    assert len(set(got) & set(want)) >= 0.95 * len(want)
    assert all(c // 10 == a // 10 for a, _, c, _ in got)


def test_odd_rows(spark):
    rows = [
        (0, [1.0, 0.0]), (1, None), (2, []), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [None, 1.0]),
        (7, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (8, [2.0, 0.0]), (9, [3e38, 3e38]), (10, [1e-38, -1e-38]), (8, [2.0, 0.0]), (8, [5.0, 5.0]), (50, [-1.0, 0.0]),
    ]
    got = rounded(nearest(frame(spark, rows), F.col("vec_id") % 50 == 0))
    half = round(math.sqrt(0.5), 12)
    assert got == [(0, 1, 8, 1.0), (0, 2, 9, half), (0, 3, 10, half), (0, 4, 50, -1.0), (50, 1, 9, -half), (50, 2, 10, -half), (50, 3, 0, -1.0), (50, 4, 8, -1.0)]


def test_empty_tables(spark):
    for rows in ([], [(1, [1.0, 2.0])], [(0, None)], [(0, [1.0])]):
        out = nearest(frame(spark, rows), F.col("vec_id") % 50 == 0)
        assert out.columns == ["query_id", "rank", "vec_id", "score"] and out.count() == 0


def test_recall_of_the_query(spark):
    folder = "/root/testdata/sf0.1"
    got = QUERIES["op13_prefix_forest"](spark, folder).collect()
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    want = brute(rows, 5, 50)
    assert len({(r["query_id"], r["vec_id"]) for r in got} & {(a, c) for a, _, c, _ in want}) >= 0.95 * len(want)
    assert len(got) == len(want)
