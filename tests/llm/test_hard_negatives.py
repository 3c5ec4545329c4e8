import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from textquarry.llm.hard_negatives import hard_negatives
from textquarry.llm.registry import QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int, rank string"


def brute(rows, step):
    """All pairs, by the contract's words; rows (id, whole-number vector, label)."""
    out = []
    x = np.array([v for _, v, _ in rows], float)
    score = {}
    for a, (i, _, _) in enumerate(rows):
        if i % step == 0:
            score[a] = (x @ x[a]).astype(int)
    for a, s in score.items():
        order = sorted(range(len(rows)), key=lambda j: (-s[j], rows[j][0]))
        liked = [j for j in order if j != a and rows[j][2] == rows[a][2]][:5]
        for p in liked:
            bad = [j for j in order if rows[j][2] != rows[a][2] and 50 * s[p] <= 100 * s[j] <= 95 * s[p]][:3]
            out += [(rows[a][0], rows[p][0], r, rows[j][0], int(s[p]), int(s[j])) for r, j in enumerate(bad, 1)]
    return sorted(out)


def result(df):
    return sorted((r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"]) for r in df.collect())


def frame(spark, rows):
    return spark.createDataFrame([(i, v, c, "clash") for i, v, c in rows], SCHEMA)


@pytest.mark.parametrize(("dim", "options"), [(3, {}), (3, {"leaf_rows": 20, "sample_rows": 100}), (8, {"leaf_rows": 16, "query_rows": 5, "sample_rows": 64})])
def test_matches_all_pairs(spark, dim, options):
    rng = random.Random(dim)
    rows = [(i, [float(rng.randint(-9, 12)) for _ in range(dim)], rng.randrange(4)) for i in range(300)]
    rows += [(300 + i, rows[10][1], rng.randrange(4)) for i in range(80)] + [(380 + i, [float(rng.randint(90, 99)) for _ in range(dim)], i % 2) for i in range(40)]
    assert result(hard_negatives(frame(spark, rows), F.col("vec_id") % 10 == 0, **options)) == brute(rows, 10)


def test_large_pieces_use_their_lower_trees(spark):
    rng = random.Random(8)
    rows = [(i, [float(rng.gauss(c, 4) * 10 // 1) for c in ((i % 13) * 9, (i % 7) * 8)], i % 5) for i in range(3000)]
    assert result(hard_negatives(frame(spark, rows), F.col("vec_id") % 150 == 0)) == brute(rows, 150)


def test_odd_rows(spark):
    rows = [
        (0, [4.0, 0.0], 1), (1, None, 1), (2, [1.0, 1.0], None), (None, [4.0, 1.0], 1), (3, [float("nan"), 1.0], 1), (4, [None, 1.0], 1), (5, [float("inf"), 0.0], 2),
        (6, [4.0, 1.0], 1), (6, [4.0, 1.0], 1), (7, [3.0, 9.0], 2), (8, [1.0, 2.0, 3.0], 2), (9, [2.0, 0.0], 3), (10, [0.0, 0.0], 2), (50, [-3.0, 0.0], 1), (100, [0.0, 0.0], 7),
    ]
    whole = [r for r in rows if r[0] in (0, 7, 9, 10, 50, 100)] + [(6, [4.0, 1.0], 1)]
    assert result(hard_negatives(frame(spark, rows), F.col("vec_id") % 50 == 0)) == brute(whole, 50) != []


def test_empty_tables(spark):
    for rows in ([], [(1, [1.0], 1)], [(0, None, 1)], [(0, [1.0], 1)], [(0, [], 1), (1, [], 1), (2, [], 2)]):
        out = hard_negatives(frame(spark, rows), F.col("vec_id") % 50 == 0)
        assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
        assert result(out) == []


def test_query(spark):
    folder = "/root/testdata/sf0.01"
    rows = [(r["vec_id"], [math.floor(256 * x) for x in r["embedding"]], (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"]) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    assert result(QUERIES["op12_vantage_negatives"](spark, folder)) == brute(rows, 50)
