import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n):
    words = [a + b for a in ("ka", "lo", "mi", "re", "tu", "vo") for b in ("n", "rs", "la", "st", "pe", "dum", "tra")]
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """Prose with exact and near copies, in plain tuples."""
    rng = random.Random(4)
    rows = []
    for i in range(60):
        rows.append((i, prose(rng, rng.randint(40, 120)), "en", f"s{i % 3}", None))
    for i in range(60, 90):
        words = rows[rng.randrange(20)][1].split()
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = "edit" + str(rng.randrange(99))
        rows.append((i, " ".join(words), "en", "s0", 5))
    rows += [(90 + i, rows[3][1], "en", "s0", None) for i in range(25)]
    return rows


@pytest.fixture(scope="session")
def odd():
    """Nulls in every column, empty and long texts, ties, repeated rows."""
    return [
        (None, "a text without an id that has some words", None, None, None),
        (1, None, "en", "x", 3), (2, "", "en", "x", 0), (3, "  \n\t ", None, "x", None), (4, "word", "en", None, 4),
        (5, "two words", "en", "x", 9), (5, "two words", "en", "x", 9), (6, "two words", "de", "y", 9),
        (7, "long " * 30000, "en", "x", 150000), (8, "x" * 200000, "en", "z", None),
        (9, "mail a.b@c.example.com or +1 (645) 555-3345 from 10.0.0.1\nTOKEN token = \"1beb58b8af68854f0e01b4ad40cdbb6ae7f578ae\"", "en", "x", None),
        (10, "ÄÖÜ ß 漢字 🙂 text", "de", "y", None),
    ]


@pytest.fixture(scope="session")
def frame(spark):
    """Builds a documents frame with columns whose names clash with outputs."""
    from pyspark.sql import functions as F

    def build(rows, clash=False):
        df = spark.createDataFrame(rows, SCHEMA)
        if clash:
            for name in ("size", "shard", "slot", "score", "kept", "component_id", "tokens", "weight", "epoch", "block", "label", "n", "rep", "value", "clean_text", "bands"):
                df = df.withColumn(name, F.lit("clash"))
        return df

    return build
