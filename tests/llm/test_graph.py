import random

import pytest

from textquarry.llm.graph import merge_labels
from textquarry.session import Scratch


def closure(nodes, links):
    up = {v: v for v in nodes}

    def root(v):
        while up[v] != v:
            v = up[v]
        return v

    for a, b in links:
        up[max(root(a), root(b))] = min(root(a), root(b))
    return sorted((v, root(v)) for v in nodes)


def graphs():
    rng = random.Random(11)
    names = list(range(150))
    rng.shuffle(names)
    yield "shuffled chain", list(zip(names, names[1:]))
    yield "rising chain", [(i, i + 1) for i in range(150)]
    yield "zigzag", [p for i in range(60) for p in ((i, 150 - i), (150 - i, i + 1))]
    yield "random", [(rng.randrange(150), rng.randrange(150)) for _ in range(110)]
    yield "loops and repeats", [(3, 3), (4, 5), (5, 4), (4, 5)]
    yield "none", []


@pytest.mark.parametrize(("name", "links"), list(graphs()))
def test_labels_are_the_smallest_reachable_nodes(spark, name, links):
    nodes = list(range(152))
    labels = spark.createDataFrame([(v, v) for v in nodes], "node long, label long")
    got = merge_labels(labels, spark.createDataFrame(links, "a long, b long"), Scratch(spark, "graph"))
    assert sorted(map(tuple, got.collect())) == closure(nodes, links)
