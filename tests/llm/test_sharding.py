import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from textquarry.llm.registry import QUERIES
from textquarry.llm.sharding import histogram_shards


def check(rows, got, n):
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in got) == sorted((str(r[0]), str(r[1])) for r in rows)
    sizes = [0] * n
    for r in got:
        assert r["size"] == len((r["text"] or "").encode()) + 1
        sizes[r["shard"]] += r["size"]
    for k in range(n):
        assert sorted(r["slot"] for r in got if r["shard"] == k) == list(range(sum(r["shard"] == k for r in got)))
    return sizes


def test_shards_are_even(frame, corpus):
    got = histogram_shards(frame(corpus, clash=True), 8).collect()
    sizes = check(corpus, got, 8)
    widest = max(len(r[1]) + 1 for r in corpus)
    assert all(abs(s - sum(sizes) / 8) <= widest for s in sizes)


def test_one_text_everywhere(frame):
    rows = [(i, "the same text", "en", "s", None) for i in range(3000)]
    sizes = check(rows, histogram_shards(frame(rows), 8).collect(), 8)
    assert max(sizes) - min(sizes) <= 2 * 14 + sum(sizes) * 0.002


def test_repeated_rows_are_dealt_evenly(frame):
    rows = [(7, "the same row", "en", "s", None)] * 3000 + [(i, f"another text {i}", "en", "s", None) for i in range(100)]
    sizes = check(rows, histogram_shards(frame(rows), 8).collect(), 8)
    assert max(sizes) - min(sizes) <= 2 * 20 + sum(sizes) * 0.002


def test_against_the_sorted_rows(spark, frame, corpus):
    """Shards are runs of the rows in key order, cut where the bytes before come nearest to equal shares; slots count in that order."""
    got = histogram_shards(frame(corpus), 5, tolerance=0.0)
    rows = got.selectExpr("xxhash64(text) as h", "doc_id", "size", "shard", "slot").collect()
    rows.sort(key=lambda r: (r["h"], r["doc_id"]))
    total, before, ends = sum(r["size"] for r in rows), 0, []
    for i, r in enumerate(rows):
        ends.append((before, i))
        before += r["size"]
    cuts = [min(ends + [(total, len(rows))], key=lambda e: (abs(e[0] - k * total / 5), e[1]))[1] for k in range(1, 5)]
    for i, r in enumerate(rows):
        shard = sum(c <= i for c in cuts)
        assert (r["shard"], r["slot"]) == (shard, i - ([0] + cuts)[shard])


def test_odd_rows_and_empty_table(frame, odd):
    check(odd, histogram_shards(frame(odd, clash=True), 8).collect(), 8)
    out = histogram_shards(frame([]), 8)
    assert out.count() == 0 and out.columns[-3:] == ["size", "shard", "slot"]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(-9, 9), st.sampled_from(["", "a", "bb", "c" * 50])), min_size=1, max_size=40))
def test_any_rows(frame, rows):
    rows = [(i, t, None, None, None) for i, t in rows]
    check(rows, histogram_shards(frame(rows), 3).collect(), 3)


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001"])
def test_query(spark, folder):
    got = QUERIES["op7_histogram_sort"](spark, folder).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    assert len(got) == len(texts)
    assert all(r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode()) and r["law"] == "bytes" and r["grown_shard"] is None for r in got)
