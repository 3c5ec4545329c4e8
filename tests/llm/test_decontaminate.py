import random
import re
from collections import Counter

import numpy as np
import pytest

from textquarry.llm import decontaminate as D


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())


def grams(w, k):
    return Counter([tuple(w)]) if 0 < len(w) < k else Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))


def brute(rows, items, k=5, t=0.8):
    out = []
    for r in rows:
        d = words(r[1])
        for item_id, text in items:
            b = words(text)
            if not b or not d:
                continue
            n = min(len(b), len(d))
            best = None
            for s in range(len(d) - n + 1):
                x, y = grams(d[s : s + n], k), grams(b, k)
                if len(b) < k and len(d[s : s + n]) != len(b):
                    continue
                sim = sum((x & y).values()) / sum((x | y).values())
                if sim >= t and (best is None or sim > best):
                    best = sim
            if best is not None:
                out.append((r[0], item_id, round(best, 9)))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def leaky(corpus):
    rng = random.Random(8)
    vocab = [f"b{i}" for i in range(200)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(n))) for i, n in enumerate((3, 4, 5, 12, 30, 60, 90))] + [(50, None), (51, " "), (52, "B1 b2  B3 b4 b5 b6 b7")]
    rows = []
    for i, r in enumerate(corpus[:40]):
        w = r[1].split()
        item = items[i % 7][1].split()
        if i % 3:
            if i % 4 == 0 and len(item) > 40:
                item[len(item) // 2] = "changed"
            at = rng.randrange(len(w))
            w[at:at] = item
        rows.append((r[0], " ".join(w), *r[2:]))
    rows.append((500, items[4][1].upper(), None, None, None))
    rows.append((501, " ".join(items[5][1].split()[:55]), None, None, None))
    return rows, items


def test_matches_brute_force(spark, frame, leaky, odd):
    rows, items = leaky
    rows = rows + [(r[0] and r[0] + 1000, *r[1:]) for r in odd if len(r[1] or "") < 1000]
    got = D.find_leaks(frame(rows, clash=True), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted(((r["doc_id"], r["item_id"], round(r["similarity"], 9)) for r in got), key=str) == brute(rows, items)
    texts = {r[0]: r[1] for r in rows}
    for r in got:
        if r["similarity"] == 1.0:
            assert words(texts[r["doc_id"]][r["start"] : r["end"]]) == words(dict(items)[r["item_id"]])


def test_items_in_blocks_and_drop(spark, frame, leaky, monkeypatch):
    rows, items = leaky
    bench = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(D, "BLOCK_BYTES", 100)
    got = D.find_leaks(frame(rows), bench).collect()
    assert sorted(((r["doc_id"], r["item_id"], round(r["similarity"], 9)) for r in got), key=str) == brute(rows, items)
    kept = D.drop_leaks(frame(rows), bench)
    assert {r["doc_id"] for r in kept.collect()} == {r[0] for r in rows} - {d for d, _, _ in brute(rows, items)}


def test_hits_and_windows_in_small_pieces(leaky, monkeypatch):
    import pyarrow as pa

    rows, items = leaky
    index = D.Index(items, 5)
    texts = pa.array([r[1] for r in rows])
    whole = D.leaks_of(texts, index, 0.8)
    monkeypatch.setattr(D, "HITS", 3)
    monkeypatch.setattr(D, "PIECE", 2)
    assert D.leaks_of(texts, index, 0.8) == whole
    assert sorted(((rows[d][0], i, round(x, 9)) for d, i, x, _, _ in whole), key=str) == brute(rows, items)


def test_memory_does_not_grow_with_the_text_between_hits(leaky):
    import tracemalloc

    import pyarrow as pa

    index, item = D.Index(leaky[1], 5), leaky[1][5][1]
    text = pa.array([item + " filler é" * 400_000 + " " + item.upper()])
    D.leaks_of(text, index, 0.8)
    tracemalloc.start()
    got = D.leaks_of(text, index, 0.8)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [(i, x, s) for _, i, x, s, _ in got if i == 5] == [(5, 1.0, 0)]
    assert peak < 40 * len(text[0].as_py().encode())  # the words' hashes and places; the bits of windows would be 70 times


def test_every_fingerprint_in_the_radius_is_found():
    rng = np.random.default_rng(3)
    own = D._Sized(9, 5, ids=list(range(300)), prints=rng.integers(0, 256, (300, 8), np.uint8))
    own.by_byte = D._tables(own.prints)
    asked = own.prints[:200].copy()
    for row in asked:
        for bit in rng.choice(64, rng.integers(0, 26), replace=False):
            row[bit // 8] ^= 1 << (bit % 8)
    near = {(w, i) for w, p in enumerate(asked) for i in range(300) if int(D._ONES[own.prints[i] ^ p].sum()) <= D.RADIUS}
    assert set(D.Index([], 5).near(own, asked)) == near


def test_empty_tables(spark, frame, leaky):
    rows, items = leaky
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.find_leaks(frame(rows), none).count() == 0 and D.drop_leaks(frame(rows), none).count() == len(rows)
    assert D.find_leaks(frame([]), spark.createDataFrame(items, "item_id long, text string")).count() == 0
