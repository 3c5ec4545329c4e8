"""Benchmark decontamination by SimHash windows, multi-index Hamming blocks and exact checks.

A document leaks an item if one of its windows of the item's length (in words;
the whole document where it is shorter) has a weighted similarity of at least
``similarity`` with it: sum of min over sum of max of the counts of their k-word
shingles (a text of fewer than k words is one shingle).

1. Such a window shares a shingle with the item, so only windows over a shared
   shingle are looked at: an exact filter, by a bit table and a sorted list.
2. A window's SimHash is the sign of the sum of its shingles' bits, by prefix sums.
   Items of one length are indexed by the 8 bytes of their SimHash: fingerprints
   within ``RADIUS`` = 23 bits agree in some byte up to 23 // 8 = 2 bits, so probing
   each byte with all changes of up to two bits finds every item in the radius.
   At similarity 0.8 the distance is 9.7 +- 2.9 bits: 23 is 4.6 deviations away.
3. The similarity of each candidate is computed exactly.

The index of a block of items (at most ``BLOCK_BYTES`` of text, measured) is
broadcast; a larger benchmark is taken block by block, each against all rows, and
the driver holds one block at a time.  Windows are looked at in pieces of
neighbouring ones, so memory does not grow with the text between hits.

Defined results
* null or empty texts and items leak nothing; null ids pass through as null.
* repeated rows each have their own result; items of the same text each a row.
* of windows of the same similarity the first counts; empty tables: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.llm import kernels as K
from textquarry.session import Scratch

RADIUS, BLOCK_BYTES = 23, 8 << 20
#: Hits and window starts looked at together.
HITS, PIECE = 1 << 16, 1 << 12
_FLIPS = np.array(sorted({sum(1 << b for b in c) for r in range(RADIUS // 8 + 1) for c in combinations(range(8), r)}), np.uint8)
_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)
LEAKS = "doc_id long, item_id long, similarity double, start long, end long"


@dataclass
class _Sized:
    """Items of one length in words: shingle counts, fingerprints, and tables by fingerprint byte."""

    words: int
    k: int
    ids: list[int] = field(default_factory=list)
    keys: list[np.ndarray] = field(default_factory=list)
    counts: list[np.ndarray] = field(default_factory=list)
    prints: np.ndarray | None = None
    by_byte: np.ndarray | None = None


def _fingerprints(sums: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Fingerprint bytes (rows x 8) of bit sums (rows x 64) over n shingles each."""
    return np.packbits(2 * sums > n[:, None], axis=1)


def _bits(sh: np.ndarray) -> np.ndarray:
    return np.unpackbits(sh.view(np.uint8).reshape(-1, 8), axis=1)


class Index:
    """The items of one block of the benchmark."""

    def __init__(self, items: list[tuple[int | None, str | None]], k: int):
        self.k, self.sized = k, {}
        every = []
        for item_id, text in items:
            for _, _, buf, off in K.runs(pa.array([text or ""]), 1 << 62):
                h, doc, _, _ = K.words(buf, off)
                if not len(h):
                    continue
                sh, _ = K.shingles(h, doc, 1, k)
                own = self.sized.setdefault(len(h), _Sized(len(h), k))
                keys, counts = np.unique(sh, return_counts=True)
                own.ids.append(item_id)
                own.keys.append(keys)
                own.counts.append(counts)
                every.append(keys)
                print_ = _fingerprints(_bits(sh).sum(axis=0, dtype=np.int64)[None, :], np.array([len(sh)]))
                own.prints = print_ if own.prints is None else np.concatenate((own.prints, print_))
        for own in self.sized.values():
            own.by_byte = _tables(own.prints)
        self.shingles = np.unique(np.concatenate(every)) if every else np.zeros(0, np.uint64)
        self.short = sorted(n for n in self.sized if n < k)
        self.table = np.zeros(1 << 22, bool)
        self.table[(self.shingles >> K.U(42)).astype(np.int64)] = True
        # Which lengths hold each shingle, so that a hit opens only windows of these lengths.
        pairs = [(i, n) for n, own in self.sized.items() if n >= k for i in np.searchsorted(self.shingles, np.unique(np.concatenate(own.keys)))]
        pairs = np.array(sorted(pairs), np.int64).reshape(-1, 2)
        self.first = np.searchsorted(pairs[:, 0], np.arange(len(self.shingles) + 1))
        self.lengths = pairs[:, 1]

    def hits(self, sh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of shingles that some item has, and which shingles they are."""
        at = np.flatnonzero(self.table[(sh >> K.U(42)).astype(np.int64)])
        if not len(at):
            return at, at
        i = np.minimum(np.searchsorted(self.shingles, sh[at]), len(self.shingles) - 1)
        ok = self.shingles[i] == sh[at]
        return at[ok], i[ok]

    def opened(self, at: np.ndarray, which: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(length, positions) of the hits, by length."""
        many = self.first[which + 1] - self.first[which]
        pos = np.repeat(at, many)
        n = self.lengths[np.repeat(self.first[which] - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(len(pos))]
        for one in np.unique(n).tolist():
            yield one, pos[n == one]

    def near(self, own: _Sized, prints: np.ndarray) -> Iterator[tuple[int, int]]:
        """(window, item) of all fingerprints within the radius."""
        n = len(own.ids)
        for a in range(0, len(prints), 4096):
            some = prints[a : a + 4096]
            hit = own.by_byte[0][some[:, 0]]
            for b in range(1, 8):
                hit = hit | own.by_byte[b][some[:, b]]
            w, i = np.nonzero(np.unpackbits(hit, axis=1, count=n))
            ok = _ONES[own.prints[i] ^ some[w]].sum(axis=1) <= RADIUS
            yield from zip((w[ok] + a).tolist(), i[ok].tolist())


def _tables(prints: np.ndarray) -> np.ndarray:
    """For each fingerprint byte and value, a bit set of the items within two bits of it."""
    near = np.zeros((8, 256, len(prints)), bool)
    rows = np.arange(len(prints))
    for b in range(8):
        for flip in _FLIPS:
            near[b, prints[:, b] ^ flip, rows] = True
    return np.packbits(near, axis=2)


def _similarity(sh: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> float:
    u, n = np.unique(sh, return_counts=True)
    _, a, b = np.intersect1d(u, keys, assume_unique=True, return_indices=True)
    both = int(np.minimum(n[a], counts[b]).sum())
    return both / (len(sh) + int(counts.sum()) - both)


def _pieces(hits: np.ndarray, span: int, last: int) -> Iterator[tuple[int, int]]:
    """(first, end) of runs of window starts, at most ``PIECE`` each, of the windows of ``span`` shingles over the hits."""
    low, high = np.clip(hits - span + 1, 0, last), np.clip(hits, 0, last)
    head = np.flatnonzero(np.concatenate(([True], low[1:] > high[:-1] + 1)))
    for a, b in zip(low[head].tolist(), high[np.concatenate((head[1:] - 1, [len(hits) - 1]))].tolist()):
        for x in range(a, b + 1, PIECE):
            yield x, min(b + 1, x + PIECE)


def _best_windows(mine: np.ndarray, n_words: int, hits: np.ndarray, which: np.ndarray, index: Index, similarity: float) -> Iterator[tuple[_Sized, int, float, int]]:
    """(length, item, similarity, first word) of the best window of each item that one text leaks."""
    best: dict[tuple[int, int], tuple[float, int]] = {}
    for h in range(0, len(hits), HITS):
        for n, at in index.opened(hits[h : h + HITS], which[h : h + HITS]):
            own, span = index.sized[n], max(1, min(n, n_words) - index.k + 1)
            for a, b in _pieces(at, span, max(0, len(mine) - span)):
                sums = np.concatenate((np.zeros((1, 64), np.int32), np.cumsum(_bits(mine[a : b + span - 1]), axis=0, dtype=np.int32)))
                for w, j in index.near(own, _fingerprints(sums[span:] - sums[:-span], np.full(b - a, span))):
                    x = _similarity(mine[a + w : a + w + span], own.keys[j], own.counts[j])
                    if x >= similarity and ((n, j) not in best or x > best[n, j][0]):
                        best[n, j] = x, a + w
    for (n, j), (x, s) in sorted(best.items()):
        yield index.sized[n], j, x, s


def _short_runs(h: np.ndarray, index: Index) -> Iterator[tuple[_Sized, int, float, int]]:
    """The same for items of n < k words, which are one shingle: any equal run of n words leaks them."""
    for n in index.short:
        own, run = index.sized[n], K.whole(h, n)
        keys = np.concatenate(own.keys)
        at = np.flatnonzero(np.isin(run, keys))
        found, first = np.unique(run[at], return_index=True)
        place = dict(zip(found.tolist(), at[first].tolist()))
        for j, key in enumerate(keys.tolist()):
            if key in place:
                yield own, j, 1.0, place[key]


def _code_points(buf: np.ndarray, at: list[int]) -> dict[int, int]:
    """The number of code points before each of some places, by one pass over the bytes."""
    out, total, last = {}, 0, 0
    for p in sorted(set(at)):
        total += int(((buf[last:p] & 0xC0) != 0x80).sum())
        out[p], last = total, p
    return out


def leaks_of(column: pa.Array, index: Index, similarity: float) -> list[tuple[int, int | None, float, int, int]]:
    """(row, item, similarity, start, end) of a column of texts; start and end in code points."""
    out = []
    for a, b, buf, off in K.runs(column):
        h, doc, start, end = K.words(buf, off)
        if not len(h):
            continue
        first = np.concatenate(([0], np.cumsum(K.counts(doc, b - a))))
        sh, at = K.shingles(h, doc, b - a, index.k)
        hits, which = index.hits(sh)
        bounds = np.searchsorted(hits, at)
        for d in range(b - a) if index.short else np.flatnonzero(np.diff(bounds)).tolist():
            x, y = bounds[d], bounds[d + 1]
            w = slice(first[d], first[d + 1])
            found = list(_short_runs(h[w], index))
            if x < y:
                found += _best_windows(sh[at[d] : at[d + 1]], first[d + 1] - first[d], hits[x:y] - at[d], which[x:y], index, similarity)
            if not found:
                continue
            spans = [(start[w][s], end[w][s + min(own.words, first[d + 1] - first[d]) - 1]) for own, _, _, s in found]
            chars = _code_points(buf[off[d] : off[d + 1]], [int(p - off[d]) for span in spans for p in span])
            out += [(a + d, own.ids[j], x, chars[int(s - off[d])], chars[int(e - off[d])]) for (own, j, x, _), (s, e) in zip(found, spans)]
    return out


def blocks(benchmark: DataFrame, k: int, text: str = "text", item_id: str = "item_id") -> Iterator[tuple[Index, bool]]:
    """Indexes of the benchmark, each of at most ``BLOCK_BYTES`` of text (or one item), and whether it is the last."""
    rows = benchmark.select(F.col(item_id).cast("long").alias("i"), F.col(text).cast("string").alias("t"))
    held, size = [], 0
    for r in rows.toLocalIterator():
        more = len((r["t"] or "").encode())
        if held and size + more > BLOCK_BYTES:
            yield Index(held, k), False
            held, size = [], 0
        held.append((r["i"], r["t"]))
        size += more
    yield Index(held, k), True


def find_leaks(docs: DataFrame, benchmark: DataFrame, k: int = 5, similarity: float = 0.8, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """doc_id, item_id, similarity, start, end: each leaked item of each document, at its best window."""
    spark = docs.sparkSession
    rows = docs.select(F.col(row_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    scratch, out = Scratch(spark, "leaks"), None
    for index, last in blocks(benchmark, k):
        shared = spark.sparkContext.broadcast(index)

        def scan(batches, shared=shared):
            for batch in batches:
                found = leaks_of(batch.column(1), shared.value, similarity)
                at = pa.array([f[0] for f in found], pa.int64())
                cols = [pa.array([f[i] for f in found], t) for i, t in ((1, pa.int64()), (2, pa.float64()), (3, pa.int64()), (4, pa.int64()))]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), *cols], ["doc_id", "item_id", "similarity", "start", "end"])

        one = rows.mapInArrow(scan, LEAKS)
        if not last:
            one = scratch.write(one, "block")
            shared.destroy()
        out = one if out is None else out.unionByName(one)
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, k: int = 5, similarity: float = 0.8, text: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that leak no item; nothing is exchanged."""
    spark, at = docs.sparkSession, docs.columns.index(text)
    scratch = Scratch(spark, "clean")
    for index, last in blocks(benchmark, k):
        shared = spark.sparkContext.broadcast(index)

        def keep(batches, shared=shared):
            for batch in batches:
                clean = np.ones(len(batch), bool)
                clean[[f[0] for f in leaks_of(batch.column(at), shared.value, similarity)]] = False
                yield batch.filter(pa.array(clean))

        kept = docs.mapInArrow(keep, docs.schema)
        if not last:
            before, kept = docs, scratch.write(kept, "block")
            scratch.forget(before)
            shared.destroy()
        docs = kept
    return docs
