"""Vectorised text kernels over Arrow string columns (numpy, no per-row Python).

Texts of one Arrow batch are cut into runs of about ``RUN_BYTES`` so that memory
stays bounded whatever the batch holds; a single longer text is a run of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

RUN_BYTES = 1 << 20

U = np.uint64
_WS = np.zeros(256, bool)
_WS[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_P = U(0x9E3779B97F4A7C15)
_P_INV = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_MULT = np.array([pow(0xD6E8FEB86659FD93, i + 1, 1 << 64) for i in range(64)], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and multiply)."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * U(0xA24BAED4963EE407))[_LOWER]
_BYTE_EXACT = mix(np.arange(1, 257, dtype=np.uint64) * U(0xA24BAED4963EE407))
for _t in (_BYTE, _BYTE_EXACT):
    _t[_WS] = 0
_POW = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POW[0]) < n:
        m = max(n, RUN_BYTES + (RUN_BYTES >> 2))
        for i, p in enumerate((_P, _P_INV)):
            a = np.full(m, p, np.uint64)
            a[0] = 1
            _POW[i] = np.multiply.accumulate(a)
    return _POW[0][:n], _POW[1][:n]


def runs(column: pa.Array | pa.ChunkedArray, run_bytes: int = RUN_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_string()) if column.null_count == 0 else column.fill_null("").cast(pa.large_string())
    n = len(column)
    if n == 0:
        return
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = int(np.searchsorted(off, off[a] + run_bytes, side="right")) - 1
        b = min(n, max(b, a + 1))
        yield a, b, data[off[a] : off[b]], off[a : b + 1] - off[a]
        a = b


def words(buf: np.ndarray, off: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, document index, start and end byte of each word of a run.

    A word is a longest run of bytes other than space and 9 to 13.
    """
    n = len(buf)
    if n == 0:
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z, z
    inside = ~_WS[buf]
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    heads = off[:-1][off[:-1] < n]
    before[heads] = False
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    tails = off[1:][off[1:] > 0] - 1
    after[tails] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    if len(start) == 0:
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z, z
    h = np.empty(len(start), np.uint64)
    value, a = _BYTE if lower else _BYTE_EXACT, 0
    while a < len(start):  # words of about RUN_BYTES at a time; all of them but in a long text
        b = max(a + 1, int(np.searchsorted(end, start[a] + RUN_BYTES, side="right")))
        low, high = int(start[a]), int(end[b - 1])
        if high - low <= RUN_BYTES:
            up, down = _powers(RUN_BYTES)
            h[a:b] = np.add.reduceat(value[buf[low:high]] * up[: high - low], start[a:b] - low) * down[start[a:b] - low]
        else:
            h[a] = _long_word(value, buf[low:high])
        a = b
    doc = np.searchsorted(off, start, side="right") - 1
    return mix(h), doc, start, end


def _long_word(value: np.ndarray, word: np.ndarray) -> int:
    """The sum of the bytes' values times rising powers, of one word of any length."""
    total, up = 0, _powers(RUN_BYTES)[0]
    for c in range(0, len(word), RUN_BYTES):
        piece = int((value[word[c : c + RUN_BYTES]] * up[: len(word) - c]).sum(dtype=np.uint64))
        total += piece * pow(int(_P), c, 1 << 64)
    return total & ((1 << 64) - 1)


def counts(doc: np.ndarray, n_docs: int) -> np.ndarray:
    return np.bincount(doc, minlength=n_docs).astype(np.int64)


def shingles(h: np.ndarray, doc: np.ndarray, n_docs: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles and where each document's begin (n_docs + 1 offsets).

    A document of fewer than k words (but at least one) has one shingle: all its words.
    """
    size = counts(doc, n_docs)
    first = np.concatenate(([0], np.cumsum(size)))
    n_sh = np.where(size >= k, size - k + 1, (size > 0).astype(np.int64))
    off = np.concatenate(([0], np.cumsum(n_sh)))
    out = np.zeros(off[-1], np.uint64)
    m = len(h) - k + 1
    if m > 0:
        full = np.zeros(m, np.uint64)
        for j in range(k):
            full += h[j : j + m] * _MULT[j]
        at = np.flatnonzero(doc[:m] == doc[k - 1 :])
        out[off[doc[at]] + (at - first[doc[at]])] = mix(full[at])
    for d in np.flatnonzero((size > 0) & (size < k)):
        w = h[first[d] : first[d + 1]]
        out[off[d]] = mix(np.array([(w * _MULT[: len(w)]).sum(dtype=np.uint64) + U(len(w) << 8)], np.uint64))[0]
    return out, off


def whole(h: np.ndarray, n: int) -> np.ndarray:
    """For each run of n words, the one shingle that a text of just these words has."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(m, U(n << 8), np.uint64)
    for j in range(n):
        total += h[j : j + m] * _MULT[j]
    return mix(total)


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """The sorted distinct shingle hashes of one text."""
    for _, _, buf, off in runs(pa.array([text or ""]), 1 << 62):
        h, doc, _, _ = words(buf, off)
        return np.unique(shingles(h, doc, 1, k)[0])
    return np.zeros(0, np.uint64)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
