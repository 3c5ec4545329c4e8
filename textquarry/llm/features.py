"""Sparse hashed words and structure statistics of texts, and samples to learn from."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.llm import kernels as K

STATS = (
    "log_bytes log_words log_lines word_length upper digit symbol pipe space_share non_ascii "
    "distinct_words top_word distinct_triples repeated_neighbour short_words marked_words line_length meta_length"
).split()

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, bool)
_LOWER[97:123] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_HIGH = np.zeros(256, bool)
_HIGH[128:] = True
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_SYMBOL = ~(_UPPER | _LOWER | _DIGIT | _HIGH | _SPACE)
_SYMBOL[[ord(c) for c in ".,'-"]] = False


def bag(h: np.ndarray, doc: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, bucket, count) of the hashed words of a run, by document and bucket."""
    key = doc.astype(np.int64) << bits | (h >> K.U(64 - bits)).astype(np.int64)
    u, n = np.unique(key, return_counts=True)
    return u >> bits, u & ((1 << bits) - 1), n


def _byte_counts(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """How often each byte stands in each document (documents x 256), a piece of a long text at a time."""
    out = np.zeros((len(off) - 1, 256), np.int64)
    if len(out) == 1:
        for a in range(0, len(buf), K.RUN_BYTES):
            out[0] += np.bincount(buf[a : a + K.RUN_BYTES], minlength=256)
    elif len(buf):
        owner = np.repeat(np.arange(len(out)), np.diff(off))
        out = np.bincount(owner << 8 | buf, minlength=len(out) << 8).reshape(-1, 256)
    return out


def stats(buf: np.ndarray, off: np.ndarray, h: np.ndarray, doc: np.ndarray, start: np.ndarray, end: np.ndarray, meta: np.ndarray) -> np.ndarray:
    """Structure statistics (documents x STATS) of a run; shares of nothing are 0."""
    n = len(off) - 1
    size = np.diff(off).astype(float)
    byte = _byte_counts(buf, off)
    per = lambda mask: byte[:, mask].sum(axis=1)
    lines = byte[:, 10] + 1.0
    w = np.bincount(doc, minlength=n).astype(float)
    length = np.bincount(doc, weights=end - start, minlength=n)
    some = lambda a, b: a / np.maximum(b, 1)
    d, _, c = bag(h, doc, 32)
    top = np.zeros(n)
    np.maximum.at(top, d, c)
    sh, at = K.shingles(h, doc, n, 3)
    sd = np.repeat(np.arange(n), np.diff(at))
    triples = np.bincount(bag(sh, sd, 32)[0], minlength=n)
    same = np.flatnonzero((h[1:] == h[:-1]) & (doc[1:] == doc[:-1])) if len(h) > 1 else np.zeros(0, np.int64)
    last = buf[end - 1] if len(end) else np.zeros(0, np.uint8)
    out = [
        np.log1p(size), np.log1p(w), np.log1p(lines), some(length, w),
        some(per(_UPPER), size), some(per(_DIGIT), size), some(per(_SYMBOL), size), some(byte[:, 124], w),
        some(per(_SPACE), size), some(per(_HIGH), size),
        some(np.bincount(d, minlength=n), w), some(top, w), some(triples, np.maximum(w - 2, 1)), some(np.bincount(doc[same], minlength=n), w),
        some(np.bincount(doc[end - start <= 2], minlength=n), w), some(np.bincount(doc[_SYMBOL[last]], minlength=n), w),
        np.log1p(some(size, lines)), np.log1p(np.where(np.isnan(meta), size, np.maximum(meta, 0))),
    ]
    return np.stack(out, axis=1).astype(np.float32)


def documents(batches: Iterator[pa.RecordBatch], bits: int, with_stats: bool):
    """For each run of rows of (id, text, n_chars): ids, rows, bag, statistics."""
    for batch in batches:
        meta = batch.column(2).cast(pa.float64()).to_numpy(zero_copy_only=False) if with_stats else None
        for a, b, buf, off in K.runs(batch.column(1)):
            h, doc, start, end = K.words(buf, off)
            dense = stats(buf, off, h, doc, start, end, meta[a:b]) if with_stats else None
            yield batch, a, b, bag(h, doc, bits), dense


def held_out(row_id: str = "doc_id"):
    """True for the fifth of all ids that nothing is learnt from."""
    return F.coalesce(F.crc32(F.col(row_id).cast("string")) % 5 == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, max_rows: int, row_id: str = "doc_id") -> DataFrame:
    """doc_id, text, n_chars, label of at most ``max_rows`` labelled rows that are not held out.

    The rows with the smallest hashes of their ids are taken, so the sample is
    the same on every run.  An id labelled twice has its smaller label; of rows that
    share an id the one with the smallest text hash is taken.
    """
    known = labels.select(F.col(row_id).cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).dropna()
    known = known.where(~held_out()).groupBy("doc_id").agg(F.min("label").alias("label"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    # max_rows bounds this side, so it may be broadcast at any size of the corpus.
    rows = with_meta(docs, row_id).join(F.broadcast(known), "doc_id")
    one = rows.groupBy("doc_id", "label").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text", "n_chars")).alias("r"))
    return one.select("doc_id", "r.text", "r.n_chars", "label")


def with_meta(docs: DataFrame, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text, n_chars (null where the input has no such column)."""
    n = F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")
    return docs.select(F.col(row_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), n.alias("n_chars"))


def collect_bags(rows: DataFrame, bits: int, with_stats: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features of a bounded sample on the driver: offsets, buckets, counts, statistics, labels (by doc_id)."""

    def extract(batches):
        for batch, a, b, (d, bucket, n), dense in documents(batches, bits, with_stats):
            at = np.concatenate(([0], np.cumsum(np.bincount(d, minlength=b - a)))).astype(np.int32)
            lists = lambda values: pa.ListArray.from_arrays(pa.array(at), pa.array(values.astype(np.int32)))  # noqa: E731,B023
            dense = dense if dense is not None else np.zeros((b - a, 0), np.float32)
            k = dense.shape[1]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a), batch.column(3).slice(a, b - a).cast(pa.int32()), lists(bucket), lists(n), pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1, dtype=np.int32) * k), pa.array(dense.ravel()))],
                ["doc_id", "label", "bucket", "n", "dense"],
            )

    got = rows.select("doc_id", "text", "n_chars", "label").mapInArrow(extract, "doc_id long, label int, bucket array<int>, n array<int>, dense array<float>").toArrow().combine_chunks().sort_by("doc_id")
    size = np.array(got["bucket"].combine_chunks().value_lengths().to_numpy(zero_copy_only=False), np.int64) if len(got) else np.zeros(0, np.int64)
    flat = lambda c, t: np.asarray(got[c].combine_chunks().flatten(), t) if len(got) else np.zeros(0, t)
    dense = flat("dense", np.float32).reshape(len(got), -1) if len(got) else np.zeros((0, len(STATS) if with_stats else 0), np.float32)
    return np.concatenate(([0], np.cumsum(size))), flat("bucket", np.int64), flat("n", np.float32), dense, np.asarray(got["label"].to_numpy(), np.int64)
