"""Media columns: texts kept losslessly as FLAC, read back as PCM blocks.

A text's payload is its UTF-8 bytes followed by bytes 255 up to a positive
multiple of one block (576 samples); see ``flac`` for the stream.

Defined results
* null text: as an empty text, one block of 255s.  Equal texts give equal streams.
* a text of any length is coded and decoded a chunk of frames at a time.
* null ids and repeated rows pass through row by row; extra columns are not read.
* a damaged stream raises ``ValueError``: no samples are made up.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.llm import flac
from textquarry.llm import kernels as K

DIGESTS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
BLOCKS = "doc_id long, block long, sample_offset long, n_samples int, byte_offset long, pcm binary"


def padded(text: bytes) -> bytes:
    """A payload: the text's bytes and 255s up to a positive multiple of a block."""
    size = max(flac.BLOCK, -(-len(text) // flac.BLOCK) * flac.BLOCK)
    return text + b"\xff" * (size - len(text))


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, list[bytes]]]:
    """Ids and UTF-8 texts of runs of rows of bounded size."""
    for a, b, buf, off in K.runs(batch.column(1)):
        raw = buf.tobytes()
        yield batch.column(0).slice(a, b - a), [raw[off[i] : off[i + 1]] for i in range(b - a)]


def feature_of(payload: bytes) -> str:
    """Whole-number features of the samples: mean, energy, zero crossings and peak."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    return f"blocks={len(x) // flac.BLOCK};mean={int(x.sum()) // len(x)};energy={int((x * x).sum()) // len(x)};crossings={crossings};peak={int(np.abs(x).max())}"


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for ids, texts in _texts(batch):
            yield pa.RecordBatch.from_arrays([ids, pa.array([len(t) for t in texts], pa.int64()), pa.array(flac.streams([padded(t) for t in texts]), pa.binary())], ["doc_id", "n_bytes", "media"])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sha = lambda b: hashlib.sha256(b).hexdigest()
    for batch in batches:
        for ids, texts in _texts(batch):
            stored = flac.streams([padded(t) for t in texts])
            back = flac.payloads(stored)
            yield pa.RecordBatch.from_arrays(
                [
                    ids,
                    pa.array([len(t) for t in texts], pa.int64()),
                    pa.array([len(p) for p in back], pa.int64()),
                    pa.array([sha(p) for p in back]),
                    pa.array([zlib.crc32(p[-32:]) for p in back], pa.int64()),
                    pa.array([len(s) for s in stored], pa.int64()),
                    pa.array([sha(s) for s in stored]),
                    pa.array([feature_of(p) for p in back]),
                ],
                DIGESTS_NAMES,
            )


DIGESTS_NAMES = [c.split()[0] for c in DIGESTS.split(", ")]


#: Bytes of streams that are decoded together.
TOGETHER = 1 << 20


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, stored = batch.column(0).to_pylist(), batch.column(1)
        start = 0
        while start < len(batch):
            end, size = start, 0
            while end < len(batch) and (end == start or size < TOGETHER):
                size += len(stored[end].as_buffer() or b"")
                end += 1
            some = [(i, stored[i].as_py()) for i in range(start, end) if stored[i].is_valid]
            for (i, s), pcm in zip(some, flac.payloads([s for _, s in some])):
                at = flac.Stream(s).starts()
                for a in range(0, len(at), flac.CHUNK):
                    n = min(flac.CHUNK, len(at) - a)
                    no = np.arange(a, a + n, dtype=np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([ids[i]] * n, pa.int64()),
                            pa.array(no),
                            pa.array(no * flac.BLOCK),
                            pa.array(np.full(n, flac.BLOCK, np.int32)),
                            pa.array(at[a : a + n]),
                            pa.array([pcm[j * flac.BLOCK : (j + 1) * flac.BLOCK] for j in range(a, a + n)], pa.binary()),
                        ],
                        [c.split()[0] for c in BLOCKS.split(", ")],
                    )
            start = end


def _pairs(df: DataFrame, value: str, row_id: str) -> DataFrame:
    return df.select(F.col(row_id).cast("long").alias("doc_id"), F.col(value))


def to_flac(docs: DataFrame, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes, media: the FLAC stream of each text's payload."""
    return _pairs(docs, text, row_id).mapInArrow(_encode, "doc_id long, n_bytes long, media binary")


def pcm_blocks(media: DataFrame, column: str = "media", row_id: str = "doc_id") -> DataFrame:
    """A row for each PCM block of each stream, with the sample and byte offset it begins at."""
    return _pairs(media, column, row_id).mapInArrow(_blocks, BLOCKS)


def media_digests(docs: DataFrame, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """Stores each text as FLAC, reads the stream back and describes both; see ``DIGESTS``.

    The stream lives only in the worker that makes and reads it, so the corpus is
    passed over once and nothing is exchanged.
    """
    return _pairs(docs, text, row_id).mapInArrow(_digest, DIGESTS)
