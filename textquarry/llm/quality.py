"""Quality classifier: a factorisation machine over hashed words and structure.

score = sigmoid(w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j), where the
pairwise term is 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2), linear in the
number of features.  x has the logarithms of the counts of hashed words, scaled
to length 1, and standardised structure statistics and metadata (``features.STATS``,
with ``n_chars``).  Labels, language, source and ids are never inputs.

Learnt by AdaGrad on a bounded sample of labelled rows that are not held out
(``max_rows``, 6000 by default); every text is scored whole.

Defined results
* null or empty text: no words; scored by its statistics (all zero).
* no labelled rows at all: every score is 0.5.
* null ids are scored, and not held out; repeated rows are scored alike.
* empty table: no rows.  Extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.llm import features as X

BITS, RANK = 16, 8


@dataclass
class FactorisationMachine:
    """Weights of words (first 2 ** BITS) and statistics (the rest)."""

    w0: float
    w: np.ndarray
    v: np.ndarray
    centre: np.ndarray
    scale: np.ndarray

    def matrix(self, off: np.ndarray, bucket: np.ndarray, n: np.ndarray, dense: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, feature and value of all features; ``off`` bounds each row's words."""
        rows = len(off) - 1
        row = np.repeat(np.arange(rows), np.diff(off))
        x = np.log1p(n).astype(np.float32)
        norm = np.sqrt(np.bincount(row, weights=x * x, minlength=rows))
        x = x / np.maximum(norm, 1e-9)[row]
        z = np.clip((dense - self.centre) / self.scale, -5, 5) / 2
        k = dense.shape[1]
        return np.concatenate((row, np.repeat(np.arange(rows), k))), np.concatenate((bucket, np.tile(np.arange(k) + (1 << BITS), rows))), np.concatenate((x, z.ravel())).astype(np.float32)

    def margins(self, rows: int, row: np.ndarray, at: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The score before the sigmoid, and sum_i v_if x_i of each row."""
        out = self.w0 + np.bincount(row, weights=self.w[at] * x, minlength=rows)
        sums = np.empty((rows, self.v.shape[1]))
        for f in range(self.v.shape[1]):
            t = self.v[at, f] * x
            sums[:, f] = np.bincount(row, weights=t, minlength=rows)
            out += 0.5 * (sums[:, f] ** 2 - np.bincount(row, weights=t * t, minlength=rows))
        return out, sums


def train(off, bucket, n, dense, label, epochs: int = 12, batch: int = 256, rate: float = 0.08, l2: float = 1e-4, seed: int = 7) -> FactorisationMachine:
    """AdaGrad on the logistic loss."""
    rng = np.random.Generator(np.random.PCG64(seed))
    k = dense.shape[1]
    size = (1 << BITS) + k
    centre = dense.mean(axis=0) if len(dense) else np.zeros(k)
    scale = np.maximum(dense.std(axis=0), 1e-3) if len(dense) else np.ones(k)
    m = FactorisationMachine(0.0, np.zeros(size), rng.normal(0, 0.02, (size, RANK)), centre, scale)
    if len(label) == 0:
        m.v[:] = 0
        return m
    p = min(max(label.mean(), 1e-3), 1 - 1e-3)
    m.w0 = float(np.log(p / (1 - p)))
    g0, gw, gv = 1e-2, np.full(size, 1e-2), np.full((size, RANK), 1e-2)
    for _ in range(epochs):
        order = rng.permutation(len(label))
        for a in range(0, len(order), batch):
            pick = order[a : a + batch]
            lengths = off[pick + 1] - off[pick]
            o = np.concatenate(([0], np.cumsum(lengths)))
            take = np.arange(o[-1]) + np.repeat(off[pick] - o[:-1], lengths)
            row, at, x = m.matrix(o, bucket[take], n[take], dense[pick])
            s, sums = m.margins(len(pick), row, at, x)
            g = (1 / (1 + np.exp(-np.clip(s, -30, 30))) - label[pick]) / len(pick)
            d = g.sum()
            g0 += d * d
            m.w0 -= rate * d / np.sqrt(g0)
            used, inv = np.unique(at, return_inverse=True)
            gx = g[row] * x
            d = np.bincount(inv, weights=gx) + l2 * m.w[used]
            gw[used] += d * d
            m.w[used] -= rate * d / np.sqrt(gw[used])
            gxx = gx * x
            own = np.bincount(inv, weights=gxx)
            for f in range(RANK):
                d = np.bincount(inv, weights=gx * sums[row, f]) - own * m.v[used, f] + l2 * m.v[used, f]
                gv[used, f] += d * d
                m.v[used, f] -= rate * d / np.sqrt(gv[used, f])
    return m


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = 6000) -> FactorisationMachine:
    """The machine learnt from at most ``max_rows`` labelled rows that are not held out."""
    return train(*X.collect_bags(X.sample(docs, labels, label, max_rows), BITS, True))


def scores(docs: DataFrame, machine: FactorisationMachine, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """doc_id, score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)  # of fixed size

    def score(batches):
        m = shared.value
        for batch, a, b, (d, bucket, n), dense in X.documents(batches, BITS, True):
            off = np.concatenate(([0], np.cumsum(np.bincount(d, minlength=b - a))))
            s, _ = m.margins(b - a, *m.matrix(off, bucket, n.astype(np.float32), dense))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(1 / (1 + np.exp(-np.clip(s, -30, 30))))], ["doc_id", "score"])

    return X.with_meta(docs, row_id, text).mapInArrow(score, "doc_id long, score double")


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, max_rows: int = 6000) -> DataFrame:
    """doc_id, held_out, score, predicted (1 where the score is at least ``threshold``)."""
    out = scores(docs, fit(docs, labels, max_rows=max_rows))
    return out.select("doc_id", X.held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, max_rows: int = 6000, text: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score is at least ``threshold``; nothing is exchanged."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, max_rows=max_rows))  # of fixed size
    at, meta = docs.columns.index(text), docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def keep(batches):
        m = shared.value
        for batch in batches:
            n = batch.column(meta).cast(pa.int64()) if meta is not None else pa.nulls(len(batch), pa.int64())
            triple = pa.RecordBatch.from_arrays([pa.nulls(len(batch), pa.int64()), batch.column(at), n], ["doc_id", "text", "n_chars"])
            good = []
            for _, a, b, (d, bucket, count), dense in X.documents(iter([triple]), BITS, True):
                off = np.concatenate(([0], np.cumsum(np.bincount(d, minlength=b - a))))
                s, _ = m.margins(b - a, *m.matrix(off, bucket, count.astype(np.float32), dense))
                good.append(1 / (1 + np.exp(-np.clip(s, -30, 30))) >= threshold)
            yield batch.filter(pa.array(np.concatenate(good) if good else np.zeros(0, bool)))

    return docs.mapInArrow(keep, docs.schema)
