"""Toxicity severity: cumulative-link ordinal regression on sparse text features.

P(grade <= k) = sigmoid(theta_k - w . x) with ordered thresholds theta_1 < ... and
one weight vector w shared by all of them; x has log2(1 + count) of each hashed
word.  The output is the distribution's mean (expected severity), P(grade >= 1), and
a grade: 0 where P(grade >= 1) is below the learnt threshold, else the likeliest of the others.

The labels only tell toxic from not.  The ordered grades to learn from are made
of the training rows: *cue words* are words whose smoothed log odds of standing in
a toxic row are high; a toxic row's grade is 1, 2 or 3 for at most 2, at most 4, or
more occurrences of cue words, and any other row's grade is 0.  With a label of
more than two values its own order is used.

Learnt by AdaGrad with an L1 proximal step on at most ``max_rows`` (8000) labelled
rows that are not held out; every text is scored whole.

Defined results
* null or empty text: no features; scored by the thresholds alone.
* no labelled rows: score 0, severity 0 for all rows.
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

BITS = 18


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class OrdinalModel:
    w: np.ndarray
    theta: np.ndarray
    threshold: float = 0.5

    def distribution(self, off: np.ndarray, bucket: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Probability of each grade, rows x (thresholds + 1)."""
        rows = len(off) - 1
        row = np.repeat(np.arange(rows), np.diff(off))
        s = np.bincount(row, weights=self.w[bucket] * np.log2(1 + n), minlength=rows)
        below = _sigmoid(self.theta[None, :] - s[:, None])
        return np.diff(np.concatenate((np.zeros((rows, 1)), below, np.ones((rows, 1))), axis=1), axis=1)


def grades(off: np.ndarray, bucket: np.ndarray, n: np.ndarray, label: np.ndarray, odds: float = 2.5, least: int = 5) -> np.ndarray:
    """Ordered grades of training rows; see the module's text."""
    if len(np.unique(label)) > 2:
        return np.unique(label, return_inverse=True)[1]
    row = np.repeat(np.arange(len(label)), np.diff(off))
    hit = label[row] > 0
    size = 1 << BITS
    with_cue, without = np.bincount(bucket[hit], minlength=size), np.bincount(bucket[~hit], minlength=size)
    n1, n0 = max(1, int((label > 0).sum())), max(1, int((label <= 0).sum()))
    log_odds = np.log((with_cue + 0.5) / (n1 + 1)) - np.log((without + 0.5) / (n0 + 1))
    cue = (log_odds > odds) & (with_cue >= max(least, n1 // 50))
    count = np.bincount(row, weights=cue[bucket] * n, minlength=len(label))
    return np.where(label > 0, 1 + (count > 2) + (count > 4), 0).astype(np.int64)


def train(off, bucket, n, grade, epochs: int = 30, batch: int = 200, rate: float = 0.3, l1: float = 5e-4, seed: int = 11) -> OrdinalModel:
    """AdaGrad on the cumulative-link likelihood, with L1 shrinkage of the shared weights."""
    k = int(grade.max(initial=0))
    if k == 0:
        return OrdinalModel(np.zeros(1 << BITS), np.full(1, 30.0))
    rng = np.random.Generator(np.random.PCG64(seed))
    share = np.array([(grade <= j).mean() for j in range(k)])
    theta = np.log(share + 1e-3) - np.log(1 - share + 1e-3)
    w, gw, gt = np.zeros(1 << BITS), np.full(1 << BITS, 1e-2), np.full(k, 1e-2)
    x_all = np.log2(1 + n)
    for _ in range(epochs):
        order = rng.permutation(len(grade))
        for a in range(0, len(order), batch):
            pick = order[a : a + batch]
            lengths = off[pick + 1] - off[pick]
            o = np.concatenate(([0], np.cumsum(lengths)))
            take = np.arange(o[-1]) + np.repeat(off[pick] - o[:-1], lengths)
            at, x, y = bucket[take], x_all[take], grade[pick]
            row = np.repeat(np.arange(len(pick)), lengths)
            s = np.bincount(row, weights=w[at] * x, minlength=len(pick))
            t = np.concatenate(([-60.0], theta, [60.0]))
            high, low = _sigmoid(t[y + 1] - s), _sigmoid(t[y] - s)
            p = np.maximum(high - low, 1e-9)
            dh, dl = high * (1 - high) / p, low * (1 - low) / p
            d = np.bincount(np.clip(y, 0, k - 1), weights=-dh * (y < k), minlength=k) + np.bincount(np.clip(y - 1, 0, k - 1), weights=dl * (y > 0), minlength=k)
            d /= len(pick)
            gt += d * d
            theta -= rate * d / np.sqrt(gt)
            theta = np.maximum.accumulate(theta)  # thresholds stay in order
            g = (dh - dl) / len(pick)
            used, inv = np.unique(at, return_inverse=True)
            d = np.bincount(inv, weights=g[row] * x)
            gw[used] += d * d
            step = rate / np.sqrt(gw[used])
            new = w[used] - step * d
            w[used] = np.sign(new) * np.maximum(np.abs(new) - step * l1, 0)
    return OrdinalModel(w, theta)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_rows: int = 8000) -> OrdinalModel:
    """The model learnt from at most ``max_rows`` labelled rows that are not held out."""
    off, bucket, n, _, y = X.collect_bags(X.sample(docs, labels, label, max_rows), BITS, False)
    model = train(off, bucket, n, grades(off, bucket, n, y))
    model.threshold = best_threshold(1 - model.distribution(off, bucket, n)[:, 0], y > 0)
    return model


def best_threshold(score: np.ndarray, toxic: np.ndarray) -> float:
    """The middle of the gap between training scores with the best F1; 0.5 without toxic rows."""
    if not toxic.any() or toxic.all():
        return 0.5
    order = np.argsort(-score, kind="stable")
    s, hits = score[order], np.cumsum(toxic[order])
    f1 = 2 * hits / (np.arange(1, len(s) + 1) + toxic.sum())
    at = int(f1.argmax())
    return float((s[at] + s[min(at + 1, len(s) - 1)]) / 2)


def severities(docs: DataFrame, model: OrdinalModel, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """doc_id, score (P(grade >= 1)), severity (expected grade), grade (0 below the model's threshold, else the likeliest above 0)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def score(batches):
        m = shared.value
        for batch, a, b, (d, bucket, n), _ in X.documents(batches, BITS, False):
            off = np.concatenate(([0], np.cumsum(np.bincount(d, minlength=b - a))))
            p = m.distribution(off, bucket, n)
            grade = np.where(1 - p[:, 0] >= m.threshold, 1 + p[:, 1:].argmax(axis=1), 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a), pa.array(1 - p[:, 0]), pa.array(p @ np.arange(p.shape[1])), pa.array(grade.astype(np.int32))],
                ["doc_id", "score", "severity", "grade"],
            )

    return X.with_meta(docs, row_id, text).mapInArrow(score, "doc_id long, score double, severity double, grade int")


def toxic_severity(docs: DataFrame, labels: DataFrame, threshold: float | None = None, max_rows: int = 8000) -> DataFrame:
    """doc_id, held_out, score, severity, grade, predicted (1 where the score is at least ``threshold``, by default the model's)."""
    model = fit(docs, labels, max_rows=max_rows)
    model.threshold = model.threshold if threshold is None else threshold
    out = severities(docs, model)
    return out.select("doc_id", X.held_out().alias("held_out"), "score", "severity", "grade", (F.col("score") >= model.threshold).cast("int").alias("predicted"))
