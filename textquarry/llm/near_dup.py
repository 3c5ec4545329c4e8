"""Near-duplicate classes by one-permutation MinHash, banded buckets and star edges.

1. Each text becomes the set of its k-word shingles.  Equal sets are one class
   with a number; copies are never expanded into pairs.
2. One-permutation hashing: a shingle's hash falls into one of bands x rows bins
   by its high bits, a bin keeps its smallest hash, and an empty bin borrows from
   the first filled bin of its own fixed random order (optimal densification).
3. Classes that agree on all rows of a band share a bucket.  A bucket proposes
   star edges from its smallest member to the others, never all pairs.
4. Each class is confirmed with its likeliest centre on the full sets, and linked
   classes are merged.
5. A bucket whose classes are one component by now is done.  The others are *mixed*,
   and classes that mixed buckets connect are a *family*.  In it the members outside
   its largest component are compared with all its members, on the full sets: small
   blocks of the former meet small portions of the latter in one task, which counts
   common shingles through an index and emits only links.  So no pair that shares a
   bucket is lost, pairs are not emitted, and a group that its centre has joined, of
   any size, costs nothing more.

With 32 bands of 4 rows a pair at similarity 0.85 shares a bucket with
probability above 1 - 1e-10 (0.8: 1 - 5e-8).

Defined results
* null or empty text, or one of only white space: set size 0, its own component.
* a text shorter than k words: one shingle, the whole word sequence.
* rows with the same text: one class.  Rows that share a doc_id but not their text are
  classes of their own, linked or not by their texts alone, in any order of the rows.
* null doc_id: linked with nothing, component null, kept.
* empty table: no rows.  Extra columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.llm import kernels as K
from textquarry.llm.graph import merge_labels
from textquarry.session import Scratch

BANDS, ROWS = 32, 4
#: Members of a family that meet in one task: about PORTION of all, and BLOCK of those outside the largest component.
PORTION, BLOCK = 1000, 256
_PAIRS_AT_ONCE = 256


class _Signer:
    """Signatures of shingle sets; every worker builds the same tables."""

    def __init__(self, bands: int, rows: int):
        self.bands, self.rows, n = bands, rows, bands * rows
        if n & (n - 1):
            raise ValueError("bands x rows must be a power of two")
        rng = np.random.Generator(np.random.PCG64(20240607))
        self.orders = np.argsort(rng.random((n, n)), axis=1)
        self.edges = np.arange(n, dtype=np.uint64) << K.U(64 - n.bit_length() + 1)
        self.band_no = K.mix(np.arange(1, bands + 1, dtype=np.uint64))

    def bands_of(self, u: np.ndarray) -> np.ndarray:
        """Band hashes of a sorted set of shingle hashes (not empty)."""
        at = np.searchsorted(u, self.edges)
        filled = np.diff(at, append=len(u)) > 0
        v = u[np.minimum(at, len(u) - 1)]
        if not filled.all():
            empty = np.flatnonzero(~filled)
            order = self.orders[empty]
            v[empty] = v[order[np.arange(len(empty)), filled[order].argmax(axis=1)]]
        h = self.band_no.copy()
        for part in v.reshape(self.bands, self.rows).T:
            h = K.mix(h ^ part) * K.U(0x9E3779B97F4A7C15)
        return K.mix(h)


def _signatures(k: int, bands: int, rows: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = _Signer(bands, rows)
        for batch in batches:
            ids, hashes = batch.column(0), batch.column(1)
            for a, b, buf, off in K.runs(batch.column(2)):
                h, doc, _, _ = K.words(buf, off)
                sh, at = K.shingles(h, doc, b - a, k)
                n = np.zeros(b - a, np.int64)
                key = np.zeros((b - a, 2), np.uint64)
                out = np.zeros((b - a, bands), np.uint64)
                for i in range(b - a):
                    if at[i + 1] > at[i]:
                        u = np.unique(sh[at[i] : at[i + 1]])
                        n[i] = len(u)
                        m = K.mix(u)
                        key[i] = m.sum(dtype=np.uint64), (m * m).sum(dtype=np.uint64)
                        out[i] = signer.bands_of(u)
                rows_of = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1, dtype=np.int32) * bands), pa.array(K.signed(out.ravel())))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, b - a), hashes.slice(a, b - a), pa.array(n), pa.array(K.signed(key[:, 0].copy())), pa.array(K.signed(key[:, 1].copy())), rows_of],
                    ["doc_id", "th", "n", "k1", "k2", "bands"],
                )

    return sign


def _confirm(k: int, num: int, den: int):
    """Keeps the pairs whose full sets meet num / den; a centre's set is kept while its rows last."""

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, centre = None, None
        for batch in batches:
            for start in range(0, len(batch), _PAIRS_AT_ONCE):
                part = batch.slice(start, _PAIRS_AT_ONCE)
                ids, texts = part.column(0).to_pylist(), part.column(2)
                keep = np.zeros(len(part), bool)
                for i, c in enumerate(ids):
                    if c != last:
                        last, centre = c, K.shingle_set(texts[i].as_py(), k)
                    other = K.shingle_set(part.column(3)[i].as_py(), k)
                    both = len(np.intersect1d(centre, other, assume_unique=True))
                    keep[i] = den * both >= num * (len(centre) + len(other) - both)
                kept = part.filter(pa.array(keep))
                yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1)], ["a", "b"])

    return confirm


def classified(docs: DataFrame, k: int, num: int, den: int, bands: int, rows: int, text: str, row_id: str) -> DataFrame:
    """doc_id, th (hash of the text), n, label, component_id of each row of ``docs``.

    A class is a shingle set and has a number of its own, so rows that share an id
    but not a set are in classes of their own.  ``label`` is one class of the row's
    component; it is null, as is component_id, without an id or without shingles.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "neardup")
    texts = docs.select(F.col(row_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    texts = texts.select("doc_id", F.xxhash64("text").alias("th"), "text")
    sig = scratch.write(texts.mapInArrow(_signatures(k, bands, rows), "doc_id long, th long, n long, k1 long, k2 long, bands array<long>"), "signatures")
    classes = sig.where("n > 0 and doc_id is not null").groupBy("k1", "k2", "n").agg(F.min(F.struct("doc_id", "th")).alias("rep"), F.first("bands").alias("bands"))
    classes = scratch.write(classes.withColumn("c", F.monotonically_increasing_id()), "classes")
    exploded = classes.select("c", "n", F.col("rep.doc_id").alias("first"), F.explode("bands").alias("bucket"))
    shared = exploded.groupBy("bucket").agg(F.count("*").alias("many")).where("many > 1").select("bucket")
    members = scratch.write(exploded.join(shared, "bucket"), "members")
    reps = members.select("c").distinct().join(classes.select("c", "rep.doc_id", "rep.th"), "c")
    candidates = scratch.write(texts.join(reps, ["doc_id", "th"]).groupBy("c").agg(F.first("text").alias("text")), "texts")
    labels = _components(scratch, members, candidates, k, num, den)

    named = classes.select("k1", "k2", "n", "c", "rep.doc_id").join(labels.select(F.col("node").alias("c"), "label"), "c", "left").select("k1", "k2", "n", "doc_id", F.coalesce("label", "c").alias("label"))
    named = scratch.write(named, "named")
    # Only components of several classes need their smallest id looked up.
    firsts = named.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    named = scratch.write(named.drop("doc_id").join(firsts, "label"), "components")
    for used in (members, candidates, classes):
        scratch.forget(used)
    usable = F.when(F.col("doc_id").isNotNull(), F.col("n"))
    return sig.select("doc_id", "th", "n", "k1", "k2").withColumn("__n", usable).join(named.withColumnRenamed("n", "__n"), ["k1", "k2", "__n"], "left").select("doc_id", "th", "n", "label", "component_id")


def near_duplicates(
    docs: DataFrame,
    k: int = 5,
    num: int = 4,
    den: int = 5,
    bands: int = BANDS,
    rows: int = ROWS,
    text: str = "text",
    row_id: str = "doc_id",
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each row of ``docs``.

    Linked: den * intersection >= num * union of the distinct k-word shingles.
    """
    found = classified(docs, k, num, den, bands, rows, text, row_id)
    component = F.coalesce("component_id", "doc_id")
    return found.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _set_rows(k: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, buf, off in K.runs(batch.column(1)):
                h, doc, _, _ = K.words(buf, off)
                sh, at = K.shingles(h, doc, b - a, k)
                sets = [np.unique(sh[at[i] : at[i + 1]]).tobytes() for i in range(b - a)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(sets, pa.binary())], ["c", "set"])

    return rows


def _links_of(num: int, den: int):
    """Links between the members of a portion and the members of a block of other components."""

    def links(left: pa.Table, right: pa.Table) -> pa.Table:
        out_a, out_b = [], []
        if len(left) and len(right):
            ids, labels = (np.asarray(left[c].to_numpy()) for c in ("c", "label"))
            other, other_labels = (np.asarray(right[c].to_numpy()) for c in ("c", "label"))
            sets = [np.frombuffer(x, np.uint64) for x in right["set"].to_pylist()]
            size = np.array([len(x) for x in sets])
            flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
            order = np.argsort(flat, kind="stable")
            flat, owner = flat[order], owner[order]
            for i, mine in enumerate(left["set"].to_pylist()):
                u = np.frombuffer(mine, np.uint64)
                lo, hi = np.searchsorted(flat, u, "left"), np.searchsorted(flat, u, "right")
                n = hi - lo
                at = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
                both = np.bincount(owner[at], minlength=len(sets))
                for j in np.flatnonzero((den * both >= num * (len(u) + size - both)) & (other_labels != labels[i])).tolist():
                    out_a.append(int(ids[i]))
                    out_b.append(int(other[j]))
        return pa.table({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})

    return links


def _components(scratch: Scratch, members: DataFrame, texts: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """node, label: the smallest class of the component of each class that shares a bucket."""
    start = scratch.write(members.groupBy(F.col("c").alias("node")).agg(F.min("c").alias("label")), "start")
    if start.isEmpty():
        return start
    # The earliest document of a bucket is its centre: copies come after what they copy, so the stars of a group share centres.
    centres = members.groupBy("bucket").agg(F.min(F.struct("first", "c", "n")).alias("centre"))
    star = members.join(scratch.write(centres, "centres"), "bucket").where("centre.c <> c")
    star = scratch.write(star.groupBy(F.col("centre.c").alias("a"), F.col("c").alias("b"), F.col("centre.n").alias("na"), F.col("n").alias("nb")).agg(F.count("*").alias("shared")), "star")
    able = star.where(F.least("na", "nb") * den >= F.greatest("na", "nb") * num)
    pairs = able.groupBy("b").agg(F.max(F.struct("shared", (-F.col("a")).alias("a"))).alias("best")).select((-F.col("best.a")).alias("a"), "b")
    second = scratch.write(pairs, "pairs").join(texts.select(F.col("c").alias("b"), F.col("text").alias("tb")), "b")
    both = second.join(texts.select(F.col("c").alias("a"), F.col("text").alias("ta")), "a").select("a", "b", "ta", "tb")
    links = scratch.write(both.mapInArrow(_confirm(k, num, den), "a long, b long"), "links")
    labels = merge_labels(start, links, scratch)

    # Buckets that hold classes of several components by now; only pairs in these are still to be compared.
    named = members.select("bucket", "c").join(labels.select(F.col("node").alias("c"), "label"), "c")
    mixed = named.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("bucket")
    mixed = scratch.write(named.join(mixed, "bucket"), "mixed")
    if mixed.isEmpty():
        return labels
    hubs = mixed.groupBy("bucket").agg(F.min("c").alias("a"))
    spokes = mixed.join(hubs, "bucket").where("a <> c").select("a", F.col("c").alias("b")).distinct()
    nodes = scratch.write(mixed.select(F.col("c").alias("node"), F.col("c").alias("label")).distinct(), "mixed-classes")
    families = merge_labels(nodes, spokes, scratch).select("node", F.col("label").alias("family"))
    parts = scratch.write(families.join(labels, "node").groupBy("family", "label").agg(F.count("*").alias("many")), "parts")
    sizes = parts.groupBy("family").agg(F.max(F.struct("many", (-F.col("label")).alias("l"))).alias("top"), F.sum("many").alias("all"))
    sizes = sizes.select("family", (-F.col("top.l")).alias("largest"), F.ceil(F.col("all") / PORTION).cast("int").alias("portions"), F.ceil((F.col("all") - F.col("top.many")) / BLOCK).cast("int").alias("blocks"))
    open_ = families.join(scratch.write(sizes, "sizes"), "family").join(labels, "node")
    open_ = scratch.write(open_.select(F.col("node").alias("c"), "family", "label", "largest", "portions", "blocks"), "open")
    sets = texts.join(open_.select("c"), "c", "left_semi").mapInArrow(_set_rows(k), "c long, set binary")
    rows = scratch.write(open_.join(sets, "c"), "sets")
    h = F.xxhash64("c")
    all_of = rows.withColumn("portion", F.pmod(h, F.col("portions")).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    minor = rows.where("label <> largest").withColumn("block", F.pmod(h, F.col("blocks")).cast("int")).withColumn("portion", F.explode(F.sequence(F.lit(0), F.col("portions") - 1)))
    keys, cols = ["family", "portion", "block"], ["family", "portion", "block", "c", "label", "set"]
    found = all_of.select(*cols).groupBy(*keys).cogroup(minor.select(*cols).groupBy(*keys)).applyInArrow(_links_of(num, den), "a long, b long")
    labels = merge_labels(labels, scratch.write(found, "late"), scratch)
    scratch.forget(rows)
    return labels


def keep_first(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """One row of each component, that of the smallest id (then text hash), with all columns; rows without an id stay.

    Rows equal in id and text are one document; rows that share an id but not their text are two.
    """
    found = classified(docs, k, num, den, BANDS, ROWS, text, row_id).where("doc_id is not null")
    first = found.where("label is not null").groupBy("label").agg(F.min(F.struct("doc_id", "th")).alias("r")).select("r.doc_id", "r.th")
    kept = first.unionByName(found.where("label is null").select("doc_id", "th").distinct())
    keyed = docs.withColumns({"__id": F.col(row_id).cast("long"), "__th": F.xxhash64(F.col(text).cast("string"))})
    one = keyed.join(kept.toDF("__id", "__th"), ["__id", "__th"], "left_semi").dropDuplicates(["__id", "__th"])
    return one.select(*docs.columns).unionByName(docs.where(F.col(row_id).isNull()))
