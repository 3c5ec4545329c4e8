"""Approximate nearest neighbours by a hash-prefix forest (LSH forest) with cross-polytope hashes.

1. Equal vectors are one class, numbered by its smallest id; it keeps the k + 1 smallest.
2. Every tree gives a class a long hash string: its symbols are the nearest axes of the
   vector under random rotations (cross-polytope hashing).  A tree is the sorted array of
   its strings, cut into slices; exact counts of short prefixes make a directory of fixed size.
3. A query descends in every tree to its longest matching prefix and ascends in all trees
   synchronously: its level is the longest prefix at which the trees together hold at least
   ``candidates`` entries.  Levels within the directory are read from it; deeper ones are
   counted in the slices and summed over the trees.
4. The entries below that level are candidates, all of them.  They travel as packed lists
   to the vectors, which are dealt by class, and are scored there by the exact cosine.

Candidates grow with the square root of the classes (80 times it, copies in several trees
counted), so the work of a query stays sublinear.  Measured recall is in the README.

Defined results
* rows with a null id or vector, a zero or empty one, or null or non-finite components take
  no part, nor do vectors of another length than the most frequent one (ties: the longer).
* rows that share an id are one row, of the smallest vector in array order.
* equal scores: the smaller id first.  A query never finds its own id; copies of it are found.
* fewer candidates than k: all of them.  No query or an empty table: no rows.
* Columns of the input other than the id and the vector are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from textquarry.session import Scratch

#: Entries that a task expands at a time.
_AT_ONCE = 1 << 21


@dataclass(frozen=True)
class Forest:
    """Trees, symbols of a hash string, axes of a symbol, bits of the directory, rows of a slice and of a bucket of classes."""

    dim: int
    trees: int = 48
    symbols: int = 8
    most_axes: int = 64
    directory: int = 14
    slice_rows: int = 8192
    bucket_rows: int = 4096
    seed: int = 20240611

    @property
    def axes(self) -> int:
        return min(self.most_axes, 1 << (self.dim.bit_length() - 1))

    @property
    def bits(self) -> int:
        """Bits of a hash string, fewer than 63."""
        return min(self.symbols, 62 // self.axes.bit_length()) * self.axes.bit_length()

    @property
    def short(self) -> int:
        return min(self.directory, self.bits)


@lru_cache(maxsize=2)
def _rotations(forest: Forest) -> np.ndarray:
    """trees x dim x (symbols x axes): orthonormal columns within a symbol."""
    rng = np.random.Generator(np.random.PCG64(forest.seed))
    n = forest.bits // forest.axes.bit_length()
    q, _ = np.linalg.qr(rng.normal(size=(forest.trees, n, forest.dim, forest.axes)))
    return np.ascontiguousarray(q.transpose(0, 2, 1, 3).reshape(forest.trees, forest.dim, n * forest.axes).astype(np.float32))


def hash_strings(vectors: np.ndarray, forest: Forest) -> np.ndarray:
    """The hash string of each vector in each tree (rows x trees)."""
    out = np.zeros((len(vectors), forest.trees), np.int64)
    x = vectors.astype(np.float32)
    width = forest.axes.bit_length()
    for t, r in enumerate(_rotations(forest)):
        turned = (x @ r).reshape(len(x), -1, forest.axes)
        axis = np.abs(turned).argmax(axis=2)
        negative = np.take_along_axis(turned, axis[:, :, None], axis=2)[:, :, 0] < 0
        for symbol in (axis * 2 + negative).T:
            out[:, t] = out[:, t] << width | symbol
    return out


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Vectors as rows, each scaled by a power of two so that squares neither overflow nor vanish."""
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)
    _, exponent = np.frexp(np.abs(x).max(axis=1, initial=0))
    return np.ldexp(x, -exponent[:, None])


def _index(forest: Forest):
    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), 4096):
                part = batch.slice(a, 4096)
                h = hash_strings(_matrix(part.column(1), forest.dim), forest)
                c = np.asarray(part.column(0).to_numpy())
                yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(forest.trees, dtype=np.int32), len(part))), pa.array(h.ravel()), pa.array(np.repeat(c, forest.trees))], ["tree", "h", "c"])

    return index


@dataclass(frozen=True)
class Directory:
    """Exact counts of the short prefixes of every tree (trees x 2^short), and how the sorted arrays are cut.

    ``before``: entries below each prefix; ``slices``: the slice of each prefix; ``chunks``: pieces of each slice.
    Its size is that of the prefixes, whatever the corpus.
    """

    before: np.ndarray
    slices: np.ndarray
    chunks: np.ndarray

    @staticmethod
    def of(counts: np.ndarray, slice_rows: int) -> Directory:
        before = np.zeros((len(counts), counts.shape[1] + 1), np.int64)
        np.cumsum(counts, axis=1, out=before[:, 1:])
        number = before[:, :-1] // slice_rows
        fresh = np.ones(number.shape, bool)
        fresh[:, 1:] = number[:, 1:] != number[:, :-1]
        slices = (np.cumsum(fresh.ravel()) - 1).reshape(number.shape)
        rows = np.bincount(slices.ravel(), weights=counts.ravel()).astype(np.int64)
        return Directory(before, slices.astype(np.int32), np.maximum(1, -(-rows // (2 * slice_rows))).astype(np.int32))

    def total(self, h: np.ndarray, level: int, forest: Forest) -> np.ndarray:
        """Entries of all trees that share the first ``level`` bits with each query (queries x trees), level at most ``short``."""
        low, high = self.cells(h, np.full(len(h), level), forest)
        t = np.arange(forest.trees)
        return (self.before[t, high] - self.before[t, low]).sum(axis=1)

    def cells(self, h: np.ndarray, level: np.ndarray, forest: Forest) -> tuple[np.ndarray, np.ndarray]:
        """First and end cell of the prefixes of ``level`` bits (at most ``short`` count)."""
        use = np.minimum(level, forest.short)[:, None]
        low = (h >> (forest.bits - use)) << (forest.short - use)
        return low, low + (1 << (forest.short - use))


def _levels(sent, forest: Forest, wanted: int):
    """(q, level): the deepest level of the directory at which a query has enough entries."""

    def levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        directory = sent.value
        for batch in batches:
            h = hash_strings(_matrix(batch.column(1), forest.dim), forest)
            level = np.zeros(len(h), np.int32)
            for x in range(1, forest.short + 1):
                level[directory.total(h, x, forest) >= wanted] = x
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(level)], ["q", "level"])

    return levels


def _visits(sent, forest: Forest):
    """(slice, chunk, q, h, level): the slices that hold a query's prefixes."""

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        directory = sent.value
        for whole in batches:
            for a in range(0, len(whole), 1024):
                batch = whole.slice(a, 1024)
                q, level = np.asarray(batch.column(0).to_numpy()), np.asarray(batch.column(2).to_numpy())
                h = hash_strings(_matrix(batch.column(1), forest.dim), forest)
                low, high = directory.cells(h, level, forest)
                t = np.arange(forest.trees)
                first, last = directory.slices[t, low].ravel(), directory.slices[t, high - 1].ravel()
                many = last - first + 1
                owner = np.repeat(np.arange(len(many)), many)
                piece = first[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
                split = directory.chunks[piece]
                owner, piece = np.repeat(owner, split), np.repeat(piece, split)
                chunk = np.arange(len(owner)) - np.repeat(np.cumsum(split) - split, split)
                row = owner // forest.trees
                yield pa.RecordBatch.from_arrays([pa.array(piece.astype(np.int32)), pa.array(chunk.astype(np.int32)), pa.array(q[row]), pa.array(h.ravel()[owner]), pa.array(level[row].astype(np.int32))], ["slice", "chunk", "q", "h", "level"])

    return visits


def _placed(sent, forest: Forest):
    """(slice, chunk, h, c) of index rows."""

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        directory = sent.value
        for batch in batches:
            tree, h, c = (np.asarray(batch.column(i).to_numpy()) for i in range(3))
            piece = directory.slices[tree, h >> (forest.bits - forest.short)]
            chunk = (c.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % directory.chunks[piece].astype(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(piece), pa.array(chunk.astype(np.int32)), batch.column(1), batch.column(2)], ["slice", "chunk", "h", "c"])

    return placed


def _sorted(entries: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    h, c = np.asarray(entries["h"].to_numpy()), np.asarray(entries["c"].to_numpy())
    order = np.argsort(h, kind="stable")
    return h[order], c[order]


def _deeper(forest: Forest):
    """(q, counts): entries of a piece of a slice with each prefix of a query longer than the directory's."""

    def deeper(entries: pa.Table, queries: pa.Table) -> pa.Table:
        if not len(queries):
            return pa.table({"q": pa.array([], pa.int64()), "counts": pa.array([], pa.list_(pa.int64()))})
        h, _ = _sorted(entries)
        mine = np.asarray(queries["h"].to_numpy())
        counts = np.zeros((len(mine), forest.bits - forest.short), np.int64)
        for x in range(forest.short + 1, forest.bits + 1):
            rest = forest.bits - x
            low = (mine >> rest) << rest
            counts[:, x - forest.short - 1] = np.searchsorted(h, low + (1 << rest)) - np.searchsorted(h, low)
        at = np.arange(len(mine) + 1, dtype=np.int32) * counts.shape[1]
        return pa.table({"q": queries["q"], "counts": pa.ListArray.from_arrays(pa.array(at), pa.array(counts.ravel()))})

    return deeper


def _bucket(c: np.ndarray, buckets: int) -> np.ndarray:
    return ((c.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def _dealt(buckets: int):
    """Adds the bucket to rows of classes."""

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_bucket(np.asarray(batch.column(0).to_numpy()), buckets))], [*batch.schema.names, "bucket"])

    return dealt


def _candidates(forest: Forest, buckets: int):
    """(bucket, q, ids): all entries of a piece of a slice below the queries' prefixes, by bucket of classes."""

    def candidates(entries: pa.Table, queries: pa.Table) -> pa.Table:
        h, c = _sorted(entries)
        bucket_of = _bucket(c, buckets)
        q, mine, level = (np.asarray(queries[x].to_numpy()) for x in ("q", "h", "level"))
        rest = forest.bits - level.astype(np.int64)
        low = (mine >> rest) << rest
        a, b = np.searchsorted(h, low), np.searchsorted(h, low + (np.int64(1) << rest))
        out, start = [], 0
        ends = np.cumsum(b - a)
        while start < len(q):
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + _AT_ONCE, side="right")))
            n = (b - a)[start:stop]
            owner = np.repeat(np.arange(start, stop), n)
            at = a[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
            key = owner * buckets + bucket_of[at]
            order = np.argsort(key, kind="stable")
            key, at = key[order], at[order]
            head = np.flatnonzero(np.diff(key, prepend=-1)) if len(key) else np.zeros(0, np.int64)
            lists = pa.LargeListArray.from_arrays(pa.array(np.append(head, len(key))), pa.array(c[at]))
            out.append(pa.table({"bucket": pa.array(key[head] % buckets), "q": pa.array(q[key[head] // buckets]), "ids": lists.cast(pa.list_(pa.int64()))}))
            start = stop
        return pa.concat_tables(out) if out else pa.table({"bucket": pa.array([], pa.int64()), "q": pa.array([], pa.int64()), "ids": pa.array([], pa.list_(pa.int64()))})

    return candidates


def _cosines(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Cosines of rows with one vector, each summed in the same order whatever stands beside it."""
    return (x * q).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((q * q).sum()))


def _scored(forest: Forest, k: int):
    """(q, vec_id, score): the best k + 1 ids of a bucket for each query."""

    def scored(classes: pa.Table, queries: pa.Table) -> pa.Table:
        out_q, out_id, out_s = [], [], []
        if len(classes) and len(queries):
            classes = classes.combine_chunks().sort_by("c")
            c = np.asarray(classes["c"].to_numpy())
            x = _matrix(classes["vector"].combine_chunks(), forest.dim)
            unit = x / np.sqrt((x * x).sum(axis=1))[:, None]
            members = classes["members"].to_pylist()
            mine = _matrix(queries["vector"].combine_chunks(), forest.dim)
            for i, (q, ids) in enumerate(zip(queries["q"].to_pylist(), queries["ids"])):
                at = np.searchsorted(c, np.unique(ids.values.to_numpy()))
                near = unit[at] @ mine[i]
                if len(at) > k + 9:  # a few more than asked for: the last digits are settled below
                    at = at[np.argpartition(-near, k + 8)[: k + 9]]
                score = _cosines(x[at], mine[i])
                best = sorted((-s, v) for s, j in zip(score.tolist(), at.tolist()) for v in members[j])[: k + 1]
                out_q += [q] * len(best)
                out_id += [v for _, v in best]
                out_s += [-s for s, _ in best]
        return pa.table({"q": pa.array(out_q, pa.int64()), "vec_id": pa.array(out_id, pa.int64()), "score": pa.array(out_s, pa.float64())})

    return scored


def usable(df: DataFrame, row_id: str, vector: str) -> DataFrame:
    """vec_id, vector of the rows that take part: one an id, finite, not zero, of the most frequent length."""
    v = F.col("vector")
    finite = F.forall(v, lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False)))
    rows = df.select(F.col(row_id).cast("long").alias("vec_id"), F.col(vector).alias("vector"))
    rows = rows.where(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0))
    top = rows.groupBy(F.size(v).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.where(F.size(v) == (top["d"] if top else 0)).groupBy("vec_id").agg(F.min("vector").alias("vector"))


def nearest(
    df: DataFrame,
    is_query: Column,
    k: int = 5,
    row_id: str = "vec_id",
    vector: str = "embedding",
    candidates: int | None = None,
    query_rows: int = 1 << 16,
    **options: int,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of largest cosine that each query's candidates hold.

    ``is_query`` is an expression over ``vec_id``.  ``candidates``: entries, over all trees,
    at which the ascent stops; 80 times the square root of the classes unless given.
    ``query_rows``: visits of a slice that meet in one task; ``options``: fields of ``Forest``.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "forest")
    rows = scratch.write(usable(df, row_id, vector), "rows")
    first = rows.select(F.size("vector").alias("d")).first()
    forest = Forest(first["d"] if first else 1, **options)
    few = rows.withColumn("no", F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))).where(F.col("no") <= k + 1)
    classes = few.groupBy("vector").agg(F.min("vec_id").alias("c"), F.sort_array(F.collect_list("vec_id")).alias("members"))
    classes = scratch.write(classes.select("c", "vector", "members"), "classes")
    asked = scratch.write(rows.where(is_query).join(classes.select("c", "vector"), "vector").select(F.col("vec_id").alias("query_id"), F.col("c").alias("q")), "queries")
    queries = scratch.write(classes.join(asked.select(F.col("q").alias("c")).distinct(), "c", "left_semi").select(F.col("c").alias("q"), "vector"), "vectors")
    index = scratch.write(classes.select("c", "vector").mapInArrow(_index(forest), "tree int, h long, c long"), "index")

    counts = np.zeros((forest.trees, 1 << forest.short), np.int64)
    cell = F.shiftright("h", forest.bits - forest.short).cast("int")
    got = index.groupBy("tree", cell.alias("cell")).agg(F.count("*").alias("n")).toArrow()  # at most trees x 2^short rows
    counts[got["tree"].to_numpy(), got["cell"].to_numpy()] = got["n"].to_numpy()
    n_classes = int(counts[0].sum())
    wanted = candidates or math.ceil(80 * math.sqrt(n_classes))
    sent = spark.sparkContext.broadcast(Directory.of(counts, forest.slice_rows))
    buckets = max(1, -(-n_classes // forest.bucket_rows))

    entries = index.mapInArrow(_placed(sent, forest), "slice int, chunk int, h long, c long")
    levels = scratch.write(queries.mapInArrow(_levels(sent, forest, wanted), "q long, level int"), "levels")
    keys, visit = ["slice", "chunk"], "slice int, chunk int, q long, h long, level int"
    full = levels.where(F.col("level") == forest.short)
    if forest.bits > forest.short and not full.isEmpty():
        deep = queries.join(full, "q").select("q", "vector", "level").mapInArrow(_visits(sent, forest), visit)
        sums = entries.groupBy(*keys).cogroup(deep.groupBy(*keys)).applyInArrow(_deeper(forest), "q long, counts array<long>")
        sums = sums.select("q", F.posexplode("counts").alias("at", "n")).groupBy("q", "at").agg(F.sum("n").alias("n")).where(F.col("n") >= wanted)
        lower = sums.groupBy("q").agg((F.max("at") + forest.short + 1).alias("deeper"))
        levels = scratch.write(levels.join(lower, "q", "left").select("q", F.coalesce("deeper", "level").cast("int").alias("level")), "deep-levels")
    visits = scratch.write(queries.join(levels, "q").select("q", "vector", "level").mapInArrow(_visits(sent, forest), visit), "visits")
    # Slices that many queries visit meet them block by block.
    busy = visits.groupBy("slice").agg(F.ceil(F.count("*") / query_rows).cast("int").alias("blocks")).where("blocks > 1")
    busy = scratch.write(busy, "busy")
    blocks = F.coalesce("blocks", F.lit(1))
    entries = entries.join(busy, "slice", "left").withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1))).drop("blocks")
    visits = visits.join(busy, "slice", "left").withColumn("block", F.pmod(F.xxhash64("q"), blocks).cast("int")).drop("blocks")
    keys = ["slice", "chunk", "block"]
    found = entries.groupBy(*keys).cogroup(visits.groupBy(*keys)).applyInArrow(_candidates(forest, buckets), "bucket long, q long, ids array<long>")
    lists = found.groupBy("bucket", "q").agg(F.flatten(F.collect_list("ids")).alias("ids"))
    lists = scratch.write(lists, "candidates")
    # Blocks of queries, so that the lists that meet a bucket stay within a task's memory at any number of queries.
    total = lists.agg(F.sum(F.size("ids"))).first()[0] or 0
    blocks = max(1, -(-total // (buckets * _AT_ONCE)))
    block = F.pmod(F.xxhash64("q"), F.lit(blocks)).cast("int")
    right = lists.join(queries, "q").withColumn("block", block)
    schema = StructType([*classes.schema.fields, StructField("bucket", LongType())])
    left = classes.mapInArrow(_dealt(buckets), schema).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    keys = ["bucket", "block"]
    scored = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_scored(forest, k), "q long, vec_id long, score double")
    best = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    top = scored.withColumn("no", F.row_number().over(best)).where(F.col("no") <= k + 1).drop("no")
    others = asked.join(top, "q").where("query_id <> vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return others.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)

