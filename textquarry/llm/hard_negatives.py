"""Hard negatives by a vantage-point tree over norm-augmented vectors.

A row x becomes x' = (x, sqrt(M - |x|^2)) with M the largest |x|^2, an anchor q becomes
q' = (q, 0).  Then |q' - x'|^2 = |q|^2 + M - 2 q.x: the highest scores are the nearest
rows, and a window of scores is an annulus of distances.

1. The upper levels of the tree are fitted on a bounded sample; every row descends to its
   leaf, and each leaf knows the exact range of its rows' distances to the vantage points
   above it.  A leaf's rows are dealt into pieces of bounded size, each with a lower tree
   of its own.
2. Positives: an anchor visits its home leaf, which bounds the score of its k-th best row
   of its label; then it visits all other leaves that may hold better ones.
3. Negatives: each positive gives a window of scores.  An anchor visits the nearest leaf
   that its annuli meet, then all others that may still improve a window.
4. In a piece an anchor takes the parts of the lower tree nearest first and stops when
   none that is left meets the annulus closer than what it has found.

Bounds only leave out what cannot be a result, so results are exact.  Vectors without
structure in many dimensions give bounds that leave out little; then every anchor meets
every piece, as blocks of products of even size, and only the best rows of a piece leave it.

Defined results
* rows with a null id, label or vector, an empty vector, or null or non-finite components take no part,
  nor do vectors of another length than the most frequent one (ties: the longer).
* rows that share an id are one row, the smallest by (label, vector).
* equal scores: the smaller id first.  Copies of an anchor are rows like others.
* an anchor without another row of its label, and a positive whose window holds no row of
  another label (always so below 0), give no rows.  Empty table: no rows.
* scores are exact while they stay within 2^53.  Columns not named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textquarry.session import Scratch

#: Rows of a part of a lower tree, and anchors that are routed at a time.
_PART, _ROUTED = 256, 256
_FOUND = "anchor long, window int, vec_id long, score double"


@dataclass(frozen=True)
class VantageTree:
    """A full binary tree in heap order: a row goes right where it is farther from the vantage point than the radius."""

    depth: int
    points: np.ndarray
    radius: np.ndarray

    @staticmethod
    def fit(x: np.ndarray, depth: int) -> VantageTree:
        """Vantage points are rows far from the middle of their part, radii its median distance."""
        points, radius = np.zeros((2**depth - 1, x.shape[1])), np.full(2**depth - 1, np.inf)
        at = np.zeros(len(x), np.int64)
        for node in range(2**depth - 1):
            level = (node + 1).bit_length() - 1
            here = np.flatnonzero(at == node - (2**level - 1))
            if len(here):
                part = x[here]
                points[node] = part[_distances(part, part.mean(axis=0)[None])[:, 0].argmax()]
                radius[node] = np.median(_distances(part, points[node][None])[:, 0])
            if node + 1 == 2 ** (level + 1) - 1:
                at = at * 2 + _right(x, at, points[2**level - 1 : node + 1], radius[2**level - 1 : node + 1])
        return VantageTree(depth, points, radius)

    def distances(self, x: np.ndarray) -> np.ndarray:
        return _distances(x, self.points)

    def leaf_of(self, distances: np.ndarray) -> np.ndarray:
        at, row = np.zeros(len(distances), np.int64), np.arange(len(distances))
        for level in range(self.depth):
            node = 2**level - 1 + at
            at = at * 2 + (distances[row, node] > self.radius[node])
        return at

    def paths(self) -> np.ndarray:
        """The vantage points above each leaf (leaves x depth)."""
        leaf = np.arange(2**self.depth)[:, None]
        level = np.arange(self.depth)[None]
        return 2**level - 1 + (leaf >> (self.depth - level))


def _right(x: np.ndarray, at: np.ndarray, points: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """Whether each row goes right from its node of one level."""
    out = np.zeros(len(x), bool)
    for i in range(len(points)):
        here = np.flatnonzero(at == i)
        out[here] = _distances(x[here], points[i][None])[:, 0] > radius[i]
    return out


def _distances(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    d = (x * x).sum(axis=1)[:, None] + (points * points).sum(axis=1)[None] - 2 * (x @ points.T)
    return np.sqrt(np.maximum(d, 0))


class Ranges:
    """Smallest and largest distance of each leaf's rows to the vantage points above it."""

    def __init__(self, tree: VantageTree, low: np.ndarray, high: np.ndarray, top: float):
        self.paths, self.low, self.high, self.top = tree.paths(), low, high, top

    def scores(self, q: np.ndarray, distances: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of the scores of each leaf's rows for each anchor (anchors x leaves); an empty leaf has -inf as both."""
        own = (q * q).sum(axis=1)[:, None]
        slack = 1e-6 * (np.sqrt(own) + np.sqrt(self.top))  # far above the rounding of distances
        if not self.paths.shape[1]:
            near, far = np.zeros((len(q), 1)), np.full((len(q), 1), np.inf)
        else:
            d = distances[:, self.paths]
            near = np.maximum(np.maximum(d - self.high, self.low - d).max(axis=2), 0)
            far = (d + self.high).min(axis=2)
        near, far = np.maximum(near - slack, 0), far + slack
        most = (own + self.top - near * near) / 2
        with np.errstate(over="ignore"):
            least = (own + self.top - far * far) / 2
        return most, least


def _augmented(x: np.ndarray, top: float) -> np.ndarray:
    return np.hstack((x, np.sqrt(np.maximum(top - (x * x).sum(axis=1), 0))[:, None]))


def _bare(q: np.ndarray) -> np.ndarray:
    return np.hstack((q, np.zeros((len(q), 1))))


def _matrix(column, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _assigned(tree: VantageTree, top: float, dim: int):
    """Adds to rows (vec_id, label, vector) their leaf and the distances to the vantage points above it."""

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths = tree.paths()
        for whole in batches:
            for a in range(0, len(whole), 4096):
                batch = whole.slice(a, 4096)
                d = tree.distances(_augmented(_matrix(batch.column(2), dim), top))
                leaf = tree.leaf_of(d)
                own = np.take_along_axis(d, paths[leaf], axis=1)
                at = np.arange(len(batch) + 1, dtype=np.int32) * tree.depth
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf.astype(np.int32)), pa.ListArray.from_arrays(pa.array(at), pa.array(own.ravel()))], [*batch.schema.names, "leaf", "distances"])

    return assigned


def _windows(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Owner, number, floor and ceiling of the windows of some anchors."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten()
    owner = np.repeat(np.arange(len(column)), column.value_lengths().to_numpy(zero_copy_only=False))
    get = lambda name, kind: np.asarray(flat.field(name).to_numpy(zero_copy_only=False), kind)
    return owner, get("window", np.int32), get("lo", np.float64), get("hi", np.float64)


def _routed(tree: VantageTree, ranges: Ranges, dim: int, first: bool):
    """Adds to anchors (anchor, label, vector, windows, home) the leaves they visit.

    ``first``: the one leaf with the highest scores that a window meets, which is then their home; else all others that
    any window meets.
    """

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, len(whole), _ROUTED):
                batch = whole.slice(a, _ROUTED)
                q = _matrix(batch.column(2), dim)
                most, least = ranges.scores(q, tree.distances(_bare(q)))
                owner, _, lo, hi = _windows(batch.column(3))
                meets = (most[owner] >= lo[:, None]) & (least[owner] <= hi[:, None])
                any_ = np.zeros(most.shape, bool)
                np.logical_or.at(any_, owner, meets)
                any_ &= np.isfinite(most)
                if first:
                    row = np.flatnonzero(any_.any(axis=1))
                    leaf = np.where(any_, most, -np.inf)[row].argmax(axis=1)
                else:
                    home = np.asarray(batch.column(4).to_numpy(zero_copy_only=False))
                    any_[np.arange(len(home)), home] = False
                    row, leaf = np.nonzero(any_)
                taken = batch.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([*taken.columns[:4], pa.array(leaf.astype(np.int32))], [*batch.schema.names[:4], "leaf"])

    return routed


def _best(dim: int, top: float, same: bool, k: int):
    """(anchor, window, vec_id, score): the first k rows of a piece in each window of the anchors that visit it."""

    def best(rows: pa.Table, visits: pa.Table) -> pa.Table:
        if not len(rows) or not len(visits):
            return pa.table({"anchor": pa.array([], pa.int64()), "window": pa.array([], pa.int32()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        rows = rows.combine_chunks().sort_by("vec_id")
        ids, labels = (np.asarray(rows[c].to_numpy()) for c in ("vec_id", "label"))
        x = _matrix(rows["vector"].combine_chunks(), dim)
        inner = _augmented(x, top)
        tree = VantageTree.fit(inner, max(0, (len(x) // _PART).bit_length() - 1))
        d = tree.distances(inner)
        part_of = tree.leaf_of(d)
        parts = [np.flatnonzero(part_of == p) for p in range(2**tree.depth)]
        paths = tree.paths()
        low, high = np.full(paths.shape, np.inf), np.full(paths.shape, -np.inf)
        for p, here in enumerate(parts):
            if len(here) and tree.depth:
                own = d[here][:, paths[p]]
                low[p], high[p] = own.min(axis=0), own.max(axis=0)
        anchors, mine = (np.asarray(visits[c].to_numpy()) for c in ("anchor", "label"))
        q = _matrix(visits["vector"].combine_chunks(), dim)
        most, least = Ranges(tree, low, high, top).scores(q, tree.distances(_bare(q)))
        owner, number, lo, hi = _windows(visits["windows"])
        score, found = np.full((len(owner), k), -np.inf), np.full((len(owner), k), -1, np.int64)
        nearest = np.argsort(-most, axis=1, kind="stable")
        for step in range(len(parts)):
            part = nearest[owner, step]
            floor = np.maximum(lo, score[:, -1])
            # Parts come by falling bound, so a window whose next part is below its floor is done.
            live = (most[owner, part] >= floor) & (least[owner, part] <= hi) & np.isfinite(most[owner, part])
            for p in np.unique(part[live]):
                _take(x, ids, labels, parts[p], q, anchors, mine, owner, np.flatnonzero(live & (part == p)), floor, hi, score, found, same)
        w, j = np.nonzero(found >= 0)
        return pa.table({"anchor": pa.array(anchors[owner[w]]), "window": pa.array(number[w]), "vec_id": pa.array(found[w, j]), "score": pa.array(score[w, j])})

    return best


def _take(x, ids, labels, here, q, anchors, mine, owner, w, floor, hi, score, found, same) -> None:
    """Puts the rows of one part into the best of the windows ``w``; rows stand by id, so the first of equal scores has the smallest."""
    a, back = np.unique(owner[w], return_inverse=True)
    product = q[a] @ x[here].T
    fits = (mine[a][:, None] == labels[here][None]) == same
    if same:
        fits &= anchors[a][:, None] != ids[here][None]
    product[~fits] = -np.inf
    s = product[back]
    s[(s < floor[w][:, None]) | (s > hi[w][:, None])] = -np.inf
    some = np.flatnonzero((s > -np.inf).any(axis=1))
    if not len(some):
        return
    s, w = s[some], w[some]
    k, row = score.shape[1], np.arange(len(w))
    new_s, new_id = np.full((len(w), k), -np.inf), np.full((len(w), k), -1, np.int64)
    for j in range(min(k, len(here))):
        at = s.argmax(axis=1)
        new_s[:, j] = s[row, at]
        new_id[:, j] = np.where(new_s[:, j] > -np.inf, ids[here][at], -1)
        s[row, at] = -np.inf
    all_s, all_id = np.hstack((score[w], new_s)), np.hstack((found[w], new_id))
    order = np.lexsort((all_id, -all_s), axis=1)[:, :k]
    score[w], found[w] = np.take_along_axis(all_s, order, axis=1), np.take_along_axis(all_id, order, axis=1)


def usable(df: DataFrame, row_id: str, vector: str, label: str) -> DataFrame:
    """vec_id, label, vector (doubles) of the rows that take part."""
    v = F.col("vector")
    finite = F.forall(v, lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False)))
    rows = df.select(F.col(row_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), F.col(vector).cast("array<double>").alias("vector"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size(v) > 0) & finite)
    top = rows.groupBy(F.size(v).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    one = rows.where(F.size(v) == (top["d"] if top else 0)).groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("r"))
    return one.select("vec_id", "r.label", "r.vector")


def hard_negatives(
    df: DataFrame,
    is_anchor: Column,
    positives: int = 5,
    negatives: int = 3,
    low: tuple[int, int] = (50, 100),
    high: tuple[int, int] = (95, 100),
    row_id: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    sample_rows: int = 4096,
    leaf_rows: int = 8192,
    query_rows: int = 4096,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    A score is the inner product, of whole numbers.  Positives are the first rows of the
    anchor's label; negatives the first rows of other labels whose score is at least
    low[0] / low[1] and at most high[0] / high[1] of the positive's.  ``is_anchor`` is an
    expression over ``vec_id``.  ``sample_rows`` bounds what the upper tree is fitted on,
    ``leaf_rows`` the rows and ``query_rows`` the anchors that meet in one task.
    """
    scratch = Scratch(df.sparkSession, "negatives")
    rows = scratch.write(usable(df, row_id, vector, label), "rows")
    square = F.aggregate("vector", F.lit(0.0), lambda t, x: t + x * x)
    known = rows.agg(F.count("*").alias("n"), F.max(square).alias("top"), F.max(F.size("vector")).alias("dim")).first()
    n, top, dim = known["n"], known["top"] or 0.0, known["dim"] or 0
    # The sample is bounded by its parameter.
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).select("vector").collect()
    depth = min(max(0, -(-n // leaf_rows) - 1).bit_length(), max(0, (len(sample) // 8).bit_length() - 1))
    tree = VantageTree.fit(_augmented(np.array([r["vector"] for r in sample], np.float64).reshape(len(sample), dim), top), depth)
    placed = rows.mapInArrow(_assigned(tree, top, dim), "vec_id long, label long, vector array<double>, leaf int, distances array<double>")
    placed = scratch.write(placed, "placed")
    ends = [f(F.col("distances")[i]).alias(f"{name}{i}") for i in range(depth) for name, f in (("low", F.min), ("high", F.max))]
    leaves = placed.groupBy("leaf").agg(F.count("*").alias("n"), *ends).collect()  # a row a leaf of the upper tree, at most sample_rows / 8
    least, most = np.full((2**depth, depth), np.inf), np.full((2**depth, depth), -np.inf)
    for r in leaves:
        least[r["leaf"]], most[r["leaf"]] = [r[f"low{i}"] for i in range(depth)], [r[f"high{i}"] for i in range(depth)]
    ranges = Ranges(tree, least, most, top)
    chunks = [1] * 2**depth
    for r in leaves:
        chunks[r["leaf"]] = max(1, round(r["n"] / leaf_rows))
    chunk_of = F.element_at(F.lit(chunks), F.col("leaf") + 1)
    pieces = placed.select("vec_id", "label", "vector", "leaf", F.pmod(F.xxhash64("vec_id"), chunk_of).cast("int").alias("chunk"))
    window = "array<struct<window:int,lo:double,hi:double>>"
    visit = f"anchor long, label long, vector array<double>, windows {window}, leaf int"

    def search(asked: DataFrame, first: bool, same: bool, k: int, name: str) -> tuple[DataFrame, DataFrame]:
        """What the leaves of one round hold, and the visits."""
        visits = scratch.write(asked.mapInArrow(_routed(tree, ranges, dim, first), visit), f"{name}-visits")
        busy = scratch.write(visits.groupBy("leaf").agg(F.ceil(F.count("*") / query_rows).cast("int").alias("blocks")), f"{name}-busy")
        left = pieces.join(busy, "leaf").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        right = visits.join(busy, "leaf").withColumn("block", F.pmod(F.xxhash64("anchor"), "blocks").cast("int")).withColumn("chunk", F.explode(F.sequence(F.lit(0), chunk_of - 1)))
        keys = ["leaf", "chunk", "block"]
        found = left.select(*keys, "vec_id", "label", "vector").groupBy(*keys).cogroup(right.select(*keys, "anchor", "label", "vector", "windows").groupBy(*keys)).applyInArrow(_best(dim, top, same, k), _FOUND)
        return scratch.write(found, name), visits

    def top_of(found: DataFrame, k: int) -> DataFrame:
        order = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    def both_rounds(asked: DataFrame, same: bool, k: int, name: str) -> DataFrame:
        """The first k rows of each window of ``asked`` (anchor, label, vector, windows)."""
        near, visits = search(asked.withColumn("home", F.lit(0)), True, same, k, f"{name}-near")
        # A full window takes only rows that are no worse than its last one.
        full = top_of(near, k).where(F.col("rank") == k).select("anchor", F.col("window").alias("full"), F.col("score").alias("floor"))
        floors = full.groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("full", "floor"))).alias("floors"))
        raised = F.transform("windows", lambda w: F.struct(w["window"].alias("window"), F.greatest(w["lo"], F.col("floors")[w["window"]]).alias("lo"), w["hi"].alias("hi")))
        again = asked.join(visits.select("anchor", F.col("leaf").alias("home")), "anchor").join(floors, "anchor", "left")
        far, _ = search(again.select("anchor", "label", "vector", raised.alias("windows"), "home"), False, same, k, f"{name}-far")
        return scratch.write(top_of(near.unionByName(far), k), f"{name}-found")

    anchors = rows.where(is_anchor).select(F.col("vec_id").alias("anchor"), "label", "vector")
    everything = F.array(F.struct(F.lit(0).alias("window"), F.lit(float("-inf")).alias("lo"), F.lit(float("inf")).alias("hi")))
    liked = both_rounds(anchors.withColumn("windows", everything), True, positives, "positives").select("anchor", F.col("rank").alias("window"), F.col("vec_id").alias("positive_id"), F.col("score").cast("long").alias("positive_score"))
    s = F.col("positive_score")
    bounds = liked.withColumns({"lo": _up(s * low[0], low[1]).cast("double"), "hi": _down(s * high[0], high[1]).cast("double")}).where("lo <= hi")
    windows = bounds.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("window", "lo", "hi"))).alias("windows"))
    disliked = both_rounds(anchors.join(windows, "anchor"), False, negatives, "negatives")
    out = disliked.join(liked, ["anchor", "window"])
    return out.select(F.col("anchor").alias("anchor_id"), "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").cast("long").alias("negative_score"))


def _down(a: Column, b: int) -> Column:
    """floor(a / b) of whole numbers."""
    return (a - F.pmod(a, F.lit(b))) / b


def _up(a: Column, b: int) -> Column:
    return -_down(-a, b)
