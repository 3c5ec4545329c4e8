"""Line deduplication: a suffix array over line ids by distributed prefix doubling.

Texts are sequences of line ids (64-bit hashes).  A suffix's rank is its place in
the order of all suffixes, those that agree so far having the rank of the first.

1. All places are sorted by line id; lines that stand once are left out.
2. Prefix doubling: suffixes that agree on h lines are sorted by the rank of the
   suffix h lines on, until no two agree.  A level is one range exchange of (rank,
   next rank, place), and as the place is part of the key a common line has no task
   of its own.  Each task numbers its rows and finds the heads of groups; one row a
   task on the driver carries numbers and groups over the borders of tasks.
3. Where a group falls apart at h lines, the two sides agree on h to 2h - 1 lines; the
   exact longest common prefix follows from the ranks of the levels below.
4. A place's longest earlier copy is the larger of its common prefixes with the nearest
   smaller places before and after it in the array.  The array is cut into slices of
   equal length; a slice is scanned with a stack, which begins with what
   the slices beside it leave open (steps of falling prefix and smallest place, so one
   for each length at most), worked out from a summary of every slice.

A run of at least ``min_words`` words (50) that stands earlier is deleted at the later
place.  Places are ordered by doc_id, then by the hash of the text, then by line.

Defined results
* null text: no lines, stays null.  Empty text: one empty line, which is no words.
* null ids come first.  Rows of equal id and text are one document with one result;
  each of these rows is returned.  (Copies under other ids are copies.)
* documents are numbered without gaps; more than 2^32 of them raise an error.
* a run does not cross documents; overlapping copies are deleted as a union.
* empty table: no rows.  Extra columns are kept; columns named like an output column are replaced.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType
from pyspark.sql.window import Window

from textquarry.session import BROADCAST_LIMIT, Scratch

#: Bits of a place for the line within a document (a text has fewer than 2^31 bytes), and for the number of the document.
LINE_BITS, DOC_BITS = 31, 32
#: Slices of the suffix array for each shuffle partition, and the places a slice has at least.
SLICES, LEAST_SLICE = 4, 1024


def _table(scratch: Scratch, rows: list[dict], schema: str) -> DataFrame:
    """A few rows that the driver made, one for each task, as a side to broadcast; no Python worker is started."""
    return F.broadcast(scratch.spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>"))))


def numbered(scratch: Scratch, rows: DataFrame) -> DataFrame:
    """``rows`` with doc, their number from 0 in the order of the tasks and of the rows within a task."""
    rows = scratch.write(rows.withColumn("__m", F.monotonically_increasing_id()), "order")
    task = F.shiftright("__m", 33)
    counts = rows.groupBy(task.alias("task")).agg(F.count("*").alias("n")).orderBy("task").collect()
    bases, total = [], 0
    for r in counts:
        bases.append({"__task": r["task"], "__base": total})
        total += r["n"]
    if total > 1 << DOC_BITS:
        raise ValueError(f"{total} documents; places number at most 2^{DOC_BITS}")
    bases = _table(scratch, bases, "__task:bigint,__base:bigint")
    rows = rows.join(bases, task == F.col("__task")).withColumn("doc", F.col("__base") + F.col("__m").bitwiseAND((1 << 33) - 1))
    return rows.drop("__m", "__task", "__base")


ORDERED = "part int, i long, pos long, g long, r long, h1 long, h2 long, prev long, bare boolean, many boolean"


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers the sorted rows (g, r, pos) of a task from 0, with the heads of their groups by g and by (g, r).

    A row without r is a group of its own.  ``prev`` is the place before, ``bare``
    whether r is missing in either, ``many`` whether the group has other rows here.
    The last row of a batch waits for the next batch.
    """
    part, at, h1, h2 = TaskContext.get().partitionId(), 0, -1, -1
    last = held = None

    def out(cols: dict[str, np.ndarray], many: np.ndarray) -> pa.RecordBatch:
        r = pa.array(cols["r"], mask=cols["null"])
        arrays = [pa.array(np.full(len(many), part, np.int32)), *(pa.array(cols[c]) for c in ("i", "pos", "g")), r, *(pa.array(cols[c]) for c in ("h1", "h2", "prev", "bare")), pa.array(many)]
        return pa.RecordBatch.from_arrays(arrays, [c.split()[0] for c in ORDERED.split(", ")])

    for batch in batches:
        n = len(batch)
        if n == 0:
            continue
        pos, g = (np.asarray(batch.column(c)) for c in (0, 1))
        null = np.asarray(batch.column(2).is_null())
        r = np.asarray(batch.column(2).fill_null(0))
        before = last if last is not None else (-1, g[0], 0, True)
        prev, pg, pr, pn = (np.concatenate(([b], a[:-1])) for b, a in zip(before, (pos, g, r, null)))
        new1 = g != pg
        new1[0] |= last is None
        new2 = new1 | null | pn | (r != pr)
        i = np.arange(at, at + n)
        cols = {
            "i": i, "pos": pos, "g": g, "r": r, "null": null, "new": new2, "prev": prev, "bare": null | pn,
            "h1": np.maximum(np.maximum.accumulate(np.where(new1, i, -1)), h1), "h2": np.maximum(np.maximum.accumulate(np.where(new2, i, -1)), h2),
        }
        at, h1, h2, last = at + n, cols["h1"][-1], cols["h2"][-1], (pos[-1], g[-1], r[-1], null[-1])
        if held is not None:
            cols = {c: np.concatenate((held[c], v)) for c, v in cols.items()}
        new = cols["new"]
        held = {c: v[-1:] for c, v in cols.items()}
        if len(new) > 1:
            yield out({c: v[:-1] for c, v in cols.items()}, ~new[:-1] | ~new[1:])
    if held is not None:
        yield out(held, ~held["new"])


def refined(scratch: Scratch, rows: DataFrame, name: str) -> DataFrame:
    """pos, rank, active, split, prev, bare of ``rows`` (pos, g: rank so far, r: what the groups of g are sorted by).

    ``active``: others have this rank.  ``split``: the row begins a group within
    that of g, next to the row at ``prev``.
    """
    sorted_ = scratch.write(rows.select("pos", "g", "r").orderBy("g", "r", "pos").mapInArrow(_heads, ORDERED), name)
    key = F.struct("g", "r", "pos", "h1", "h2")
    ends = sorted_.groupBy("part").agg(F.count("*").alias("n"), F.min_by(key, "i").alias("a"), F.max_by(key, "i").alias("z")).orderBy("part").collect()
    fixes, base, head1, head2, before = [], 0, 0, 0, None
    for e in ends:
        a, z = e["a"], e["z"]
        same1 = before is not None and before["g"] == a["g"]
        same2 = same1 and a["r"] is not None and before["r"] == a["r"]
        head1, head2 = head1 if same1 else base, head2 if same2 else base
        if same2:
            fixes[-1]["__tail"] = before["h2"]
        fixes.append({"part": e["part"], "__base": base, "__f1": head1, "__f2": head2, "__on": same2, "__tail": -1, "__prev": before["pos"] if before else -1, "__bare": before is None or before["r"] is None})
        head1 = head1 if z["h1"] == 0 else base + z["h1"]
        head2 = head2 if z["h2"] == 0 else base + z["h2"]
        base, before = base + e["n"], z
    fixes = _table(scratch, fixes, "part:int,__base:bigint,__f1:bigint,__f2:bigint,__on:boolean,__tail:bigint,__prev:bigint,__bare:boolean")
    head = lambda h, f: F.when(F.col(h) == 0, F.col(f)).otherwise(F.col("__base") + F.col(h))
    top1, top2, first = head("h1", "__f1"), head("h2", "__f2"), F.col("i") == 0
    return sorted_.join(fixes, "part").select(
        "pos",
        (F.col("g") + top2 - top1).alias("rank"),
        (F.col("many") | ((F.col("h2") == 0) & F.col("__on")) | (F.col("h2") == F.col("__tail"))).alias("active"),
        ((top2 == F.col("__base") + F.col("i")) & (top1 != top2)).alias("split"),
        F.when(first, F.col("__prev")).otherwise(F.col("prev")).alias("prev"),
        F.when(first, F.col("r").isNull() | F.col("__bare")).otherwise(F.col("bare")).alias("bare"),
    )


def suffix_array(scratch: Scratch, lines: DataFrame) -> tuple[DataFrame, DataFrame, int] | None:
    """(pos, rank), (rank, lcp with the place before in the array; 0 where missing), and the number of all places.

    ``lines`` has pos (consecutive within a document) and name (of the line).  Only
    places of lines that stand at several are in the array; None if there are none.
    """
    places = refined(scratch, lines.select("pos", F.lit(0).cast("long").alias("g"), F.col("name").alias("r")), "lines-sorted")
    places = scratch.write(places.where("active").select("pos", "rank", "active"), "rank0")
    tables, splits = [], []
    while not (active := places.where("active")).isEmpty():
        h = 1 << len(tables)
        tables.append(active.select("pos", "rank"))
        after = F.first("rank").over(Window.partitionBy(F.shiftright("pos", LINE_BITS)).orderBy("pos").rangeBetween(h, h))
        keyed = scratch.write(places.withColumn("r", after).where("active").select("pos", F.col("rank").alias("g"), "r"), f"keyed{h}")
        rows = refined(scratch, keyed, f"sorted{h}")
        splits.append(rows.where("split").select("rank", F.col("prev").alias("x"), F.col("pos").alias("y"), "bare", F.lit(h).cast("long").alias("lcp")))
        places = scratch.write(places.where("not active").unionByName(rows.select("pos", "rank", "active")), f"rank{2 * h}")
        scratch.forget(keyed)
    if not tables:
        return None
    done = [s.where("bare or lcp = 1").select("rank", "lcp") for s in splits]
    open_ = None
    for j in range(len(tables) - 2, -1, -1):
        more = splits[j + 1].where("not bare").select("rank", "x", "y", "lcp")
        open_ = more if open_ is None else open_.unionByName(more)
        for side in "xy":
            ranks = tables[j].select(F.col("pos").alias(f"__{side}"), F.col("rank").alias(f"r{side}"))
            open_ = open_.join(ranks, F.col(side) + F.col("lcp") == F.col(f"__{side}"), "left").drop(f"__{side}")
        longer = F.col("lcp") + F.when(F.col("rx") == F.col("ry"), F.lit(1 << j)).otherwise(F.lit(0))
        open_ = scratch.write(open_.select("rank", "x", "y", longer.alias("lcp")), f"prefix{1 << j}")
    if open_ is not None:
        done.append(open_.select("rank", "lcp"))
    lcps = done[0]
    for d in done[1:]:
        lcps = lcps.unionByName(d)
    return places.select("pos", "rank"), lcps, lines.count()


Steps = list[tuple[int, int]]  # (place, prefix shared with the border), both rising


def _scan(pos: list[int], lcp: list[int], carry: Steps) -> tuple[list[int], Steps]:
    """For each place its common prefix with the nearest smaller place before it, and what the scan leaves open.

    ``lcp`` is that of each place with the one before; ``carry`` is what came before the first.
    """
    stack = [(p, carry[i - 1][1] if i else 0) for i, (p, _) in enumerate(carry)]
    best, border = [], carry[-1][1] if carry else 0
    for n, (p, c) in enumerate(zip(pos, lcp)):
        c = min(c, border) if n == 0 else c
        while stack and stack[-1][0] > p:
            c = min(c, stack.pop()[1])
        best.append(c if stack else 0)
        stack.append((p, c))
    left: Steps = []
    reach = 1 << 62
    for p, c in reversed(stack):
        if left and left[-1][1] == reach:
            left[-1] = (p, reach)
        else:
            left.append((p, reach))
        reach = min(reach, c)
        if reach == 0:
            break
    return best, left[::-1]


def _joined(carry: Steps, through: int, own: Steps) -> Steps:
    """What is open after a slice that leaves ``own`` open by itself and whose least prefix is ``through``."""
    out: Steps = []
    for p, c in [(p, min(c, through)) for p, c in carry] + own:
        while out and (out[-1][0] >= p or (c > 0 and out[-1][1] == 0)):
            out.pop()
        if c and (not out or out[-1][1] < c):
            out.append((p, c))
    return out


def _slice(t: pa.Table) -> tuple[np.ndarray, list[int], list[int]]:
    """Places and prefixes of one slice in the order of the array."""
    rank, pos, lcp = (t[c].combine_chunks() for c in ("rank", "pos", "lcp"))
    is_place = np.asarray(pos.is_valid())
    rank = np.asarray(rank)
    order = np.argsort(rank[is_place], kind="stable")
    places, ranks = np.asarray(pos.fill_null(0))[is_place][order], rank[is_place][order]
    shared = np.zeros(len(ranks), np.int64)
    shared[np.searchsorted(ranks, rank[~is_place])] = np.asarray(lcp.fill_null(0))[~is_place]
    return places, places.tolist(), shared.tolist()


SUMMARY = "slice long, first long, inner long, left_at array<long>, left_lcp array<long>, right_at array<long>, right_lcp array<long>"


def _summary(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
    _, pos, lcp = _slice(t)
    _, left = _scan(pos, [0, *lcp[1:]], [])
    _, right = _scan(pos[::-1], [0, *lcp[:0:-1]], [])
    row = {"slice": key[0].as_py(), "first": lcp[0], "inner": min(lcp[1:], default=1 << 62)}
    for side, steps in (("left", left), ("right", right)):
        row |= {f"{side}_at": [p for p, _ in steps], f"{side}_lcp": [c for _, c in steps]}
    return pa.Table.from_pylist([row], pa.schema([(c.split()[0], pa.list_(pa.int64()) if "array" in c else pa.int64()) for c in SUMMARY.split(", ")]))


def longest_copies(scratch: Scratch, lines: DataFrame) -> DataFrame:
    """pos, length: the longest run of lines at each place that also stands earlier.

    ``lines`` has pos (consecutive within a document) and name (of the line).
    """
    found = suffix_array(scratch, lines)
    if found is None:
        return lines.select("pos", F.lit(0).cast("long").alias("length")).where("false")
    places, lcps, total = found
    parts = int(scratch.spark.conf.get("spark.sql.shuffle.partitions"))
    size = max(LEAST_SLICE, -(-total // (SLICES * parts)))
    slice_ = F.floor(F.col("rank") / F.lit(size)).alias("slice")
    none = F.lit(None).cast("long")
    rows = places.select(slice_, "rank", "pos", none.alias("lcp")).unionByName(lcps.select(slice_, "rank", none.alias("pos"), "lcp"))
    rows = scratch.write(rows, "array")
    known = rows.groupBy("slice").applyInArrow(_summary, SUMMARY).orderBy("slice").collect()
    carries: dict[int, tuple[Steps, Steps, int]] = {}
    left: Steps = []
    for r in known:
        carries[r["slice"]] = (left, [], 0)
        left = _joined(left, min(r["first"], r["inner"]), list(zip(r["left_at"], r["left_lcp"])))
    right: Steps = []
    edge = 0  # the prefix shared by a slice's last place and the next slice's first
    for r in reversed(known):
        carries[r["slice"]] = (carries[r["slice"]][0], right, edge)
        right = _joined(right, min(edge, r["inner"]), list(zip(r["right_at"], r["right_lcp"])))
        edge = r["first"]
    shared = scratch.spark.sparkContext.broadcast(carries)  # a few steps for each slice, and the slices are as many as SLICES x the partitions

    def copies(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        left, right, edge = shared.value[key[0].as_py()]
        places, pos, lcp = _slice(t)
        before, _ = _scan(pos, lcp, left)
        after, _ = _scan(pos[::-1], [edge, *lcp[:0:-1]], right)
        length = np.maximum(np.array(before, np.int64), np.array(after[::-1], np.int64))
        return pa.table({"pos": places[length > 0], "length": length[length > 0]})

    return scratch.write(rows.groupBy("slice").applyInArrow(copies, "pos long, length long"), "copies")


def maximal_runs(copies: DataFrame) -> DataFrame:
    """doc, at, size: the runs of each document that do not lie in the run a line before."""
    doc = F.shiftright("pos", LINE_BITS).alias("doc")
    before = F.lag(F.struct("pos", "length")).over(Window.partitionBy("doc").orderBy("pos"))
    rows = copies.select(doc, "pos", "length").withColumn("b", before)
    inside = F.col("b").isNotNull() & (F.col("b.pos") + 1 == F.col("pos")) & (F.col("b.length") > F.col("length"))
    line = (F.col("pos") % (1 << LINE_BITS)).cast("int")
    return rows.where(~inside).groupBy("doc").agg(F.collect_list(line).alias("at"), F.collect_list("length").alias("size"))


def _clean(min_words: int):
    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, starts, lengths = (batch.column(i).to_pylist() for i in range(1, 4))
            out, total, gone, spans = [], [], [], []
            for text, at, size in zip(texts, starts, lengths):
                lines = text.split("\n") if text is not None else []
                drop = np.zeros(len(lines), bool)
                if at:
                    words = np.concatenate(([0], np.cumsum([len(x.split()) for x in lines])))
                    for a, n in zip(at, size):
                        if words[a + n] - words[a] >= min_words:
                            drop[a : a + n] = True
                edge = np.flatnonzero(np.diff(np.concatenate(([0], drop.view(np.int8), [0]))))
                spans.append(",".join(f"{a}-{b - 1}" for a, b in edge.reshape(-1, 2)))
                out.append(None if text is None else "\n".join(x for x, d in zip(lines, drop) if not d))
                total.append(len(lines))
                gone.append(int(drop.sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string()), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.string())], ["__doc", "clean_text", "n_lines", "n_deleted", "deleted"])

    return clean


def _text_key(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))


def dedup_lines(docs: DataFrame, min_words: int = 50, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """All columns of ``docs`` with clean_text, n_lines, n_deleted and deleted (ranges of line numbers from 0)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "lines")
    docs = docs.drop("clean_text", "n_lines", "n_deleted", "deleted")
    ids = F.col(row_id).cast("long")
    # Only the hashes of lines are exchanged, not the texts.
    names = F.transform(F.split(F.col(text).cast("string"), "\n"), lambda x: F.xxhash64(x))
    rows = docs.select(ids.alias("id"), _text_key(text).alias("th"), names.alias("names")).where("names is not null")
    rows = scratch.write(rows.groupBy("id", "th").agg(F.first("names").alias("names")), "documents")
    order = numbered(scratch, rows.orderBy("id", "th"))
    lines = order.select(F.shiftleft("doc", LINE_BITS).alias("doc"), F.posexplode("names").alias("i", "name"))
    lines = scratch.write(lines.select((F.col("doc") + F.col("i")).alias("pos"), "name"), "lines")
    runs = maximal_runs(longest_copies(scratch, lines))
    known = order.select("id", "th", "doc").join(runs, "doc").select(F.col("id").alias("__id"), F.col("th").alias("__known"), F.col("at").alias("__at"), F.col("size").alias("__size"))
    known = scratch.write(known, "known")
    # Documents without a run are not in ``known``; its size in memory is counted.
    size = known.agg(F.sum(F.lit(64) + 12 * F.size("__at"))).first()[0] or 0
    known = F.broadcast(known) if size <= BROADCAST_LIMIT else known
    keyed = docs.withColumn("__th", _text_key(text))
    joined = keyed.join(known, (F.col("__th") == F.col("__known")) & ids.eqNullSafe(F.col("__id")) & F.col(text).isNotNull(), "left")
    return _cleaned(joined, docs.columns, text, min_words)


def _cleaned(joined: DataFrame, columns: list[str], text: str, min_words: int) -> DataFrame:
    at = columns.index(text)
    kept = joined.select(*columns, "__at", "__size")
    clean = _clean(min_words)

    def run(batches):
        for batch in batches:
            n = batch.num_columns
            need = pa.RecordBatch.from_arrays([pa.nulls(len(batch), pa.int64()), batch.column(at), batch.column(n - 2), batch.column(n - 1)], ["d", "t", "a", "s"])
            for got in clean(iter([need])):
                yield pa.RecordBatch.from_arrays([*batch.columns[: n - 2], *got.columns[1:]], [*batch.schema.names[: n - 2], "clean_text", "n_lines", "n_deleted", "deleted"])

    schema = StructType([*kept.schema.fields[:-2], StructField("clean_text", StringType()), StructField("n_lines", LongType()), StructField("n_deleted", LongType()), StructField("deleted", StringType())])
    return kept.mapInArrow(run, schema)
