"""Sharding by histogram sort: equal-byte ranges of a hashed key, without sampling.

The key of a row is (hash of its text, doc_id).  Where rows share both, the rows are written
once with a number each, and the key is (hash of the text, hash of doc_id and number).
Borders are found by counting, over all rows, the exact bytes below candidate
keys; candidates are refined between the counted ones until each border meets
the tolerance; then rows are exchanged once, to sort the small buckets between
counted keys.  Everything is DataFrame expressions; the driver holds only the
counted candidates, whose number depends on the number of buckets.

Copies of a text have neighbouring keys, so a group of copies stays together
unless a border falls inside it; then ``doc_id`` splits it.

Defined results
* null text: size 1 (no bytes), crc32 of no bytes; null doc_id: before all ids.
* rows repeated in text and doc_id have keys of their own, so the law holds for them
  too; which of them is in which slot is settled once and stored.
* empty table: no rows.  Columns of the input named like an output column are replaced.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textquarry.session import Scratch

_MIN, _MAX = -(1 << 63), (1 << 63) - 1


@dataclass(frozen=True)
class Border:
    """A counted key: rows and bytes strictly below it."""

    key: int
    rows: int
    bytes: int
    low: int = 0


class _KeySpace:
    """Keys (h, d) as integers: h is the high part, d counts from the smallest id."""

    def __init__(self, low: int, high: int):
        self.low, self.width = low, high - low + 1

    def of(self, h: int, d: int) -> int:
        return (h - _MIN) * self.width + (d - self.low)

    def pair(self, key: int) -> tuple[int, int]:
        h, d = divmod(key, self.width)
        return h + _MIN, d + self.low

    @property
    def end(self) -> int:
        return (1 << 64) * self.width


def _nested(groups: list[list[tuple[int, int]]]) -> Column:
    """An array of arrays of keys, from one JSON literal so that the plan stays small."""
    text = json.dumps([[{"h": h, "d": d} for h, d in g] for g in groups])
    return F.from_json(F.lit(text), "array<array<struct<h:bigint,d:bigint>>>")


def _ints(values: list[int]) -> Column:
    return F.from_json(F.lit(json.dumps(values)), "array<int>")


def _at_or_below(groups: list[list[tuple[int, int]]], g: Column) -> Column:
    """How many keys of the row's group are at or below the row's key."""
    return F.size(F.filter(F.element_at(_nested(groups), g), lambda x: (x["h"] < F.col("__h")) | ((x["h"] == F.col("__h")) & (x["d"] <= F.col("__d")))))


def _prefix(h: Column, bits: int) -> Column:
    """The high bits of a signed hash, counted from 0 in key order."""
    return F.shiftrightunsigned(h.bitwiseXOR(F.lit(_MIN)), 64 - bits).cast("int")


def find_borders(keys: DataFrame, n_shards: int, bits: int, tolerance: float, parts: int, fan: int = 64) -> tuple[list[Border], list[Border], int]:
    """Counted candidate keys (by key), the chosen borders, and the keys' width of a prefix.

    ``keys`` has __h, __d, size.  Each round counts, in one pass with partial
    sums, rows and bytes between the candidates of every interval that still
    needs refining: it holds a shard border that is not met yet, or more rows
    than one task should sort.
    """
    span = keys.agg(F.min("__d").alias("a"), F.max("__d").alias("b")).first()
    if span["a"] is None:
        return [], [], 1
    space = _KeySpace(span["a"], span["b"])
    step = (1 << (64 - bits)) * space.width
    sums = [F.count("*").alias("n"), F.sum("size").alias("s")]
    found = {r["p"]: (r["n"], r["s"]) for r in keys.groupBy(_prefix(F.col("__h"), bits).alias("p")).agg(*sums).collect()}
    counted, rows, size = [], 0, 0
    for p in range(1 << bits):
        counted.append(Border(p * step, rows, size, space.low))
        n, s = found.get(p, (0, 0))
        rows, size = rows + n, size + s
    counted.append(Border(space.end, rows, size))
    allowed, most = tolerance * size / n_shards, max(256, 2 * rows // parts)

    def unmet(a: Border, b: Border) -> bool:
        """Whether a shard border lies strictly inside and both ends are too far from it."""
        return any(a.bytes < t < b.bytes and min(t - a.bytes, b.bytes - t) > allowed for t in (k * size / n_shards for k in range(1, n_shards)))

    while todo := [(a, b) for a, b in zip(counted, counted[1:]) if b.key - a.key > 1 and b.rows - a.rows > 1 and (b.rows - a.rows > most or unmet(a, b))]:
        groups: dict[int, set[int]] = {}
        for a, b in todo:
            groups.setdefault(a.key // step, set()).update(a.key + (b.key - a.key) * j // fan for j in range(fan + 1))
        order = sorted(groups)
        probes = [sorted(groups[p]) for p in order]
        g = F.array_position(_ints(order), _prefix(F.col("__h"), bits)).cast("int")
        hit = keys.select("__h", "__d", "size", g.alias("g")).where("g > 0")
        below = _at_or_below([[space.pair(k) for k in keys_of[:-1]] for keys_of in probes], F.col("g"))
        got = {(r["g"], r["b"]): (r["n"], r["s"]) for r in hit.select("g", "size", below.alias("b")).groupBy("g", "b").agg(*sums).collect()}
        known = {c.key: c for c in counted}
        for g_no, keys_of in enumerate(probes, 1):
            for b_no, (left, right) in enumerate(zip(keys_of, keys_of[1:]), 1):
                if right not in known:
                    n, s = got.get((g_no, b_no), (0, 0))
                    known[right] = Border(right, known[left].rows + n, known[left].bytes + s)
        counted = [known[k] for k in sorted(known)]
    chosen = [min(counted, key=lambda c: (abs(c.bytes - k * size / n_shards), c.key)) for k in range(1, n_shards)]
    return counted, chosen, step


def histogram_shards(
    df: DataFrame,
    n_shards: int = 8,
    text: str = "text",
    row_id: str = "doc_id",
    size: Column | None = None,
    tolerance: float = 0.001,
    buckets: int | None = None,
) -> DataFrame:
    """All rows and columns of ``df`` with ``size``, ``shard`` and ``slot``.

    Shards hold nearly the same number of bytes (``size``: bytes of the text plus
    one, unless given); ``slot`` counts from 0 within a shard without gaps, in
    key order.  ``tolerance`` is the allowed distance of a border from its exact
    place as a share of a shard; where one row is larger, the nearest key is taken.
    ``buckets``: pieces to sort, by default eight for each shuffle partition.
    """
    spark = df.sparkSession
    df = df.drop("size", "shard", "slot")
    if size is None:
        size = F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long") + 1
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bits = max(3, ((buckets or parts * 8) - 1).bit_length())
    h = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    d = F.coalesce(F.col(row_id).cast("long"), F.lit(_MIN))
    keyed = df.withColumns({"__h": h, "__d": d, "size": size})
    scratch = Scratch(spark, "shards")
    keys = scratch.write(keyed.select("__h", "__d", "size"), "keys")
    if not keys.groupBy("__h", "__d").count().where("count > 1").isEmpty():
        numbered = keyed.withColumn("__no", F.monotonically_increasing_id())
        keyed = Scratch(spark, "numbered").write(numbered.withColumn("__d", F.xxhash64("__d", "__no")).drop("__no"), "rows")
        keys = scratch.write(keyed.select("__h", "__d", "size"), "numbered-keys")
    counted, chosen, step = find_borders(keys, n_shards, bits, tolerance, parts)
    scratch.drop()
    if not counted:
        return df.withColumns({"size": size, "shard": F.lit(0), "slot": F.lit(0).cast("long")})

    inner: dict[int, list[Border]] = {}
    for c in counted[:-1]:
        inner.setdefault(c.key // step, []).append(c)
    split = sorted(p for p, cs in inner.items() if len(cs) > 1)
    width = step >> (64 - bits)

    def pair(key: int) -> tuple[int, int]:
        high, low = divmod(key, width)
        return high + _MIN, low + lowest

    lowest = counted[0].low
    shard_of = [sum(b.key <= c.key for b in chosen) for c in counted[:-1]]
    first_row = [0, *(b.rows for b in chosen)]
    rows = []
    for p, cs in inner.items():
        rows += [(p, i, c) for i, c in enumerate(cs)]
    rows = [{"p": p, "i": i, "shard": s, "base": c.rows - first_row[s]} for (p, i, c), s in zip(rows, shard_of)]
    table = F.from_json(F.lit(json.dumps(rows)), "array<struct<p:int,i:int,shard:int,base:bigint>>")
    pieces = spark.range(1).select(F.inline(table))
    p = _prefix(F.col("__h"), bits)
    i = F.lit(0)
    if split:
        g = F.array_position(_ints(split), p).cast("int")
        i = F.when(g > 0, _at_or_below([[pair(c.key) for c in inner[q][1:]] for q in split], g)).otherwise(0)
    ranked = keyed.withColumns({"__p": p, "__i": i}).withColumn("__n", F.row_number().over(Window.partitionBy("__p", "__i").orderBy("__h", "__d")))
    # The pieces number a few for each shuffle partition, whatever the data: safe to broadcast.
    out = ranked.join(F.broadcast(pieces), (F.col("__p") == F.col("p")) & (F.col("__i") == pieces["i"]))
    return out.select(*df.columns, "size", "shard", (F.col("base") + F.col("__n") - 1).alias("slot"))
