"""Mixing sources to target weights: temperature mixing and budgeted block permutations.

A source's weight is its share of tokens to the power of an exponent between 0
(all alike) and 1 (as they are), normalised.  The exponent is bisected, many
probes a pass, to the smallest that keeps every source's repetitions within
``max_repeat``, or to the largest whose weights have at least ``entropy`` (nats).

The budget is the number of tokens at which the least repeated source is read
once (so that no row is lost), or ``budget`` if given.  A source's part of it is
dealt out in blocks: rows fall into blocks by a hash of their id, every pass over
the source permutes its blocks afresh, and the last pass ends in the middle of a
block: its rows are read by a hash while tokens are left, so up to a bound of that
hash.  The bound is found by sums over the hash's high bits, then among the rows of
the one interval that holds it.  ``mix_key`` (0 to 1) is the place of a block in its
source's stream; sorting by it interleaves the sources by weight throughout.

Only expressions and joins: no Python on the executors.  Hashes and token counts of the
rows tell what is read, and the texts are filtered by block and bound: where they are while
the table of blocks is small (``session.small``), exchanged by source and block beyond that.  A hot source has up to ``most_blocks`` blocks, so it is many small
groups, and blocks are summed before anything is sorted.

Defined results
* null source: a source of its own.  Null or empty text: no tokens.
* a source without tokens: read once.  Rows in the input many times are as many rows.
* rows without an id fall into blocks by their text.  Rows equal in id (without one: in
  text) are read or left together in the last pass.  Empty table: no rows.
* columns of the input named like an output column are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textquarry.session import Scratch, small

OUTPUT = ("tokens", "weight", "repeats", "epoch", "block", "mix_key")


def word_count(text: str) -> Column:
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def find_exponent(shares: DataFrame, max_repeat: float | None = None, entropy: float | None = None, budget: float | None = None, probes: int = 32, passes: int = 5) -> float:
    """The exponent for the target; ``shares`` has p (share of tokens, above 0) and total (tokens).

    Each pass evaluates ``probes`` exponents in one aggregation, whatever the number of sources.
    """
    if (max_repeat is None) == (entropy is None):
        raise ValueError("give either max_repeat or entropy")
    low, high = 0.0, 1.0
    for _ in range(passes):
        grid = [low + (high - low) * i / probes for i in range(probes + 1)]
        sums = []
        for i, a in enumerate(grid):
            q = F.pow(F.col("p"), F.lit(a))
            sums += [F.sum(q).alias(f"z{i}"), F.max(q / F.col("p")).alias(f"m{i}"), F.min(q / F.col("p")).alias(f"l{i}"), F.sum(q * F.lit(a) * F.log("p")).alias(f"h{i}")]
        r = shares.agg(F.max("total").alias("total"), *sums).first()
        if r["total"] is None:
            return 1.0

        def meets(i: int) -> bool:
            if entropy is not None:
                z = r[f"z{i}"]
                return math.log(z) - r[f"h{i}"] / z >= entropy - 1e-12
            most = r[f"m{i}"] / r[f"l{i}"] if budget is None else r[f"m{i}"] / r[f"z{i}"] * budget / r["total"]
            return most <= max_repeat + 1e-9

        ok = [meets(i) for i in range(probes + 1)]
        if entropy is not None:  # entropy falls as the exponent grows: the last that meets it
            last = max((i for i, x in enumerate(ok) if x), default=0)
            low, high = grid[last], grid[min(last + 1, probes)]
        else:  # repetition falls as the exponent grows: the first that meets it
            first = min((i for i, x in enumerate(ok) if x), default=probes)
            low, high = grid[max(first - 1, 0)], grid[first]
    return low if entropy is not None else high


def mix_sources(
    docs: DataFrame,
    max_repeat: float | None = 2.0,
    entropy: float | None = None,
    budget: float | None = None,
    source: str = "source",
    text: str = "text",
    row_id: str = "doc_id",
    seed: int = 17,
    block_tokens: int = 1 << 16,
    most_blocks: int = 4096,
) -> DataFrame:
    """The rows of the mixed stream: all columns of ``docs`` and ``OUTPUT``.

    A row appears once for each pass that reads it; ``epoch`` counts the passes
    from 0.  ``weight`` is its source's weight, ``repeats`` how often the source is read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mix")
    docs = docs.drop(*OUTPUT)
    key = F.coalesce(F.concat(F.lit("s:"), F.col(source).cast("string")), F.lit("null"))
    spread = F.xxhash64(F.lit(seed), F.coalesce(F.col(row_id).cast("string"), F.xxhash64(text).cast("string")))
    keyed = docs.withColumns({"__s": key, "tokens": word_count(text), "__x": spread})
    slim = scratch.write(keyed.select("__s", "__x", "tokens"), "rows")
    # Block sums of the finest blocks; coarser blocks and source totals follow from them.
    fine = scratch.write(slim.groupBy("__s", F.pmod("__x", F.lit(most_blocks)).alias("f")).agg(F.sum("tokens").alias("t")), "fine")
    total = fine.groupBy("__s").agg(F.sum("t").alias("t"))
    whole = fine.agg(F.sum("t")).first()[0] or 0
    shares = scratch.write(total.where("t > 0").select("__s", "t", (F.col("t") / F.lit(float(whole or 1))).alias("p"), F.lit(float(whole)).alias("total")), "shares")
    a = find_exponent(shares, max_repeat, entropy, budget)
    z = shares.agg(F.sum(F.pow("p", F.lit(a))).alias("z"), F.min(F.pow("p", F.lit(a - 1.0))).alias("l")).first()
    size = budget if budget is not None else whole * (z["z"] / z["l"] if z["l"] else 1.0)
    weight = F.pow("p", F.lit(a)) / F.lit(z["z"] or 1.0)
    part = weight * F.lit(float(size))
    plan = shares.select("__s", "t", weight.alias("weight"), part.alias("quota"), F.round(part / F.col("t"), 9).alias("repeats"))
    plan = total.select("__s").join(plan, "__s", "left").select("__s", F.coalesce("t", F.lit(0)).alias("t"), F.coalesce("weight", F.lit(0.0)).alias("weight"), F.coalesce("quota", F.lit(0.0)).alias("quota"), F.coalesce("repeats", F.lit(1.0)).alias("repeats"))
    # A source has a power of two of blocks, so that blocks are unions of the finest.
    n = F.least(F.lit(most_blocks), F.pow(F.lit(2), F.ceil(F.log2(F.greatest(F.lit(1.0), F.col("t") / F.lit(block_tokens)))))).cast("long")
    plan = scratch.write(plan.withColumn("n_blocks", n), "plan")

    sums = fine.withColumnRenamed("t", "ft").join(small(plan), "__s").groupBy("__s", "t", "weight", "quota", "repeats", "n_blocks", F.pmod("f", F.col("n_blocks")).alias("block")).agg(F.sum("ft").alias("bt"))
    runs = sums.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil("repeats").cast("int") - 1))))
    order = F.xxhash64(F.lit(seed), "__s", "epoch", "block")
    runs = runs.withColumn("before", F.sum("bt").over(Window.partitionBy("__s", "epoch").orderBy(order, "block").rowsBetween(Window.unboundedPreceding, -1)))
    left = F.round((F.col("repeats") - F.col("epoch")) * F.col("t")) - F.coalesce("before", F.lit(0))
    # Blocks without tokens at the end of a whole pass have nothing left before them, but rows to read.
    runs = runs.withColumn("left", left).where("left > 0 or t = 0 or (epoch = 0 and repeats >= 1)")
    place = (F.col("epoch") * F.col("t") + F.coalesce("before", F.lit(0))) / F.greatest(F.col("quota"), F.lit(1.0))
    runs = scratch.write(runs.select("__s", "block", "epoch", "weight", "repeats", "n_blocks", (F.col("left") < F.col("bt")).alias("cut"), "left", F.least(place, F.lit(1.0)).alias("mix_key")), "runs")

    blocks = small(plan.select("__s", "n_blocks"))
    in_block = F.pmod("__x", F.col("n_blocks"))
    ends = scratch.write(_ends(slim.join(blocks, "__s").withColumn("block", in_block), runs, seed), "ends")
    runs = scratch.write(runs.join(ends, ["__s", "block", "epoch"], "left").drop("n_blocks", "left"), "bounded")
    out = keyed.join(blocks, "__s").withColumn("block", in_block).drop("n_blocks").join(small(runs), ["__s", "block"])
    return out.where(~F.col("cut") | (_within(seed) <= F.col("bound"))).select(*docs.columns, *OUTPUT)


def _within(seed: int) -> Column:
    """The hash by which the rows of a pass's last block are read."""
    return F.xxhash64(F.lit(seed), "epoch", "__x")


def _ends(rows: DataFrame, runs: DataFrame, seed: int, bits: int = 12) -> DataFrame:
    """__s, block, epoch, bound: the largest hash that is read of each block that ends a pass.

    A row is read if the rows of smaller hashes have fewer tokens than are left.
    """
    keys = ["__s", "block", "epoch"]
    cut = rows.join(small(runs.where("cut").select(*keys, "left")), ["__s", "block"]).withColumn("y", _within(seed))
    cut = cut.withColumn("high", F.shiftrightunsigned(F.col("y").bitwiseXOR(F.lit(-(1 << 63))), 64 - bits))
    sums = cut.groupBy(*keys, "high", "left").agg(F.sum("tokens").alias("t"))
    before = lambda by, part: F.coalesce(F.sum("t").over(Window.partitionBy(*part).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # At most 2^bits intervals a block; the last one that is begun holds the bound.
    begun = sums.withColumn("b", before("high", keys)).where("b < left")
    last = begun.groupBy(*keys).agg(F.max(F.struct("high", "b")).alias("m")).select(*keys, F.col("m.high").alias("high"), F.col("m.b").alias("b"))
    inside = cut.join(small(last), [*keys, "high"]).groupBy(*keys, "y", "left", "b").agg(F.sum("tokens").alias("t"))
    read = inside.withColumn("b", F.col("b") + before("y", keys)).where("b < left")
    return read.groupBy(*keys).agg(F.max("y").alias("bound"))
