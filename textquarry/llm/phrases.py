"""Phrase collocations: frequent word n-grams by pivot partitioning, scored at their weakest cut.

Texts are lower-cased (A-Z), split at ``[.,;:!?\\x0A-\\x0D]`` into pieces and those into
words ``[^\\x20\\x09]+``.  All counts are per language and exact.

1. One pass counts the words and fills a sketch of word pairs: a fixed number of
   saturating counters, so a pair is never taken for rarer than it is.  The words'
   counts become a second sketch, which orders the words from frequent to rare.
2. A second pass writes text fragments.  An n-gram belongs to its rarest word, the
   *pivot* (the leftmost of several).  For each place of a pivot the fragment holds the
   neighbours up to the first one that is rarer, or that no frequent pair leads to.
   Equal fragments of a task are one row with a count.
3. Fragments are exchanged by pivot and mined there: only n-grams that the pivot owns,
   and of these only the frequent ones, leave the task.  Fragments of a very common
   pivot go to several tasks, whose partial counts are summed.
4. Scores come from joins of the frequent n-grams with the counts of their parts.

Sketches only save work: what they let through is counted exactly, and what they keep
back is rarer than ``min_count``.  Their size is a parameter, not a matter of the corpus.

Defined results
* null text: no words; null lang: ``und``; an empty lang is a language of its own.
* words are told apart by 64-bit hashes of (lang, word); two words with one hash
  raise an error, as does ``min_count`` beyond 255.
* rows repeated: each counts.  Empty table, or nothing frequent: no rows.
* a text of any length is read in pieces; one word must fit a task.
* Columns of the input other than the text and the language are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textquarry.llm import kernels as K
from textquarry.session import Scratch

#: Pair counters travel in blocks of this many; a language's phrases are ranked in this many parts first.
BLOCK, PARTS = 1 << 16, 32


@dataclass(frozen=True)
class Sizes:
    """Counters of the two sketches (powers of two), bytes of text looked at together, rows that a task gathers before
    it merges equal ones, and the occurrences of a pivot beyond which its fragments go to several tasks."""

    words: int = 1 << 22
    pairs: int = 1 << 25
    run_bytes: int = K.RUN_BYTES
    gather: int = 1 << 18
    split: int = 1 << 21


_SPACE, _BREAK = 1, 2
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = _SPACE
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = _BREAK
_VALUE = K.mix(np.arange(1, 257, dtype=np.uint64) * K.U(0xA24BAED4963EE407))[K._LOWER]
_A, _B = K.U(0x9E3779B97F4A7C15), K.U(0xC2B2AE3D27D4EB4F)


def _language(name: str) -> int:
    return int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8).digest(), "little")


def _split(buf: np.ndarray, off: np.ndarray, lang: np.ndarray) -> tuple[np.ndarray, ...]:
    """Hash, whether it follows the word before within a piece, document, start and end of each word of a run."""
    kind = _KIND[buf]
    inside = kind == 0
    n = len(buf)
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    before[off[:-1][off[:-1] < n]] = False
    after[off[1:][off[1:] > 0] - 1] = False
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    if not len(start):
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), np.zeros(0, bool), z, z, z
    value = np.where(inside, _VALUE[buf], K.U(0))
    if n <= K.RUN_BYTES:
        up, down = K._powers(K.RUN_BYTES)
        h = np.add.reduceat(value * up[:n], start) * down[start]
    else:  # a long word stands in this run
        h = np.array([K._long_word(_VALUE, buf[a:b]) for a, b in zip(start, end)], np.uint64)
    doc = np.searchsorted(off, start, side="right") - 1
    w = K.mix(K.mix(h) ^ lang[doc])
    w[w == 0] = 1  # 0 stands for no word
    breaks = np.cumsum(kind == _BREAK)[start]
    joined = np.zeros(len(w), bool)
    joined[1:] = (doc[1:] == doc[:-1]) & (breaks[1:] == breaks[:-1])
    return w, joined, doc, start, end


def _cuts(buf: np.ndarray, step: int) -> list[int]:
    """Ends of the pieces in which a long text is read: each just behind a byte that is in no word."""
    out, at = [], 0
    while len(buf) - at > step:
        stop = at + step
        while stop < len(buf):
            gap = np.flatnonzero(_KIND[buf[stop : stop + step]])
            if len(gap):
                stop += int(gap[0]) + 1
                break
            stop += step
        at = min(stop, len(buf))
        out.append(at)
    return out if at == len(buf) else [*out, len(buf)]


@dataclass
class Words:
    """Words of a run or of a piece of a long text.

    Those from ``fresh`` on are new, with document, start and end in ``buf``; those before are context.
    ``lo`` to ``hi`` are the places whose two neighbours on each side are known by now.
    """

    w: np.ndarray
    joined: np.ndarray
    fresh: int
    lo: int
    hi: int
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    buf: np.ndarray

    def texts(self, new: np.ndarray) -> pa.Array:
        """The lower-cased words with these numbers among the new ones."""
        start, size = self.start[new], (self.end - self.start)[new]
        ends = np.cumsum(size)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - size), size)
        offsets = np.concatenate(([0], ends)).astype(np.int64)
        return pa.LargeStringArray.from_buffers(len(new), pa.py_buffer(offsets), pa.py_buffer(K._LOWER[self.buf[at]]))


def words_of(batch: pa.RecordBatch, run_bytes: int) -> Iterator[tuple[Words, list[str]]]:
    """Runs of words of (lang, text) rows, each with the languages of its documents.

    A long text comes in pieces.  Each brings up to four words of the one before: two as
    context and two whose right neighbours were not known yet.
    """
    names = batch.column(0).cast(pa.string()).fill_null("und").to_pylist()
    hashed = {x: _language(x) for x in set(names)}
    for a, b, buf, off in K.runs(batch.column(1), run_bytes):
        lang = np.array([hashed[x] for x in names[a:b]], np.uint64)
        if len(buf) <= run_bytes:
            w, joined, doc, start, end = _split(buf, off, lang)
            yield Words(w, joined, 0, 0, len(w), doc, start, end, buf), names[a:b]
            continue
        old_w, old_joined, waiting, broken, low = np.zeros(0, np.uint64), np.zeros(0, bool), 0, False, 0
        for cut in _cuts(buf, run_bytes // 2):
            part, low = buf[low:cut], cut
            w, joined, doc, start, end = _split(part, np.array([0, len(part)]), lang)
            breaks = np.flatnonzero(_KIND[part] == _BREAK)
            if len(w):
                broken |= bool((breaks < start[0]).any())
                joined[0] = len(old_w) > 0 and not broken
                broken = bool((breaks >= end[-1]).any())
            else:
                broken |= len(breaks) > 0
            fresh = len(old_w)
            old_w, old_joined = np.concatenate((old_w, w)), np.concatenate((old_joined, joined))
            lo = fresh - waiting
            hi = len(old_w) if cut == len(buf) else max(lo, len(old_w) - 2)
            yield Words(old_w, old_joined, fresh, lo, hi, doc, start, end, part), names[a:b]
            waiting, keep = len(old_w) - hi, max(0, hi - 2)
            old_w, old_joined = old_w[keep:], old_joined[keep:]


def _pair(first: np.ndarray, second: np.ndarray, slots: int) -> np.ndarray:
    """The slot of the counter of a pair of words."""
    return (K.mix(first * _A + second * _B) & K.U(slots - 1)).astype(np.int64)


def _count(sizes: Sizes):
    """Rows (w, lang, word, n, block, counts): counts of a task's words, and the blocks of its pair counters."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = np.zeros(sizes.pairs, np.uint8)
        held: list[pa.Table] = []

        def merged() -> pa.Table:
            return pa.concat_tables(held).group_by(["w", "lang", "word"]).aggregate([("n", "sum")]).rename_columns(["w", "lang", "word", "n"])

        def rows(t: pa.Table) -> Iterator[pa.RecordBatch]:
            none = [pa.nulls(len(t), pa.int32()), pa.nulls(len(t), pa.binary())]
            whole = pa.table([*(t.column(c).cast(k) for c, k in (("w", pa.int64()), ("lang", pa.string()), ("word", pa.string()), ("n", pa.int64()))), *none], ["w", "lang", "word", "n", "block", "counts"])
            yield from whole.to_batches(max_chunksize=1 << 16)

        size = 0
        for batch in batches:
            for x, names in words_of(batch, sizes.run_bytes):
                if len(x.w) == x.fresh:
                    continue
                u, first, n = np.unique(x.w[x.fresh :], return_index=True, return_counts=True)
                langs = pa.array([names[d] for d in x.doc[first].tolist()], pa.string())
                held.append(pa.table([pa.array(K.signed(u)), langs, x.texts(first), pa.array(n)], ["w", "lang", "word", "n"]))
                size += len(u)
                at = np.flatnonzero(x.joined[max(x.fresh, 1) :]) + max(x.fresh, 1)
                slot, n = np.unique(_pair(x.w[at - 1], x.w[at], sizes.pairs), return_counts=True)
                pairs[slot] = np.minimum(pairs[slot] + np.minimum(n, 255), 255)
                if size > sizes.gather:
                    held = [merged()]
                    size = len(held[0])
                    if size > sizes.gather // 2:
                        yield from rows(held[0])
                        held, size = [], 0
        if held:
            yield from rows(merged())
        for block in range(sizes.pairs // BLOCK):
            counts = pairs[block * BLOCK : (block + 1) * BLOCK]
            some = np.flatnonzero(counts)
            if len(some):
                data = counts.tobytes() if 3 * len(some) > BLOCK else some.astype("<u2").tobytes() + counts[some].tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([None], pa.string()), pa.array([None], pa.string()), pa.array([None], pa.int64()), pa.array([block], pa.int32()), pa.array([data], pa.binary())], ["w", "lang", "word", "n", "block", "counts"])

    return count


def _add_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums the counters of each block; rows come sorted by block."""
    last, total = None, np.zeros(BLOCK, np.uint16)
    out = lambda: pa.RecordBatch.from_arrays([pa.array([last], pa.int32()), pa.array([total.astype(np.uint8).tobytes()], pa.binary())], ["block", "counts"])
    for batch in batches:
        for block, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if block != last:
                if last is not None:
                    yield out()
                last, total = block, np.zeros(BLOCK, np.uint16)
            if len(data) == BLOCK:
                total = np.minimum(total + np.frombuffer(data, np.uint8), 255)
            else:
                k = len(data) // 3
                at = np.frombuffer(data, "<u2", k)
                total[at] = np.minimum(total[at] + np.frombuffer(data, np.uint8, k, 2 * k), 255)
    if last is not None:
        yield out()


FRAGMENT = "pivot long, part int, parts int, l2 long, l1 long, r1 long, r2 long, n long"


def _merge_equal(cols: list[np.ndarray], n: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of some columns, by the first one, with summed counts."""
    key = np.zeros(len(n), np.uint64)
    for c in cols:
        key = K.mix(key * _A + c)
    order = np.argsort(key, kind="stable")
    sorted_ = [c[order] for c in cols]
    head = np.ones(len(n), bool)
    head[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in sorted_])  # by the columns themselves: rows of one hash that differ stay apart
    at = np.flatnonzero(head)
    return [c[at] for c in sorted_], np.add.reduceat(n[order], at) if len(at) else n[:0]


def _fragments(levels, pairs, min_count: int, sizes: Sizes):
    """Fragments of every place that is the rarest of some possibly frequent n-gram."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level_of, seen = levels.value, pairs.value
        held: list[list[np.ndarray]] = []

        def merged() -> list[np.ndarray]:
            cols = [np.concatenate(c) for c in zip(*held)]
            distinct, n = _merge_equal(cols[:5], cols[5])
            return [*distinct, n]

        def rows(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            pivot, n = cols[0], cols[5]
            level = level_of[(pivot & K.U(sizes.words - 1)).astype(np.int64)].astype(float)
            parts = np.maximum(1, min_count * 2.0 ** (level / 8) / sizes.split).astype(np.int64)
            mixed = K.mix(K.mix(cols[1] * _A + cols[2]) * _B + K.mix(cols[3] * _A + cols[4]))
            part = (mixed % parts.astype(np.uint64)).astype(np.int32)
            arrays = [K.signed(pivot), part, parts.astype(np.int32), *(K.signed(c) for c in cols[1:5]), n]
            table = pa.table([pa.array(a) for a in arrays], FRAGMENT_NAMES)
            yield from table.to_batches(max_chunksize=1 << 16)

        size = 0
        for batch in batches:
            for x, _ in words_of(batch, sizes.run_bytes):
                m = len(x.w)
                if x.hi <= x.lo:
                    continue
                level = level_of[(x.w & K.U(sizes.words - 1)).astype(np.int64)]
                rare = (np.uint64(255) - level.astype(np.uint64)) << K.U(56) | x.w >> K.U(8)
                link = x.joined & (level > 0)  # link[i]: the pair (i - 1, i) may be frequent
                link[1:] &= level[:-1] > 0
                at = np.flatnonzero(link)
                at = at[at > 0]
                link[:] = False
                link[at] = seen[_pair(x.w[at - 1], x.w[at], sizes.pairs)] >= min_count
                # Places beyond the ends: no link leads there.
                link = np.concatenate(([False, False], link, [False, False]))
                key = np.concatenate((np.zeros(2, np.uint64), rare, np.zeros(2, np.uint64)))
                w = np.concatenate((np.zeros(2, np.uint64), x.w, np.zeros(2, np.uint64)))
                i = np.arange(x.lo, x.hi) + 2
                k = key[i]
                l1 = link[i] & (key[i - 1] < k)
                l2 = l1 & link[i - 1] & (key[i - 2] < k)
                r1 = link[i + 1] & (key[i + 1] <= k)
                r2 = r1 & link[np.minimum(i + 2, m + 3)] & (key[i + 2] <= k)
                some = l1 | r1
                i = i[some]
                if not len(i):
                    continue
                pick = lambda mask, j: np.where(mask[some], w[j], K.U(0))
                held.append([w[i], pick(l2, i - 2), pick(l1, i - 1), pick(r1, i + 1), pick(r2, i + 2), np.ones(len(i), np.int64)])
                size += len(i)
                if size > sizes.gather:
                    held = [merged()]
                    size = len(held[0][0])
                    if size > sizes.gather // 2:
                        yield from rows(held[0])
                        held, size = [], 0
        if held:
            yield from rows(merged())

    return write


FRAGMENT_NAMES = [c.split()[0] for c in FRAGMENT.split(", ")]


def _mine(min_count: int, sizes: Sizes):
    """(w1, w2, w3, n) of the n-grams that the pivots of a task own; w3 is 0 in a pair.

    Rows come sorted by pivot.  N-grams of a pivot that stands whole in what is gathered are
    final, and the rare ones are left out; of others partial counts are given.
    """

    def grams(cols: list[np.ndarray], n: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        p, l2, l1, r1, r2 = cols
        none = np.zeros(len(p), np.uint64)
        made = [(l1, p, none, l1), (p, r1, none, r1), (l2, l1, p, l2), (l1, p, r1, l1 * r1.astype(bool)), (p, r1, r2, r2)]
        parts = [(a[u], b[u], c[u], p[u], n[u]) for a, b, c, has in made for u in [np.flatnonzero(has)]]
        return _merge_equal([np.concatenate(x) for x in list(zip(*parts))[:4]], np.concatenate([x[4] for x in parts]))

    def mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        size, open_pivot = 0, None

        def out(cols: list[np.ndarray], last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal open_pivot
            (a, b, c, owner), n = grams([cols[0], *cols[2:6]], cols[6])
            split = np.unique(cols[0][cols[1] > 1])
            partial = np.isin(owner, split)
            for pivot in {open_pivot, None if last else int(cols[0][-1])} - {None}:
                partial |= owner == K.U(pivot)
            keep = partial | (n >= min_count)
            open_pivot = None if last else int(cols[0][-1])
            table = pa.table([pa.array(K.signed(v[keep])) for v in (a, b, c)] + [pa.array(n[keep])], ["w1", "w2", "w3", "n"])
            yield from table.to_batches(max_chunksize=1 << 16)

        for batch in batches:
            cols = [np.asarray(batch.column(c).to_numpy(zero_copy_only=False)) for c in FRAGMENT_NAMES if c != "part"]
            cols = [c.view(np.uint64) if i not in (1, 6) else c for i, c in enumerate(cols)]
            held.append(cols)
            size += len(batch)
            if size > sizes.gather // 2:  # five times as many n-grams may come of them
                whole = [np.concatenate(c) for c in zip(*held)]
                # The last pivot waits for its other rows, unless it fills what is gathered.
                cut = int(np.flatnonzero(whole[0] == whole[0][-1])[0])
                if cut == 0:
                    yield from out(whole, False)
                    held, size = [], 0
                else:
                    done = [c[:cut] for c in whole]
                    yield from out(done, True) if int(done[0][-1]) != open_pivot else out(done, False)
                    held, size = [[c[cut:] for c in whole]], len(whole[0]) - cut
        if held:
            yield from out([np.concatenate(c) for c in zip(*held)], True)

    return mine


def phrase_counts(docs: DataFrame, scratch: Scratch, min_count: int, text: str, lang: str, sizes: Sizes) -> tuple[DataFrame, DataFrame]:
    """Counts of all words (w, lang, word, n) and of the frequent n-grams of two and three (w1, w2, w3, n)."""
    spark = docs.sparkSession
    texts = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))
    counted = scratch.write(texts.mapInArrow(_count(sizes), "w long, lang string, word string, n long, block int, counts binary"), "counted")
    one = F.struct("lang", "word")
    words = counted.where("block is null").groupBy("w").agg(F.min(one).alias("first"), F.max(one).alias("last"), F.sum("n").alias("n"))
    words = scratch.write(words, "words")
    if not words.where("first <> last").isEmpty():
        raise ValueError("two words have one hash")
    words = words.select("w", "first.lang", "first.word", "n")

    # Both sketches have a fixed number of counters, whatever the corpus.
    slot = F.col("w").bitwiseAND(F.lit(sizes.words - 1)).cast("int")
    totals = words.groupBy(slot.alias("slot")).agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)
    grade = F.least(F.lit(255), 1 + F.floor(8 * F.log2(F.col("n") / min_count))).cast("short")
    got = totals.select("slot", grade.alias("grade")).toArrow()
    levels = np.zeros(sizes.words, np.uint8)
    levels[got["slot"].to_numpy()] = got["grade"].to_numpy().astype(np.uint8)
    blocks = counted.where("block is not null").select("block", "counts").repartition("block").sortWithinPartitions("block")
    pairs = np.zeros(sizes.pairs, np.uint8)
    for row in blocks.mapInArrow(_add_blocks, "block int, counts binary").toLocalIterator():
        pairs[row["block"] * BLOCK : (row["block"] + 1) * BLOCK] = np.frombuffer(row["counts"], np.uint8)
    sent = spark.sparkContext.broadcast(levels), spark.sparkContext.broadcast(pairs)

    pieces = texts.mapInArrow(_fragments(*sent, min_count, sizes), FRAGMENT)
    mined = pieces.repartition("pivot", "part").sortWithinPartitions("pivot").mapInArrow(_mine(min_count, sizes), "w1 long, w2 long, w3 long, n long")
    grams = scratch.write(mined.groupBy("w1", "w2", "w3").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count), "grams")
    for b in sent:
        b.unpersist()
    scratch.forget(counted)
    return words, grams


def collocations(
    docs: DataFrame,
    min_count: int = 10,
    top: int = 2000,
    covered: tuple[int, int] = (50, 100),
    text: str = "text",
    lang: str = "lang",
    sizes: Sizes = Sizes(),
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of two or three words of each language.

    a: occurrences of the phrase; l and r: of its two sides at the cut with the lowest score
    floor(1000000 a a / (l r)), ties to the earliest cut; n: words of the language.  A phrase
    inside a longer frequent one of at least covered[0] / covered[1] of its occurrences is left out.
    """
    if not 1 <= min_count <= 255:
        raise ValueError("min_count must be 1 to 255")
    spark = docs.sparkSession
    scratch = Scratch(spark, "phrases")
    words, grams = phrase_counts(docs, scratch, min_count, text, lang, sizes)
    share, of = covered
    per_lang = words.groupBy("lang").agg(F.sum("n").alias("n"))
    known = words.where(F.col("n") >= min_count)
    word = lambda i: known.select(F.col("w").alias(f"w{i}"), F.col("word").alias(f"t{i}"), F.col("n").alias(f"f{i}"))
    pairs = grams.where("w3 = 0").select("w1", "w2", F.col("n").alias("a"))
    triples = grams.where("w3 <> 0").select("w1", "w2", "w3", F.col("n").alias("a"))
    longest = triples.select(F.explode(F.array(F.struct("w1", "w2", "a"), F.struct(F.col("w2").alias("w1"), F.col("w3").alias("w2"), "a"))).alias("x"))
    longest = longest.groupBy("x.w1", "x.w2").agg(F.max("x.a").alias("inside"))
    open_pairs = pairs.join(longest, ["w1", "w2"], "left").where(F.coalesce(of * F.col("inside") < share * F.col("a"), F.lit(True)))
    two = open_pairs.join(word(1), "w1").join(known.select(F.col("w").alias("w2"), "lang", F.col("word").alias("t2"), F.col("n").alias("f2")), "w2")
    two = two.select("lang", F.concat_ws(" ", "t1", "t2").alias("phrase"), "a", F.array(F.struct(F.col("f1").alias("l"), F.col("f2").alias("r"))).alias("cuts"))
    front = pairs.select("w1", "w2", F.col("a").alias("f12"))
    back = pairs.select(F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("a").alias("f23"))
    three = triples.join(front, ["w1", "w2"]).join(back, ["w2", "w3"]).join(word(1), "w1").join(word(2), "w2").join(known.select(F.col("w").alias("w3"), "lang", F.col("word").alias("t3"), F.col("n").alias("f3")), "w3")
    cuts = F.array(F.struct(F.col("f1").alias("l"), F.col("f23").alias("r")), F.struct(F.col("f12").alias("l"), F.col("f3").alias("r")))
    three = three.select("lang", F.concat_ws(" ", "t1", "t2", "t3").alias("phrase"), "a", cuts.alias("cuts"))
    # Counts of up to 15 digits: the products stay within 38, and a quotient is at most 1000000.
    score = "cast((cast(a as decimal(15,0)) * cast(a as decimal(15,0)) * 1000000) div (cast(c.l as decimal(15,0)) * cast(c.r as decimal(15,0))) as long)"
    best = F.expr(f"array_min(transform(cuts, (c, k) -> named_struct('score', {score}, 'k', k, 'l', c.l, 'r', c.r)))")
    scored = two.unionByName(three).withColumn("best", best).select("lang", "phrase", "a", "best.l", "best.r", "best.score")
    # First the best of a few parts of each language, so that the last window holds PARTS x top rows at most.
    order = lambda *by: Window.partitionBy("lang", *by).orderBy(F.desc("score"), F.desc("a"), "phrase")
    scored = scored.withColumn("__p", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    scored = scored.withColumn("__n", F.row_number().over(order("__p"))).where(F.col("__n") <= top).drop("__p", "__n")
    ranked = scored.withColumn("rank", F.row_number().over(order())).where(F.col("rank") <= top)
    # One row a language that has words.
    return ranked.join(per_lang, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
