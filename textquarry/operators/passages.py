"""Passages of documents: sections, paging, snippets, affinity, budget, citations."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textquarry.functions import snippets as SN
from textquarry.functions import text as T


def sections(docs: DataFrame, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """id, pos, line, char_start, char_end of every line of each row.

    Lines are numbered in their row; their offsets are running sums over the row's
    lines, which are exchanged by a number of the row, not by its id.
    """
    rows = docs.select(row_id, F.col(text).alias("__t")).withColumn("__r", F.monotonically_increasing_id())
    lines = rows.select(row_id, "__r", F.posexplode(F.split("__t", "\n")).alias("pos", "line"))
    upto = F.sum(F.length("line") + 1).over(Window.partitionBy("__r").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
    lines = lines.withColumn("char_start", F.coalesce(upto, F.lit(0)).cast("int"))
    return lines.select(row_id, "pos", "line", "char_start", (F.col("char_start") + F.length("line")).alias("char_end"))


def heading_sections(headings: DataFrame, page: str = "page_id", levels: int = 6) -> DataFrame:
    """page, pos, level, text, id, char_start, char_end, parent_pos: a section ends at the next heading of its level or above.

    ``headings`` has pos, level (1 to ``levels``), text, start and length (of the page).
    Running values for each level answer what comes next and what stands above, so
    the work grows with the number of headings; a repeated id gets ``_2``, ``_3`` and so on.
    """
    after = Window.partitionBy(page).orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, -1)
    above = Window.partitionBy(page).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    level = F.col("level")
    ends = F.coalesce(*[F.when(level == k, F.last(F.when(level <= k, F.col("start")), True).over(after)) for k in range(1, levels + 1)], F.col("length"))
    # The nearest heading of a lower level, over all such levels.
    parents = F.coalesce(*[F.when(level == k, F.last(F.when(level < k, F.col("pos")), True).over(above)) for k in range(2, levels + 1)])
    slug = SN.slug(F.col("text"))
    rows = headings.withColumns({"char_end": ends, "parent_pos": parents, "__s": slug})
    same = F.row_number().over(Window.partitionBy(page, "__s").orderBy("pos"))
    rows = rows.withColumn("id", F.concat("__s", F.when(same > 1, F.concat(F.lit("_"), same.cast("string"))).otherwise(F.lit(""))))
    return rows.select(page, "pos", "level", "text", "id", F.col("start").alias("char_start"), "char_end", "parent_pos")


def trimmed_pages(docs: DataFrame, size: int, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """id, page_no, char_offset, n_chars: pages of at most ``size`` characters; white space at a page's end is left to the next.

    A page begins where the one before ended, so offsets are followed within the row, in one pass over its pages.
    """

    def cut(batches):
        for batch in batches:
            ids, no, at, n = [], [], [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                place = page = 0
                while t and place < len(t):
                    rest = len(t) - place
                    kept = rest if rest <= size else len(t[place : place + size].rstrip()) or size
                    ids.append(i)
                    no.append(page)
                    at.append(place)
                    n.append(kept)
                    place, page = place + kept, page + 1
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int64())), pa.array(no, pa.int32()), pa.array(at, pa.int32()), pa.array(n, pa.int32())], [row_id, "page_no", "char_offset", "n_chars"])

    kind = docs.schema[row_id].dataType.simpleString()
    return docs.select(row_id, F.col(text).cast("string")).mapInArrow(cut, f"`{row_id}` {kind}, page_no int, char_offset int, n_chars int")


def content_pages(docs: DataFrame, size: int, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """id, page_no, char_offset, n_chars: consecutive pages of ``size`` characters."""
    n = F.length(text)
    rows = docs.where(n > 0).select(row_id, n.alias("__n"), F.explode(F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int"))).alias("page_no"))
    return rows.select(row_id, "page_no", (F.col("page_no") * size).alias("char_offset"), F.least(F.lit(size), F.col("__n") - F.col("page_no") * size).alias("n_chars"))


def places(docs: DataFrame, mark: str, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """id, at: every place (from 1) at which a mark stands in a text, from left to right without overlap."""
    rows = docs.select(row_id, F.col(text).alias("__t")).withColumn("__r", F.monotonically_increasing_id())
    parts = rows.select(row_id, "__r", F.posexplode(F.split("__t", re.escape(mark))).alias("i", "part"))
    upto = F.sum(F.length("part") + len(mark)).over(Window.partitionBy("__r").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    last = F.lead("i").over(Window.partitionBy("__r").orderBy("i")).isNull()
    return parts.select(row_id, (upto - len(mark) + 1).cast("int").alias("at"), last.alias("__l")).where(~F.col("__l")).drop("__l")


def snippet(text: Column, *terms: str) -> Column:
    """The first line that holds one of the words, else the first line."""
    lines = F.split(text, "\n")
    hit = F.filter(lines, lambda x: F.arrays_overlap(T.words(x), F.array(*[F.lit(t) for t in terms])))
    return F.coalesce(F.get(hit, F.lit(0)), F.get(lines, F.lit(0)))


def attributed(passages: DataFrame, sections_: DataFrame, key: str, width: int = 1024) -> DataFrame:
    """Each passage (key, at) with the smallest section [char_start, char_end) around it, else the first section.

    Passages meet the sections of their stretch of ``width`` characters only, not all of
    their page, so a long page costs no more than its length.
    """
    stretch = lambda c: F.floor(c / width)
    last = stretch(F.greatest(F.col("char_end") - 1, F.col("char_start")))
    parts = sections_.withColumn("__w", F.explode(F.sequence(stretch(F.col("char_start")), last)))
    both = passages.withColumn("__w", stretch(F.col("at"))).join(parts, [key, "__w"], "left")
    inside = (F.col("at") >= F.col("char_start")) & (F.col("at") < F.col("char_end"))
    section = F.struct(F.col("pos").alias("pos"), F.col("char_start").alias("s"), F.col("char_end").alias("e"))
    best = F.min(F.when(inside, F.struct((F.col("char_end") - F.col("char_start")).alias("span"), section.alias("x")))).getField("x")
    first = sections_.groupBy(key).agg(F.min(section).alias("__f"))
    rows = both.groupBy(*passages.columns).agg(best.alias("__b")).join(first, key, "left").withColumn("b", F.coalesce("__b", "__f"))
    return rows.select(*passages.columns, F.col("b.pos").alias("section_pos"), F.col("b.s").alias("section_start"), F.col("b.e").alias("section_end"))


def affinity(ranked: DataFrame, query: str, heading: str, threshold: float = 0.25, boost: float = 1.5, by: str = "doc_id") -> DataFrame:
    """Ranked passages with ``boosted`` and ``new_rn``: headings that share tokens with the query gain.

    The score is first held to the smallest seen so far in the ranking.
    """
    h = T.relevance_tokens(F.col(heading), 1)
    share = F.when(F.size(h) > 0, F.size(F.array_intersect(h, T.relevance_tokens(F.lit(query), 1))) / F.size(h)).otherwise(0.0)
    # Rankings are one page long, so this window has a few rows.
    floor = F.min("score").over(Window.orderBy("rn").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = ranked.withColumn("affine", share >= threshold).withColumn("__f", floor)
    out = out.withColumn("boosted", F.round(F.when(F.col("affine"), F.when(F.col("__f") >= 0, F.col("__f") * boost).otherwise(F.col("__f") / boost)).otherwise(F.col("__f")), 6)).drop("__f")
    return out.withColumn("new_rn", F.row_number().over(Window.orderBy(F.desc("boosted"), "rn")))


def within_budget(ranked: DataFrame, budget: int, length: str = "n_chars", order: str = "rn", group: list[str] | None = None) -> DataFrame:
    """Ranked rows with ``kept``: characters left to each under a running budget; rows without any go."""
    w = Window.partitionBy(*(group or [])).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    left = F.lit(budget) - (F.sum(length).over(w) - F.col(length))
    return ranked.withColumn("kept", F.least(F.col(length), left)).where("kept > 0")


def cut_at_word(text: Column, length: Column) -> Column:
    """The text cut to ``length`` at a word's end, if that end is beyond half of it."""
    cut = F.substring(text, F.lit(1), length)
    at = length - F.instr(F.reverse(cut), " ")
    return F.when(F.length(text) <= length, text).when((F.instr(cut, " ") > 0) & (at > length / 2), F.rtrim(F.substring(text, F.lit(1), at))).otherwise(cut)


def answer(passages: DataFrame, text: str = "passage", cite: str = "cite_id", order: str = "rn") -> DataFrame:
    """One row: the passages with their citations, in order."""
    item = F.struct(F.col(order).alias("o"), F.concat(F.col(text), F.lit("\n[cite: "), F.col(cite), F.lit("]")).alias("t"))
    return passages.agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["t"]), "\n\n").alias("answer"), F.count("*").alias("n_passages"))


def citations(passages: DataFrame, cite: str = "cite_id", order: str = "rn") -> DataFrame:
    """Each cited id once, at its best rank."""
    return passages.groupBy(cite).agg(F.min(order).alias("rn"))


def demoted(rows: DataFrame, is_list: Column, order: str) -> DataFrame:
    """``new_rn``: the rank after list articles go behind all others, orders kept; ``rows`` is a page of hits."""
    return rows.withColumn("is_list", is_list).withColumn("new_rn", F.row_number().over(Window.orderBy(F.col("is_list").cast("int"), order)))
