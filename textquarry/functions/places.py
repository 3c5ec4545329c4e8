"""Places in rewritten texts: forms of a text that know where each of their characters stood in it.

A form is made by dropping or replacing what a pattern matches; forms of forms compose,
so a hit in the last one is a span of the original.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import IntegerType, StructField, StructType

BOLD = re.compile(r"\*\*")
SPACES = re.compile(r"\s+")
#: Characters of a passage that are looked for when white space differs, and how many there must be.
PROBE, LEAST = 80, 12


class Form:
    """A text and, for each of its characters, the place in the original."""

    def __init__(self, text: str, at: np.ndarray | None = None):
        self.text = text
        self.at = np.arange(len(text)) if at is None else at

    def rewritten(self, pattern: re.Pattern, put: str = "") -> Form:
        """Every match replaced by ``put``, whose characters stand where the match began."""
        parts, at, last = [], [], 0
        for m in pattern.finditer(self.text):
            parts += [self.text[last : m.start()], put]
            at += [self.at[last : m.start()], np.repeat(self.at[m.start()], len(put))]
            last = m.end()
        return Form("".join(parts) + self.text[last:], np.concatenate([*at, self.at[last:]]))

    def stripped(self) -> Form:
        a = len(self.text) - len(self.text.lstrip())
        b = max(a, len(self.text.rstrip()))
        return Form(self.text[a:b], self.at[a:b])

    def find(self, wanted: str) -> tuple[int, int] | None:
        """The span of the original that the first occurrence covers."""
        i = self.text.find(wanted) if wanted else -1
        return None if i < 0 else (int(self.at[i]), int(self.at[i + len(wanted) - 1]) + 1)


def span_of(passage: str, markdown: str) -> tuple[int, int] | None:
    """Where a passage stands in a page: both without bold marks, else by its first words with single spaces."""
    page = Form(markdown).rewritten(BOLD)
    own = BOLD.sub("", passage)
    hit = page.find(own)
    if hit is None:
        head = Form(own).rewritten(SPACES, " ").stripped().text[:PROBE]
        # Forms map a run of spaces to its first; a probe begins with a character that is none.
        hit = page.rewritten(SPACES, " ").stripped().find(head) if len(head) >= LEAST else None
    return hit


@arrow_udf(StructType([StructField("start", IntegerType()), StructField("end", IntegerType())]))
def _spans(passage: pa.Array, markdown: pa.Array) -> pa.Array:
    found = [None if p is None or m is None else span_of(p, m) for p, m in zip(passage.to_pylist(), markdown.to_pylist())]
    ends = [pa.array([None if f is None else f[i] for f in found], pa.int32()) for i in (0, 1)]
    return pa.StructArray.from_arrays(ends, ["start", "end"])


def span(passage: Column, markdown: Column) -> Column:
    """start, end of a passage in the markdown of its page (characters, from 0); both null if it is nowhere."""
    return _spans(passage, markdown)


def located(passage: Column, markdown: Column) -> Column:
    """Where a passage begins in the markdown of its page; -1 if nowhere."""
    return F.coalesce(span(passage, markdown).getField("start"), F.lit(-1))
