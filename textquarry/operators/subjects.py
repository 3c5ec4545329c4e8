"""Sections that a request asks for beside its page: ``musicians from big rapids`` asks for music in *Big Rapids*."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words of requests with the section names they ask for, the most fitting first; words too weak to ask alone.
SUBJECTS = {
    "musician": ("Musicians", "Music", "Notable people"), "musicians": ("Musicians", "Music", "Notable people"), "music": ("Music", "Musicians", "Notable people"),
    "actor": ("Actors", "Film", "Notable people"), "actors": ("Actors", "Film", "Notable people"), "actress": ("Actors", "Film", "Notable people"),
    "athlete": ("Athletes", "Sports", "Notable people"), "athletes": ("Athletes", "Sports", "Notable people"), "sports": ("Sports", "Athletes", "Notable people"),
    "scientist": ("Scientists", "Science", "Notable people"), "scientists": ("Scientists", "Science", "Notable people"),
    "writer": ("Writers", "Literature", "Notable people"), "writers": ("Writers", "Literature", "Notable people"),
    "author": ("Authors", "Writers", "Literature", "Notable people"), "authors": ("Authors", "Writers", "Literature", "Notable people"),
    "politician": ("Politicians", "Politics", "Government", "Notable people"), "politicians": ("Politicians", "Politics", "Government", "Notable people"),
    "people": ("Notable people",), "person": ("Notable people",), "persons": ("Notable people",), "notable": ("Notable people",), "famous": ("Notable people",),
}
WEAK = ("famous", "notable")


def _tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))


def subject_of(topic: Column, title: Column) -> Column:
    """The first word of a topic that is not in the page's title and asks for a section; null if none does."""
    strong = [s for s in SUBJECTS if s not in WEAK]
    left = F.filter(_tokens(topic), lambda t: t.isin(strong) & ~F.array_contains(_tokens(title), t))
    return F.when(F.size(_tokens(title)) > 0, F.get(left, F.lit(0)))


def subject_sections(requests: DataFrame, sections: DataFrame, key: str) -> DataFrame:
    """The columns of ``requests``, subject, pos, section: the section of level 2 that each request's subject names, if any.

    ``requests`` has ``key`` of a page, topic and title; ``sections`` has key, pos, level and title.  A name counts as
    whole words of a heading; the most fitting name wins, then the first heading.
    """
    spark = requests.sparkSession
    names = [(s, i, n.lower()) for s, wanted in SUBJECTS.items() if s not in WEAK for i, n in enumerate(wanted)]
    vocabulary = spark.createDataFrame(names, "subject string, priority int, name string")  # a fixed list
    asked = requests.withColumn("subject", subject_of(F.col("topic"), F.col("title"))).where("subject is not null")
    heads = sections.where("level = 2").select(key, "pos", F.trim("title").alias("section")).where("section <> '' and section <> 'Content'")
    word = F.concat(F.lit(r"(?<![\p{L}\p{N}_])"), "name", F.lit(r"(?![\p{L}\p{N}_])"))
    named = heads.join(F.broadcast(vocabulary), F.regexp(F.lower("section"), word))
    best = named.groupBy(key, "subject").agg(F.min(F.struct("priority", "pos", "section")).alias("b"))
    return asked.join(best, [key, "subject"]).select(*requests.columns, "subject", "b.pos", "b.section")
