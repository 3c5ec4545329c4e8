"""The corpus pipeline: quality, near duplicates, benchmark leaks, source mixing, shards.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes the
result of each as Parquet and rereads it as the documents of the next.  All but the
last return the columns of ``documents``.

No SQL expresses the learnt and hashed stages, so ``ORACLE_SQL`` is None; the tests
hold the stages against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textquarry.catalog import table
from textquarry.llm.decontaminate import drop_leaks
from textquarry.llm.mixing import mix_sources
from textquarry.llm.near_dup import keep_first
from textquarry.llm.quality import keep_good
from textquarry.llm.sharding import histogram_shards
from textquarry.session import Scratch

ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.3 or more; the classifier learns from ``labels``."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingles are similar at 0.8 or more."""
    return keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no item of ``benchmark``."""
    return drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once, those of small sources up to twice."""
    return mix_sources(docs, max_repeat=2.0).select(*docs.columns)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with size, shard (0 to 7) and slot."""
    return histogram_shards(docs, 8)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sharded stream of ``documents`` after all stages."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        done = scratch.write(stage(spark, docs, sf_dir), name)
        scratch.forget(docs)
        docs = done
    return STAGES[-1][1](spark, docs, sf_dir)
