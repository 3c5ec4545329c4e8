"""Misspelt words of many requests put right in one plan: tokens with places, a lookup, titles that veto, and the text again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.session import small


def respelt(requests: DataFrame, misspellings: DataFrame, titles: DataFrame | None = None, exclusions: DataFrame | None = None, key: str = "id", query: str = "query") -> DataFrame:
    """key, query, respelt: every request with its known misspellings replaced.

    ``misspellings`` has word and spelling, ``exclusions`` word, ``titles`` title.  Signs around a word and its
    possessive stay; a word that is a title as it stands, or is excluded, is left alone.  White space is kept.
    """
    rows = requests.select(F.col(key), F.col(query)).withColumn("__r", F.monotonically_increasing_id())
    tokens = rows.select("__r", F.posexplode(F.regexp_extract_all(F.col(query), F.lit(r"\s+|\S+"), F.lit(0))).alias("pos", "token"))
    low = F.lower("token")
    lead, tail = F.regexp_extract(low, r"^[^\p{L}\p{N}_]*", 0), F.regexp_extract(low, r"[^\p{L}\p{N}_]*$", 0)
    core = F.substring(low, F.length(lead) + 1, F.length(low) - F.length(lead) - F.length(tail))
    words = tokens.where(F.trim("token") != "").withColumns({"low": low, "lead": lead, "tail": tail, "core": core})
    own = F.when(F.col("core").endswith("'s"), "'s").otherwise("")
    words = words.withColumns({"own": own, "core": F.when(own != "", F.substring("core", F.lit(1), F.length("core") - 2)).otherwise(F.col("core"))})
    known = misspellings.select(F.lower("word").alias("word"), "spelling").groupBy("word").agg(F.min("spelling").alias("spelling"))
    whole = words.join(small(known.select(F.col("word").alias("low"), F.col("spelling").alias("__w"))), "low", "left")
    found = whole.join(small(known.select(F.col("word").alias("core"), F.col("spelling").alias("__c"))), "core", "left")
    found = found.withColumn("new", F.coalesce("__w", F.concat("lead", "__c", "own", "tail"))).where("new is not null")
    if exclusions is not None:
        out = exclusions.select(F.lower("word").alias("x")).distinct()
        found = found.join(small(out), (F.col("core") == F.col("x")) | (F.col("low") == F.col("x")), "left_anti")
    if titles is not None:
        # The few words that would change meet the titles; neither side is gathered.
        found = found.join(titles.select(F.lower("title").alias("low")).distinct(), "low", "left_anti")
    put = tokens.join(found.select("__r", "pos", "new"), ["__r", "pos"], "left")
    text = put.groupBy("__r").agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("new", "token").alias("t")))).alias("p"))
    again = text.select("__r", F.array_join(F.transform("p", lambda p: p["t"]), "").alias("respelt"))
    return rows.join(again, "__r", "left").select(key, query, F.coalesce("respelt", query).alias("respelt"))
