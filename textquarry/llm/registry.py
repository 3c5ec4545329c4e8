"""The registered queries of the training-data operators, thin over the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.catalog import table

ORACLE: dict[str, str] = {}


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes on three-word shingles at 0.85; see ``near_dup``."""
    from textquarry.llm.near_dup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), k=3, num=85, den=100)


def op2_factorisation_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of every text; see ``quality``."""
    from textquarry.llm.quality import quality_scores

    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_flac_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as a FLAC stream and back; see ``media``."""
    from textquarry.llm.media import media_digests

    return media_digests(table(spark, sf_dir, "documents"))


def op4_simhash_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every leaked benchmark item of every document; see ``decontaminate``."""
    from textquarry.llm.decontaminate import find_leaks

    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_ordinal_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected toxicity severity of every text; see ``toxicity``."""
    from textquarry.llm.toxicity import toxic_severity

    return toxic_severity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_semi_markov_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every text; see ``pii``."""
    from textquarry.llm.pii import fit, personal_data, span_digests

    docs = table(spark, sf_dir, "documents")
    return span_digests(personal_data(docs, fit(docs)))


def op7_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight shards of nearly equal bytes; see ``sharding``."""
    from textquarry.llm.sharding import histogram_shards

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"))
    return histogram_shards(docs, 8).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_forest_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate secrets of every text, hashed; see ``secrets``."""
    from textquarry.llm.secrets import find_secrets

    found = find_secrets(table(spark, sf_dir, "documents"), path="source")
    return found.select("doc_id", "start", F.length("value").cast("long").alias("length"), "n", F.sha2("value", 256).alias("value_sha256"), "before", "score", "secret")


def op10_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream of documents mixed by source, none read more than twice; see ``mixing``."""
    from textquarry.llm.mixing import OUTPUT, mix_sources

    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix_sources(docs, max_repeat=2.0).select("doc_id", "source", *OUTPUT)


def op8_suffix_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without later copies of long repeated runs of lines; see ``line_dedup``."""
    from textquarry.llm.line_dedup import dedup_lines

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_deleted", "deleted", F.octet_length("clean_text").cast("long").alias("clean_bytes"), F.sha2("clean_text", 256).alias("clean_sha256"))


def op11_pivot_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collocations of two and three words of every language; see ``phrases``."""
    from textquarry.llm.phrases import collocations

    return collocations(table(spark, sf_dir, "documents"))


def op12_vantage_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three hard negatives for each of an anchor's five positives; see ``hard_negatives``."""
    from textquarry.llm.hard_negatives import hard_negatives

    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256).cast("double"))
    finite = F.forall("embedding", lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False)))
    rows = table(spark, sf_dir, "embeddings").where(finite).select("vec_id", moved.alias("label"), whole.alias("embedding"))
    return hard_negatives(rows, F.col("vec_id") % 50 == 0)


def op13_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every query; see ``hash_forest``."""
    from textquarry.llm.hash_forest import nearest

    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def shards_law(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row about op7's result: rows, bytes, shards, whether slots are gapless and shards within a hundredth of equal bytes (or the largest row)."""
    s = op7_histogram_sort(spark, sf_dir)
    per = s.groupBy("shard").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.max("slot").alias("top"), F.count_distinct("slot").alias("slots"), F.max("size").alias("most"))
    gapless = F.min((F.col("top") == F.col("n") - 1) & (F.col("slots") == F.col("n")))
    near = (F.max("bytes") - F.min("bytes")) <= F.greatest(F.sum("bytes") / 8 / 100, F.max("most") * 2)
    return per.agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.count("*").alias("shards"), gapless.alias("gapless"), near.alias("near_equal"))


def mix_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, rows, tokens, whole: what op10 reads of each source in its first pass, and whether no row is read more than twice."""
    m = op10_temperature_mixing(spark, sf_dir)
    most = m.groupBy("source", "doc_id").agg(F.count("*").alias("k")).groupBy("source").agg((F.max("k") <= 2).alias("at_most_twice"))
    first = m.where("epoch = 0").groupBy("source").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"))
    return first.join(most, "source")


def flac_pcm_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_blocks, n_samples, last_sample, gapless: the PCM blocks of every stored text and where they begin."""
    from textquarry.llm.media import pcm_blocks, to_flac

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    blocks = pcm_blocks(to_flac(docs)).groupBy("doc_id").agg(F.count("*").alias("n_blocks"), F.sum("n_samples").alias("n_samples"), F.max("sample_offset").alias("last_sample"), F.count_distinct("block").alias("k"), F.sum(F.octet_length("pcm")).alias("b"))
    return blocks.select("doc_id", "n_blocks", "n_samples", "last_sample", ((F.col("k") == F.col("n_blocks")) & (F.col("b") == F.col("n_samples"))).alias("gapless"))


def media_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, payload_bytes of op3."""
    return op3_flac_media(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes")


def pii_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and the counts of base spans of op6."""
    return op6_semi_markov_pii(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


ORACLE["flac_pcm_blocks"] = "SELECT doc_id, CAST(n AS BIGINT) AS n_blocks, CAST(n * 576 AS BIGINT) AS n_samples, CAST((n - 1) * 576 AS BIGINT) AS last_sample, true AS gapless FROM (SELECT doc_id, greatest(1, (coalesce(strlen(text), 0) + 575) // 576) AS n FROM documents)"
ORACLE["media_sizes"] = "SELECT doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS n_bytes, CAST(greatest(1, (coalesce(strlen(text), 0) + 575) // 576) * 576 AS BIGINT) AS payload_bytes FROM documents"
ORACLE["pii_counts"] = r"""
WITH m AS (SELECT doc_id, regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+') AS e, regexp_extract_all(t, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)') AS i,
  regexp_extract_all(t, '[0-9]([\x20-]?[0-9])+') AS c, regexp_extract_all(t, '\+[0-9][\x20().0-9-]+[0-9]') AS p FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)),
d AS (SELECT doc_id, e, i, list_transform(c, lambda x: reverse(regexp_replace(x, '[^0-9]', '', 'g'))) AS c, list_transform(p, lambda x: regexp_replace(x, '[^0-9]', '', 'g')) AS p FROM m)
SELECT doc_id, CAST(len(e) AS BIGINT) AS n_email,
  CAST(len(list_filter(i, lambda x: len(list_filter(string_split(x, '.'), lambda y: length(ltrim(y, '0')) > 3 OR TRY_CAST(y AS INTEGER) > 255)) = 0)) AS BIGINT) AS n_ip,
  CAST(len(list_filter(c, lambda x: length(x) BETWEEN 14 AND 19 AND list_sum(list_transform(range(1, length(x) + 1), lambda k: CASE WHEN k % 2 = 1 THEN CAST(substr(x, k, 1) AS INTEGER) WHEN CAST(substr(x, k, 1) AS INTEGER) > 4 THEN 2 * CAST(substr(x, k, 1) AS INTEGER) - 9 ELSE 2 * CAST(substr(x, k, 1) AS INTEGER) END)) % 10 = 0)) AS BIGINT) AS n_card,
  CAST(len(list_filter(p, lambda x: length(x) BETWEEN 10 AND 15)) AS BIGINT) AS n_phone FROM d
"""
ORACLE["shards_law"] = "SELECT count(*) AS n, CAST(sum(coalesce(strlen(text), 0) + 1) AS BIGINT) AS bytes, 8 AS shards, true AS gapless, true AS near_equal FROM documents"
ORACLE["mix_totals"] = "SELECT source, count(*) AS n, CAST(sum(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'))) AS BIGINT) AS tokens, true AS at_most_twice FROM documents GROUP BY source"

ORACLE["op11_pivot_phrases"] = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces),
starts AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM words WHERE len(ws) > 0),
grams AS (SELECT lang, k, array_to_string(ws[i : i + k - 1], ' ') AS phrase FROM starts, (SELECT unnest([1, 2, 3]) AS k) WHERE i + k - 1 <= len(ws)),
f AS (SELECT lang, k, phrase, count(*) AS a FROM grams GROUP BY ALL),
totals AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
found AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND a >= 10),
cuts AS (SELECT lang, k, phrase, a, c, array_to_string(ws[:c], ' ') AS p, array_to_string(ws[c + 1 :], ' ') AS q FROM found, (SELECT unnest([1, 2]) AS c) WHERE c < k),
scored AS (
  SELECT cuts.lang, cuts.k, cuts.phrase, cuts.a, c, fl.a AS l, fr.a AS r,
    CAST((CAST(cuts.a AS HUGEINT) * cuts.a * 1000000) // (CAST(fl.a AS HUGEINT) * fr.a) AS BIGINT) AS score
  FROM cuts JOIN f fl ON fl.lang = cuts.lang AND fl.k = c AND fl.phrase = p JOIN f fr ON fr.lang = cuts.lang AND fr.k = cuts.k - c AND fr.phrase = q),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
inside AS (SELECT lang, phrase, max(a) AS inside FROM (
  SELECT lang, unnest([array_to_string(ws[:2], ' '), array_to_string(ws[2:], ' ')]) AS phrase, a FROM found WHERE k = 3) GROUP BY ALL),
kept AS (SELECT best.* FROM best LEFT JOIN inside ON best.k = 2 AND inside.lang = best.lang AND inside.phrase = best.phrase WHERE inside IS NULL OR 100 * inside < 50 * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT ranked.lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
ORACLE["op12_vantage_negatives"] = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 256)) AS v FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) AS INTEGER) AS rank, other AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) <= 3
"""

QUERIES = {
    "shards_law": shards_law,
    "flac_pcm_blocks": flac_pcm_blocks,
    "media_sizes": media_sizes,
    "pii_counts": pii_counts,
    "mix_totals": mix_totals,
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_factorisation_quality": op2_factorisation_quality,
    "op3_flac_media": op3_flac_media,
    "op4_simhash_decontamination": op4_simhash_decontamination,
    "op5_ordinal_toxicity": op5_ordinal_toxicity,
    "op6_semi_markov_pii": op6_semi_markov_pii,
    "op7_histogram_sort": op7_histogram_sort,
    "op8_suffix_line_dedup": op8_suffix_line_dedup,
    "op9_forest_secret_scan": op9_forest_secret_scan,
    "op10_temperature_mixing": op10_temperature_mixing,
    "op11_pivot_phrases": op11_pivot_phrases,
    "op12_vantage_negatives": op12_vantage_negatives,
    "op13_prefix_forest": op13_prefix_forest,
}
