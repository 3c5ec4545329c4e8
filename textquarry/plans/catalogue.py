"""The registered queries over the given tables, each beside the SQL of its result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textquarry.catalog import table
from textquarry.functions import text as T
from textquarry.functions import urls as U
from textquarry.operators import archives as A
from textquarry.operators import index as IX
from textquarry.operators import passages as P
from textquarry.operators import search as S
from textquarry.operators import titles as TI
from textquarry.session import Scratch

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
QUERY = "that with tion für pour"
TERMS = S.parsed_query(QUERY)


def query(sql: str | None = None):
    """Registers a function (spark, folder) under its name, with its SQL."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return register


def docs_of(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents")


_INDEXES: dict[tuple[str, str], Scratch] = {}


def stored_index(spark, sf) -> str:
    """The folder of the documents' index, built at the first call of a session and kept for later ones."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _INDEXES or not IX.exists(spark, _INDEXES[key].root):
        _INDEXES[key] = Scratch(spark, "index")
        IX.build(docs_of(spark, sf), _INDEXES[key].root)
    return _INDEXES[key].root


def indexed(spark, sf, query=QUERY):
    """doc_id and score of the documents that hold a word of the query, from the stored index."""
    return IX.search(spark, stored_index(spark, sf), query).withColumnRenamed("id", "doc_id")


def hits_of(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    """doc_id, ``columns`` and score of the documents that hold a word of the query, ranked by the stored index."""
    return docs_of(spark, sf).select("doc_id", *columns).join(indexed(spark, sf), "doc_id")


def bm25_sql(where: str = "true", terms=TERMS) -> str:
    """A WITH list that ends in ``hits`` (columns of documents, score)."""
    n = [f"len(list_filter(t, lambda x: x = '{w}')) AS n{i}" for i, w in enumerate(terms)]
    df = [f"count(*) FILTER (WHERE n{i} > 0) AS df{i}" for i in range(len(terms))]
    part = [f"ln(1.0 + (st.n - st.df{i} + 0.5) / (st.df{i} + 0.5)) * (n{i} * 2.2) / (n{i} + 1.2 * (0.25 + 0.75 * dl / st.avgdl))" for i in range(len(terms))]
    any_ = " OR ".join(f"n{i} > 0" for i in range(len(terms)))
    return f"""WITH tok AS (SELECT *, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+') AS t FROM documents),
c AS (SELECT * EXCLUDE (t), len(t) AS dl, {", ".join(n)} FROM tok),
st AS (SELECT count(*) AS n, avg(dl) AS avgdl, {", ".join(df)} FROM c),
hits AS (SELECT doc_id, text, lang, source, n_chars, round({" + ".join(part)}, 6) AS score FROM c, st WHERE ({any_}) AND ({where}))"""


TOP = "row_number() OVER (ORDER BY score DESC, doc_id)"


@query(bm25_sql() + f" SELECT doc_id, score, {TOP} AS rn FROM hits ORDER BY rn LIMIT 10")
def fulltext_search(spark, sf):
    return S.page(S.bm25(docs_of(spark, sf).select("doc_id", "text"), QUERY).select("doc_id", "score"))


@query(bm25_sql() + f" SELECT * FROM (SELECT doc_id, score, {TOP} AS rn FROM hits) WHERE rn BETWEEN 11 AND 20")
def fulltext_search_page2(spark, sf):
    return S.page(indexed(spark, sf), 10, 10)


@query(bm25_sql("lang = 'de'") + f" SELECT doc_id, score, {TOP} AS rn FROM hits ORDER BY rn LIMIT 10")
def filtered_search_lang(spark, sf):
    return S.page(hits_of(spark, sf, "lang").where("lang = 'de'").select("doc_id", "score"))


@query(bm25_sql("starts_with(source, 'src1')") + f" SELECT doc_id, source, score, {TOP} AS rn FROM hits ORDER BY rn LIMIT 10")
def filtered_search_mime_prefix(spark, sf):
    return S.page(hits_of(spark, sf, "source").where(F.col("source").startswith("src1")))


PER_SOURCE = "row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id)"


@query(bm25_sql() + f" SELECT * FROM (SELECT source, doc_id, score, {PER_SOURCE} AS rn FROM hits) WHERE rn <= 5")
def search_all_sources(spark, sf):
    return S.top_per_group(hits_of(spark, sf, "source"), "source", 5)


@query(bm25_sql() + " SELECT count(DISTINCT source) AS sources_with_hits, count(*) AS hits, count(*) FILTER (WHERE score >= 1) AS strong_hits FROM hits")
def search_totals(spark, sf):
    h = hits_of(spark, sf, "source")
    return h.agg(F.count_distinct("source").alias("sources_with_hits"), F.count("*").alias("hits"), F.count_if(F.col("score") >= 1).alias("strong_hits"))


@query(bm25_sql() + f""", a AS (SELECT doc_id, {TOP} AS rn FROM hits),
b AS (SELECT doc_id, row_number() OVER (ORDER BY length(text), doc_id) AS rn FROM hits)
SELECT doc_id, round(sum(1.0 / (60 + rn)), 9) AS rrf_score, count(*) AS n_lists FROM (SELECT * FROM a WHERE rn <= 50 UNION ALL SELECT * FROM b WHERE rn <= 50) GROUP BY doc_id""")
def rrf_fusion(spark, sf):
    hits = hits_of(spark, sf, "text")
    by_score = S.page(indexed(spark, sf), 50)
    by_length = S.page(hits.select("doc_id", (-F.length("text")).alias("score")), 50)
    return S.rrf(by_score.select("doc_id", "rn").unionByName(by_length.select("doc_id", "rn")))


@query(bm25_sql() + f""", top AS (SELECT * FROM (SELECT source, doc_id, score, split_part(text, chr(10), 1) AS path, {PER_SOURCE} AS rn FROM hits) WHERE rn <= 10),
o AS (SELECT *, len(list_intersect(list_distinct(list_filter(regexp_extract_all(lower(path), '[a-z0-9]+'), lambda x: length(x) >= 3)), ['that', 'with', 'tion', 'pour'])) AS overlap FROM top),
p AS (SELECT source AS ps, overlap AS pmax FROM (SELECT source, overlap, score, doc_id FROM o) ORDER BY overlap DESC, score DESC, doc_id LIMIT 1),
k AS (SELECT o.*, source = ps AS is_primary, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) AS kn FROM o, p WHERE source = ps OR overlap >= 1 OR pmax = 0)
SELECT source, doc_id, score, overlap, is_primary FROM k WHERE is_primary OR kn <= 2""")
def cross_archive_floor(spark, sf):
    hits = hits_of(spark, sf, "text", "source")
    top = S.top_per_group(hits.select("source", "doc_id", "score", F.split_part("text", F.lit("\n"), F.lit(1)).alias("path")), "source", 10).drop("rn")
    return S.leakage_floor(top, QUERY, "path").select("source", "doc_id", "score", "overlap", "is_primary")


LONG_WORDS = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}]{8,}')"


@query(f"""WITH q AS (SELECT DISTINCT item_id, unnest({LONG_WORDS}) AS term FROM benchmark), tok AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+') AS t FROM documents), c AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM tok),
p AS (SELECT term, doc_id, dl, count(*) AS tf FROM (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM tok) WHERE term IN (SELECT term FROM q) GROUP BY ALL), d AS (SELECT term, count(*) AS df FROM p GROUP BY term),
s AS (SELECT item_id, doc_id, round(sum(ln(1.0 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM q JOIN p USING (term) JOIN d USING (term), c GROUP BY item_id, doc_id)
SELECT item_id, doc_id, score, rn FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rn FROM s) WHERE rn <= 10""")
def search_many(spark, sf):
    """The ten best documents for each item of the benchmark, asked by its long words, in one plan."""
    q = table(spark, sf, "benchmark").select("item_id", F.array_join(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]{8,}"), F.lit(0)), " ").alias("query"))
    found = IX.search_many(spark, stored_index(spark, sf), q, "item_id", "query", 10)
    return found.select("item_id", F.col("id").alias("doc_id"), "score", "rn")


CANON = "split_part(split_part(regexp_replace(url, '^[a-z]+://', ''), '?', 1), '#', 1)"


@query(f"SELECT page_id, canon FROM (SELECT page_id, {CANON} AS canon, row_number() OVER (PARTITION BY {CANON} ORDER BY page_id) AS rn FROM pages) WHERE rn = 1")
def canonical_dedup(spark, sf):
    p = table(spark, sf, "pages").select("page_id", U.canonical(U.url_path(F.col("url"))).alias("canon"))
    return S.canonical_first(p, "canon", "page_id")


HOST = "regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)"


@query(f"""WITH p AS (SELECT page_id, {HOST} AS archive, {CANON} AS canon FROM pages)
SELECT page_id, canon, list_contains(coalesce(list(canon) OVER (PARTITION BY archive ORDER BY page_id ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING), []), canon) AS suppressed FROM p""")
def canonical_lookbehind(spark, sf):
    p = table(spark, sf, "pages").select("page_id", U.host(F.col("url")).alias("archive"), U.canonical(U.url_path(F.col("url"))).alias("canon"))
    return S.lookbehind(p, "archive", "canon", "page_id").select("page_id", "canon", "suppressed")


TOPICS = ("Small Ring", "red widget", "blue_bolt", "hot  gear", "BLUE BOLT", "nothing at all")


def part_titles(spark, sf):
    """One title for each distinct part name, named by its smallest key."""
    return table(spark, sf, "part").groupBy(F.col("p_name").alias("title")).agg(F.min("p_partkey").alias("id")).withColumn("path", F.replace("title", F.lit(" "), F.lit("_")))


def topics(spark, values=TOPICS):
    return spark.range(1).select(F.explode(F.array(*[F.lit(v) for v in values])).alias("topic"))


TITLES_SQL = "WITH t AS (SELECT p_name AS title, min(p_partkey) AS id, replace(p_name, ' ', '_') AS path FROM part GROUP BY p_name), q AS (SELECT unnest([" + ", ".join(f"'{t}'" for t in TOPICS) + "]) AS topic)"


@query(TITLES_SQL + " SELECT topic, id, title FROM t JOIN q ON title = topic")
def title_lookup_exact(spark, sf):
    return part_titles(spark, sf).join(F.broadcast(topics(spark)), F.col("title") == F.col("topic")).select("topic", "id", "title")


@query(TITLES_SQL + """, m AS (SELECT topic, id AS key, CASE WHEN title = topic THEN 1
 WHEN path IN (replace(topic, ' ', '_'), replace(upper(topic[1]) || substr(topic, 2), ' ', '_'), replace(lower(topic), ' ', '_'), replace(upper(topic), ' ', '_'), replace(list_aggregate(list_transform(string_split(lower(topic), ' '), lambda x: upper(x[1]) || substr(x, 2)), 'string_agg', ' '), ' ', '_')) THEN 2
 WHEN lower(title) = lower(topic) OR lower(trim(split_part(title, ' | ', 1))) = lower(topic) THEN 3 END AS tier FROM t, q)
SELECT topic, key, CAST(1.0 AS DOUBLE) AS score, CASE WHEN tier <= 2 THEN 'direct' ELSE 'fuzzy_suggest' END AS match_type FROM m WHERE tier IS NOT NULL""")
def title_lookup_tiers(spark, sf):
    return TI.lookup(part_titles(spark, sf), topics(spark))


MISSPELT = ("wigdet", "bolt", "gera", "gizmos", "rng", "sprocket", "windget")


@query("""WITH w AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS title FROM part), q AS (SELECT unnest([""" + ", ".join(f"'{t}'" for t in MISSPELT) + """]) AS topic)
SELECT topic, title FROM w, q WHERE length(topic) >= 4 AND topic <> title AND damerau_levenshtein(topic, title) = 1 AND (length(topic) >= 5 OR (length(topic) = length(title) AND levenshtein(topic, title) = 2))""")
def typo_variants_lookup(spark, sf):
    w = table(spark, sf, "part").select(F.explode(F.split("p_name", " ")).alias("title")).distinct().withColumn("key", F.col("title"))
    return TI.typos(w, topics(spark, MISSPELT)).select("topic", "title")


@query("""WITH t AS (SELECT p_name AS title, min(p_partkey) AS id FROM part GROUP BY p_name)
SELECT id, title, CASE WHEN starts_with(lower(title), 'b') THEN 'title_start_match' ELSE 'title_contains_match' END AS match_type FROM t WHERE contains(lower(title), 'b')
ORDER BY CASE WHEN starts_with(lower(title), 'b') THEN 0 ELSE 1 END, length(title), title, id LIMIT 20""")
def suggest_prefix(spark, sf):
    return TI.suggest(part_titles(spark, sf), "b", 20)


STRONG = ("By the was", "of be edha", "Thheouble heenwh on reti ingeser erster that extra", "zz")
PAGE_TITLE = "trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1))"


@query("WITH q AS (SELECT unnest([" + ", ".join(f"'{t}'" for t in STRONG) + f"""]) AS topic), p AS (SELECT page_id, {PAGE_TITLE} AS title FROM pages),
f AS (SELECT topic, page_id, title, unnest([title, trim(split_part(title, ' | ', 1)), regexp_replace(trim(split_part(title, ' | ', 1)), '^([^,:(]+),\\s*([^,|:(]+?)(\\s*\\(.*)?$', '\\2 \\1\\3')]) AS form FROM q, p),
a AS (SELECT topic, page_id, title, regexp_extract_all(lower(form), '[\\p{{L}}\\p{{N}}]+') AS c, regexp_extract_all(lower(topic), '[\\p{{L}}\\p{{N}}]+') AS t FROM f WHERE length(form) >= 3 AND length(topic) >= 3)
SELECT DISTINCT topic, page_id, title FROM a WHERE len(c) > 0 AND len(t) > 0 AND (c[1:len(t)] = t OR (len(t) = len(c) + 1 AND t[1:len(c)] = c))""")
def strong_title_match(spark, sf):
    p = A.pages_as_entries(table(spark, sf, "pages")).select(F.col("entry_id").alias("page_id"), "title")
    q = F.explode(F.array(*[F.lit(v) for v in STRONG]))  # a fixed handful of topics
    return p.select("page_id", "title", q.alias("topic")).where(T.strong_title(F.col("topic"), F.col("title"))).select("topic", "page_id", "title")


# The rule as it is defined: a name without its namespace of up to two characters that begins or ends like a list.
IS_LIST = """regexp_matches(CASE WHEN instr(path, '/') BETWEEN 1 AND 3 AND length(path) > instr(path, '/') THEN substr(path, instr(path, '/') + 1) ELSE path END,
 '(?i)^(list|index|outline|glossary|timeline|bibliography|lists)_of_|^listed_|_(discography|filmography|videography|bibliography|appearances_and_filmography|awards_and_nominations|awards_and_honou?rs|honou?rs_and_awards)$')"""
LIST_FORMS = {"ECONOMY": ("A/List_of_", ""), "MEDIUM": ("", "_discography"), "LARGE": ("Listed_", ""), "STANDARD": ("Academy_Awards_", ""), "PROMO": ("", "_awards_and_honours"), "SMALL": ("C/Outline_of_", "_x")}


@query("WITH f AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{a}', '{b}')" for k, (a, b) in LIST_FORMS.items()) + f""") AS v(p_type, a, b)), t AS (SELECT DISTINCT a || p_brand || b AS path, p_type, p_brand FROM part JOIN f USING (p_type)), r AS (SELECT path, row_number() OVER (ORDER BY p_brand, p_type) AS rn FROM t)
SELECT path, rn, {IS_LIST} AS is_list, row_number() OVER (ORDER BY CASE WHEN {IS_LIST} THEN 1 ELSE 0 END, rn) AS new_rn FROM r WHERE rn <= 200""")
def list_article_demotion(spark, sf):
    t = table(spark, sf, "part").select("p_type", "p_brand").distinct()
    form = lambda i: F.element_at(F.create_map(*[F.lit(x) for k, v in LIST_FORMS.items() for x in (k, v[i])]), F.col("p_type"))
    hits = t.withColumn("path", F.concat(form(0), "p_brand", form(1))).orderBy("p_brand", "p_type").limit(200)
    ranked = hits.select("path", F.row_number().over(Window.orderBy("p_brand", "p_type")).alias("rn"))
    return P.demoted(ranked, T.is_list_article(F.col("path")), "rn")


@query("WITH q AS (SELECT unnest([" + ", ".join(f"'{t}'" for t in TOPICS) + """]) AS topic), w AS (SELECT topic, regexp_extract_all(lower(topic), '[\\p{L}\\p{N}]+') AS w FROM q), s AS (SELECT topic, w, unnest(range(1, least(len(w), 4) + 1)) AS n FROM w)
SELECT topic, array_to_string(w[len(w) - n + 1:len(w)], ' ') AS tail, least(len(w), 4) - n + 1 AS tail_ord FROM s""")
def query_tails(spark, sf):
    return TI.tails(topics(spark))


@query("""WITH w AS (SELECT DISTINCT p_name AS topic, regexp_extract_all(lower(p_name), '[\\p{L}\\p{N}]+') AS w FROM part), s AS (SELECT topic, w, unnest(range(1, least(len(w), 4) + 1)) AS n FROM w), x AS (SELECT topic, w, n, unnest(range(1, len(w) - n + 2)) AS st FROM s)
SELECT topic, st AS start, n AS len, array_to_string(w[st:st + n - 1], ' ') AS gram FROM x""")
def query_windows(spark, sf):
    return TI.windows(table(spark, sf, "part").select(F.col("p_name").alias("topic")).distinct())
