"""Registered queries over rules, gates, sections of pages, stored graphs and streams.

Their SQL states each rule as it is defined, with its fixed values, and not as the
operators are written; rows that meet every branch are made from the tables' columns.
"""

from __future__ import annotations


from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textquarry.catalog import table
from textquarry.engine import Engine
from textquarry.functions import html as HT
from textquarry.functions import places as PL
from textquarry.functions import snippets as SN
from textquarry.functions import text as T
from textquarry.functions import urls as U
from textquarry.operators import archives as A
from textquarry.operators import graph_store as GS
from textquarry.operators import links as L
from textquarry.operators import passages as P
from textquarry.operators import promotion as PM
from textquarry.operators import respell as RP
from textquarry.operators import search as S
from textquarry.operators import subjects as SJ
from textquarry.operators import synthesis as SY
from textquarry.operators import titles as TI
from textquarry.plans.catalogue import ORACLE, QUERY, TOP, bm25_sql, docs_of, hits_of, part_titles, query, topics
from textquarry.plans.catalogue2 import ASSET_ENDS, EDGES, LINKS, PATH, RANKED, SECTIONS_SQL, page_edges, page_links
from textquarry.plans.language import MISSPELLINGS
from textquarry.session import Scratch
from textquarry.sources import zim as ZIM
from textquarry.streaming import graph as G
from textquarry.streaming import watch as W


def sql_list(values) -> str:
    return "[" + ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values) + "]"


def picked(values, index):
    """The element of a fixed list at ``index`` modulo its length."""
    return F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), (F.pmod(index, F.lit(len(values))) + 1).cast("int"))


# Rules over names and paths.

ENDINGS = "jpg jpeg png gif svg webp bmp ico tif tiff eot otf ttf woff woff2 css js mjs json pdf zip gz mp4 webm mp3 ogg wav avi mov m4a xml oga ogv flac html htm php".split()
MIMES = (None, "text/html", "text/css; charset=utf-8", "application/pdf", " Application/JSON", "image/png", "font/woff2", "application/xhtml+xml", "application/octet-stream", "audio/ogg", "text/javascript")
TAILS = ("", "?x=1.png", "#top")


@query(f"""WITH p AS (SELECT p_partkey, replace(p_name, ' ', '_') || '.' || {sql_list(ENDINGS)}[p_partkey % {len(ENDINGS)} + 1] || {sql_list(TAILS)}[p_size % 3 + 1] AS path, {sql_list(MIMES)}[p_partkey % {len(MIMES)} + 1] AS mime FROM part),
k AS (SELECT *, lower(trim(split_part(mime, ';', 1))) AS kind FROM p)
SELECT p_partkey, path, mime, coalesce(kind IN ('text/css', 'application/javascript', 'text/javascript', 'application/json', 'application/pdf', 'application/zip', 'application/gzip', 'application/x-font-ttf', 'application/x-font-woff', 'application/font-woff', 'application/vnd.ms-fontobject')
 OR regexp_matches(kind, '^(image|video|audio|font)/'), false) OR regexp_matches(lower(split_part(split_part(path, '?', 1), '#', 1)), '{ASSET_ENDS}') AS is_asset FROM k""")
def asset_rules(spark, sf):
    p = table(spark, sf, "part")
    path = F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("."), picked(ENDINGS, F.col("p_partkey")), picked(TAILS, F.col("p_size")))
    return p.select("p_partkey", path.alias("path"), picked(MIMES, F.col("p_partkey")).alias("mime")).withColumn("is_asset", U.is_asset(F.col("path"), F.col("mime")))


ALIASES = ("content", "Metadata", "wellknown", "Well-Known", "SEARCH", "index", " m ", "c", "-", "other", "A", "")


@query(f"""WITH n AS (SELECT n_nationkey, {sql_list(ALIASES)}[n_nationkey % {len(ALIASES)} + 1] AS name FROM nation)
SELECT n_nationkey, name, CASE lower(trim(name)) WHEN 'content' THEN 'C' WHEN 'metadata' THEN 'M' WHEN 'wellknown' THEN 'W' WHEN 'well-known' THEN 'W' WHEN 'search' THEN 'X' WHEN 'index' THEN 'X' ELSE CASE WHEN regexp_matches(lower(trim(name)), '^[a-z]$') THEN upper(trim(name)) ELSE name END END AS ns FROM n""")
def namespace_aliases(spark, sf):
    n = table(spark, sf, "nation").select("n_nationkey", picked(ALIASES, F.col("n_nationkey")).alias("name"))
    return n.withColumn("ns", U.canonical_namespace(F.col("name")))


HREFS = ("../x", "./a/../b", "/root//c", "sub/", "a/./b/../../c/", "x?y#z", "?q=1", "#f", ".", "./", "/", "//host/x", "https://e.org/a", "mailto:a@b", "", "..")


@query(f"""WITH p AS (SELECT page_id, {PATH} AS path FROM pages), x AS (SELECT page_id, path, unnest({sql_list(HREFS)}) AS href FROM p),
b AS (SELECT *, split_part(split_part(href, '?', 1), '#', 1) AS bare, NOT (regexp_matches(href, '(?i)^(javascript|mailto|tel|data|blob|vbscript):') OR trim(href) = '' OR starts_with(href, '#') OR regexp_matches(href, '(?i)^(https?:)?//')) AS inside FROM x),
j AS (SELECT *, list_reduce(list_concat([''], string_split(CASE WHEN starts_with(bare, '/') THEN bare ELSE regexp_replace(path, '[^/]*$', '') || bare END, '/')), lambda a, s: CASE WHEN s IN ('', '.') THEN a WHEN s = '..' THEN regexp_replace(a, '/?[^/]*$', '') WHEN a = '' THEN s ELSE a || '/' || s END) AS joined FROM b)
SELECT page_id, href, CASE WHEN inside AND bare NOT IN ('', '.', './', '/') THEN nullif(joined || CASE WHEN ends_with(bare, '/') AND joined <> '' THEN '/' ELSE '' END, '') END AS target FROM j""")
def link_resolution(spark, sf):
    p = table(spark, sf, "pages").select("page_id", U.url_path(F.col("url")).alias("path"), F.explode(F.array(*[F.lit(h) for h in HREFS])).alias("href"))
    return p.select("page_id", "href", U.resolved(F.col("href"), F.col("path")).alias("target"))


CLIMB = r"(^|[/\\])\.\.([/\\]|$)|^[A-Za-z]:[/\\]"


@query(f"""WITH p AS (SELECT page_id, unnest([path, ' //' || path || '//x ', path || '/../y', '%2e%2e/' || page_id, 'C:/' || page_id, 'a/..b/c', 'a\\..\\b']) AS path FROM (SELECT page_id, regexp_replace({PATH}, '[%+].*', '') AS path FROM pages))
SELECT page_id, path, regexp_replace(regexp_replace(trim(path), '/+', '/', 'g'), '^/', '') AS normal, regexp_matches(path, '{CLIMB}') OR regexp_matches(url_decode(path), '{CLIMB}') AS climbs FROM p""")
def path_checks(spark, sf):
    own = F.regexp_replace(U.url_path(F.col("url")), "[%+].*", "")
    key = F.col("page_id").cast("string")
    forms = F.array(own, F.concat(F.lit(" //"), own, F.lit("//x ")), F.concat(own, F.lit("/../y")), F.concat(F.lit("%2e%2e/"), key), F.concat(F.lit("C:/"), key), F.lit("a/..b/c"), F.lit("a\\..\\b"))
    p = table(spark, sf, "pages").select("page_id", F.explode(forms).alias("path"))
    return p.select("page_id", "path", U.normal_path(F.col("path")).alias("normal"), U.climbs(F.col("path")).alias("climbs"))


@query(f"""WITH p AS (SELECT page_id, {PATH} AS path, page_id % 2 = 0 AS fresh FROM pages), q AS (SELECT page_id, fresh, unnest([path, 'A/' || path, 'C/x', 'I/x', 'A/', '']) AS path FROM p)
SELECT page_id, path, CASE WHEN fresh THEN length(path) > 0 ELSE regexp_matches(path, '^[AC]/.') END AS is_source FROM q""")
def content_sources(spark, sf):
    own = U.url_path(F.col("url"))
    forms = F.array(own, F.concat(F.lit("A/"), own), F.lit("C/x"), F.lit("I/x"), F.lit("A/"), F.lit(""))
    p = table(spark, sf, "pages").select("page_id", (F.col("page_id") % 2 == 0).alias("fresh"), F.explode(forms).alias("path"))
    return p.select("page_id", "path", U.is_content_source(F.col("path"), F.col("fresh")).alias("is_source"))


@query(f"""WITH p AS (SELECT page_id, 'C/' || regexp_replace({PATH}, '%', '', 'g') || '.html' AS path FROM pages), s AS (SELECT *, regexp_replace(regexp_extract(split_part(split_part(path, '?', 1), '#', 1), '([^/]*)/*$', 1), '\\.(html?|md|php)$', '') AS name FROM p),
t AS (SELECT *, trim(regexp_replace(name, '[_.+-]+', ' ', 'g')) AS terms FROM s)
SELECT page_id, terms, trim(replace(regexp_replace(path, '^[A-Za-z-]/', ''), '_', ' ')) AS title, regexp_replace(lower(terms), '[^\\p{{L}}\\p{{N}}]+', '', 'g') <> '' AS same FROM t""")
def path_terms(spark, sf):
    path = F.concat(F.lit("C/"), F.replace(U.url_path(F.col("url")), F.lit("%"), F.lit("")), F.lit(".html"))
    p = table(spark, sf, "pages").select("page_id", path.alias("path"))
    terms = U.search_terms(F.col("path"))
    return p.select("page_id", terms.alias("terms"), T.plain_path(F.col("path")).alias("title"), U.same_path(F.col("path"), F.upper(terms)).alias("same"))


PREFIXES = ("red", "re", "new", "old bolt", "old", "large gizmo")


@query(f"SELECT DISTINCT p_name AS title, prefix, starts_with(p_name, prefix) AND NOT regexp_matches(substr(p_name, length(prefix) + 1, 1), '[\\p{{L}}\\p{{N}}_]') AS hit FROM part, (SELECT unnest({sql_list(PREFIXES)}) AS prefix)")
def whole_word_prefix(spark, sf):
    t = table(spark, sf, "part").select(F.col("p_name").alias("title")).distinct()
    t = t.select("title", F.explode(F.array(*[F.lit(p) for p in PREFIXES])).alias("prefix"))
    return t.withColumn("hit", T.starts_with_word(F.col("title"), F.col("prefix")))


FORMS_SQL = """WITH p AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b FROM part),
f AS (SELECT unnest([a || ' ' || b, b || ', ' || a, '  ' || b || ' ,  ' || a || ' | One | Two', b || ', ' || a || ': ' || b || ', x', b || ', ' || a || ' (' || b || ')', a || ': ' || b || ', c', a || ', ' || b || ', c', ', ' || a, b || ',', a || '|' || b]) AS title FROM p),
s AS (SELECT title, trim(CASE WHEN contains(title, '|') THEN regexp_replace(title, '\\|[^|]*$', '') ELSE title END) AS bare FROM f),
h AS (SELECT *, trim(split_part(bare, ',', 1)) AS last, substr(bare, instr(bare, ',') + 1) AS rest FROM s),
c AS (SELECT *, regexp_extract(rest, '^[^:(]*', 0) AS half FROM h)"""


@query(FORMS_SQL + " SELECT DISTINCT title, bare, CASE WHEN contains(bare, ',') AND last <> '' AND NOT regexp_matches(last, '[:(|]') AND trim(half) <> '' AND NOT regexp_matches(half, '[,|]') THEN trim(half) || ' ' || last || substr(rest, length(half) + 1) END AS inverted FROM c")
def title_forms(spark, sf):
    p = table(spark, sf, "part").select(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("a"), F.split_part("p_name", F.lit(" "), F.lit(2)).alias("b")).distinct()
    a, b, c = F.col("a"), F.col("b"), lambda *x: F.concat(*[v if not isinstance(v, str) else F.lit(v) for v in x])
    forms = F.array(c(a, " ", b), c(b, ", ", a), c("  ", b, " ,  ", a, " | One | Two"), c(b, ", ", a, ": ", b, ", x"), c(b, ", ", a, " (", b, ")"), c(a, ": ", b, ", c"), c(a, ", ", b, ", c"), c(", ", a), c(b, ","), c(a, "|", b))
    t = p.select(F.explode(forms).alias("title")).distinct()
    return t.select("title", T.without_site(F.col("title")).alias("bare"), T.inverted(F.col("title")).alias("inverted"))


@query("""WITH p AS (SELECT DISTINCT p_name AS n, p_retailprice AS c FROM part), t AS (SELECT n, '[' || n || '](a/b.html) **' || n || '**  x' || chr(10) || ' ' || n AS md, chr(10) || '-12' || chr(10) || chr(10) || n AS voted, CAST(floor(c * 17) AS BIGINT) AS c FROM p)
SELECT n, c, regexp_replace(md, '\\[([^\\]]*)\\]\\([^)]*\\)', '\\1', 'g') AS no_links, replace(md, '**', '') AS no_bold, regexp_replace(voted, '^\\n*[+-]?\\d+\\n\\n*', '') AS no_votes, trim(regexp_replace(md, '\\s+', ' ', 'g')) AS squeezed,
 CAST(floor(length(md) / 4.0 * 1.05) + 1 AS BIGINT) AS tokens, CASE WHEN c < 1000 THEN CAST(c AS VARCHAR) WHEN c < 10000 THEN format('{:.1f}K', c / 1000.0) ELSE CAST(c // 1000 AS VARCHAR) || 'K' END AS humane FROM t""")
def markdown_plain(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_name").alias("n"), F.col("p_retailprice").alias("c")).distinct()
    md = F.concat(F.lit("["), "n", F.lit("](a/b.html) **"), "n", F.lit("**  x\n "), "n")
    p = p.select("n", F.floor(F.col("c") * 17).alias("c"), md.alias("md"), F.concat(F.lit("\n-12\n\n"), "n").alias("voted"))
    md = F.col("md")
    return p.select("n", "c", T.without_links(md).alias("no_links"), T.without_bold(md).alias("no_bold"), T.without_votes(F.col("voted")).alias("no_votes"), T.squeezed(md).alias("squeezed"), T.token_estimate(md).alias("tokens"), T.count_text(F.col("c")).alias("humane"))


@query("""WITH t AS (SELECT doc_id, ' ' || chr(7) || text || chr(13) || chr(10) || chr(9) || text || ' ' AS t FROM documents), l AS (SELECT doc_id, t, regexp_replace(t, '[\\x00-\\x1F\\x7F]+', ' ', 'g') AS line FROM t),
k AS (SELECT *, rtrim(substr(line, 1, 1024)) AS kept FROM l) SELECT doc_id, md5(trim(regexp_replace(t, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]', '', 'g'))) AS cleaned, CASE WHEN length(line) > 1024 THEN kept || '... [+' || (length(line) - length(kept)) || ' chars elided]' ELSE line END AS line FROM k""")
def log_lines(spark, sf):
    t = docs_of(spark, sf).select("doc_id", F.concat(F.lit(" \x07"), "text", F.lit("\r\n\t"), "text", F.lit(" ")).alias("t"))
    return t.select("doc_id", F.md5(T.cleaned_input(F.col("t"))).alias("cleaned"), T.one_line(F.col("t")).alias("line"))


@query("SELECT doc_id, md5(strip_accents(lower(text))) AS folded FROM documents")
def fold_texts(spark, sf):
    return docs_of(spark, sf).select("doc_id", F.md5(SN.fold_all(F.col("text"))).alias("folded"))


# Promotion gates, one query each.

GATE_ROWS = (
    ("stalin ussr russia", "A/Russia", "direct", None), ("hamlet denmark prince", "Hamlet", "direct", None), ("apollo 11 moon landing", "Moon_landing", "direct", None), ("berlin germany", "Berlin", "fuzzy_suggest", None),
    ("marie curie radioactivity", "Radioactive_(Redniss_book)", "fuzzy_suggest", None), ("tesla electricity", "Tesla's_Wireless_Electricity", "fuzzy_suggest", None), ("united states constitution", "Constitution_of_the_United_States", "direct", None),
    ("beethoven symphony", "Symphony_No._1_(Beethoven)", "fuzzy_suggest", None), ("beethoven 9th symphony", "Symphony_No._9_(Beethoven)", "fuzzy_suggest", None), ("big rapids michigan ferris state", "Ferris_State_University", "fuzzy_suggest", None),
    ("darwin's evolution", "Evolution", "fuzzy_suggest", None), ("newton's gravity", "Newton's_law_of_universal_gravitation", "redirect", "Newton_Laws_of_Gravity"), ("plato’s cave", "Allegory_of_the_cave", "redirect", "Plato's_cave"),
    ("plato's republic philosophy", "Czech_philosophy", "redirect", "Bohemian_thought"), ("achilles' heel", "Heel", "fuzzy_suggest", None), ("c++", "C", "direct", None), ("c++ compiler", "C++", "direct", None),
    ("carbon capture & storage technology", "A/Carbon_capture", "direct", None), ("what is rust?", "Rust", "direct", None), ("mercury", "Mercury_(disambiguation)", "direct", None), ("mercury disambiguation", "Mercury_(disambiguation)", "direct", None),
    ("immanuel kant", "Kant, Immanuel | Encyclopedia", "direct", None), ("texas", "Paris, Texas", "direct", None), ("pi", "Pi_day", "direct", None), ("apollo 11 mission", "Apollo_11", "direct", None), ("martin luther king", "Martin", "direct", None),
)
TOK, WORD, POSS = "[\\p{L}\\p{N}]+(?:[''’][\\p{L}\\p{N}]+)*", "[\\p{L}\\p{N}]+", "([\\p{L}\\p{N}]{1,64})[''’](?:s\\b|\\B)"
GATES = "WITH lit(topic, path, kind, pre) AS (VALUES " + ", ".join("(" + sql_list(r)[1:-1] + ")" for r in GATE_ROWS) + f"""), p AS (SELECT DISTINCT p_name, lower(p_type) AS ty FROM part),
g0 AS (SELECT * FROM lit UNION ALL SELECT p_name || ' ' || ty, 'A/' || replace(p_name, ' ', '_'), 'direct', NULL FROM p UNION ALL SELECT ty || ' ' || p_name, split_part(p_name, ' ', 2), 'fuzzy_suggest', NULL FROM p
 UNION ALL SELECT p_name || '''s ' || ty, ty || '_of_the_' || split_part(p_name, ' ', 1), 'redirect', split_part(p_name, ' ', 2) FROM p UNION ALL SELECT p_name || ' + ' || ty, ty || '_' || replace(p_name, ' ', '_') || '_7', 'fuzzy_suggest', NULL FROM p),
g1 AS (SELECT DISTINCT *, regexp_replace(path, '^[\\p{{L}}\\p{{N}}]/', '') AS name, regexp_replace(coalesce(pre, path), '^[\\p{{L}}\\p{{N}}]/', '') AS was FROM g0),
g AS (SELECT *, regexp_extract_all(lower(topic), '{TOK}') AS t, regexp_extract_all(lower(name), '{TOK}') AS c, regexp_extract_all(lower(topic), '{WORD}') AS tw, regexp_extract_all(lower(name), '{WORD}') AS cw, regexp_extract_all(lower(was), '{WORD}') AS ww,
 regexp_matches(topic, '{POSS}') AS poss, regexp_extract_all(lower(topic), '{POSS}', 1) AS owners FROM g1),
s AS (SELECT *, len(t) >= 3 AND len(c) = 1 AND c[1] = t[len(t)] AS hijack, CASE kind WHEN 'fuzzy_suggest' THEN list_has_any(owners, cw) WHEN 'redirect' THEN len(list_filter(ww, lambda x: NOT list_contains(tw, x))) = 0 OR list_has_any(owners, cw) ELSE true END AS owner_ok,
 len(t) >= 2 AND len(c) >= 2 AND len(list_filter(c, lambda x: NOT list_contains(t, x) AND x NOT IN ('a', 'an', 'the', 'and', 'or', 'but', 'nor', 'of', 'in', 'on', 'at', 'to', 'from', 'by', 'with', 'for', 'as', 'into', 'onto', 'over', 'under'))) > 0 AS tangential,
 array_to_string(list_filter(regexp_split_to_array(trim(topic), '\\s+'), lambda w: list_has_any(regexp_extract_all(lower(w), '{WORD}'), cw)), ' ') AS met,
 len(list_filter(list_filter(c, lambda x: NOT list_contains(t, x)), lambda x: regexp_matches(x, '[0-9]'))) > 0 AND len(list_filter(t, lambda x: regexp_matches(x, '[0-9]'))) > 0 AS digits,
 len(c) >= 2 AND len(t) >= 2 AND len(list_filter(range(2, least(len(c), len(t)) + 1), lambda k: NOT list_has_any(c[k + 1:], t) AND len(list_filter(range(1, len(t) - k + 2), lambda i: t[i:i + k - 1] = c[1:k])) > 0)) > 0 AS extends FROM g),
m AS (SELECT *, """ + " OR ".join(f"length(replace(CASE WHEN met = '' THEN topic ELSE met END, '{x}', '')) - length(CASE WHEN met = '' THEN topic ELSE met END) < length(replace(path, '{x}', '')) - length(path)" for x in "+#*&?!") + """ AS smeared FROM s),
b AS (SELECT *, CASE WHEN poss THEN owner_ok ELSE len(t) < 3 OR (NOT hijack AND (kind <> 'fuzzy_suggest' OR list_has_any(t, c))) END AS base, NOT smeared AND (poss OR NOT tangential OR digits OR extends) AS z4 FROM m)"""  # fmt: skip


def gate_rows(spark, sf):
    p = table(spark, sf, "part").select("p_name", F.lower("p_type").alias("ty")).distinct()
    n, ty, c = F.col("p_name"), F.col("ty"), lambda *x: F.concat(*[v if not isinstance(v, str) else F.lit(v) for v in x])
    under, first, last, none = F.replace(n, F.lit(" "), F.lit("_")), F.split_part(n, F.lit(" "), F.lit(1)), F.split_part(n, F.lit(" "), F.lit(2)), F.lit(None).cast("string")
    made = [(c(n, " ", ty), c("A/", under), "direct", none), (c(ty, " ", n), last, "fuzzy_suggest", none), (c(n, "'s ", ty), c(ty, "_of_the_", first), "redirect", last), (c(n, " + ", ty), c(ty, "_", under, "_7"), "fuzzy_suggest", none)]
    rows = p.select(F.explode(F.array(*[F.struct(t.alias("topic"), x.alias("path"), F.lit(k).alias("kind"), pre.alias("pre")) for t, x, k, pre in made])).alias("g")).select("g.*")
    fixed = spark.range(1).select(F.explode(F.array(*[F.struct(*[F.lit(v).cast("string").alias(a) for v, a in zip(r, ("topic", "path", "kind", "pre"))]) for r in GATE_ROWS])).alias("g")).select("g.*")
    return rows.unionByName(fixed).distinct().withColumn("was", F.coalesce("pre", "path"))


def gated(spark, sf, **columns):
    g = gate_rows(spark, sf)
    return g.select("topic", "path", "kind", *[c.alias(k) for k, c in columns.items()])


@query(GATES + " SELECT topic, path, kind, poss AS possessive, owner_ok AS ok FROM b")
def gate_possessive(spark, sf):
    return gated(spark, sf, possessive=PM.is_possessive(F.col("topic")), ok=PM.possessive_ok(F.col("topic"), PM.name_of(F.col("path")), F.col("kind"), F.col("was")))


@query(GATES + " SELECT topic, path, kind, hijack FROM b")
def gate_tail_hijack(spark, sf):
    return gated(spark, sf, hijack=PM.tail_hijack(F.col("topic"), PM.name_of(F.col("path"))))


@query(GATES + " SELECT topic, path, kind, smeared FROM b")
def gate_smeared_marks(spark, sf):
    return gated(spark, sf, smeared=PM.smeared(F.col("topic"), F.col("path")))


@query(GATES + " SELECT topic, path, kind, base FROM b")
def gate_base(spark, sf):
    return gated(spark, sf, base=PM.base_ok(F.col("topic"), PM.name_of(F.col("path")), F.col("kind"), F.col("was")))


@query(GATES + " SELECT topic, path, kind, tangential, digits, extends, z4 FROM b")
def gate_tangential(spark, sf):
    topic, path = F.col("topic"), F.col("path")
    name = PM.name_of(path)
    return gated(spark, sf, tangential=PM.tangential(topic, name), digits=PM.same_digits(topic, PM.bare(path)), extends=PM.extends_run(topic, name), z4=PM.z4(topic, PM.bare(path), name, F.lit(False)))


@query(GATES + " SELECT topic, path, kind, NOT smeared AND CASE WHEN poss THEN base WHEN base THEN z4 ELSE hijack END AS alone, NOT smeared AND CASE WHEN poss THEN base WHEN base THEN z4 ELSE false END AS among FROM b")
def gate_tail_acceptance(spark, sf):
    topic, path = F.col("topic"), F.col("path")
    ok = lambda n: PM.tail_ok(topic, PM.bare(path), PM.name_of(path), F.col("kind"), F.col("was"), F.lit(n), F.lit(False))
    return gated(spark, sf, alone=ok(0), among=ok(2))


STRONG_FORM = "(tw = {w} OR (len(array_to_string(tw, '')) >= 3 AND len(array_to_string({w}, '')) >= 3 AND (({w})[1:len(tw)] = tw OR (len(tw) = len({w}) + 1 AND tw[1:len({w})] = {w}))))"


@query(GATES + f""", f AS (SELECT *, trim(CASE WHEN contains(path, '|') THEN regexp_replace(path, '\\|[^|]*$', '') ELSE path END) AS bare FROM b),
i AS (SELECT *, CASE WHEN regexp_matches(bare, '^[^,:(|]+,[^,|:(]+([:(].*)?$') THEN trim(regexp_extract(bare, ',([^,|:(]+)', 1)) || ' ' || trim(split_part(bare, ',', 1)) END AS turned FROM f),
w AS (SELECT *, regexp_extract_all(lower(path), '{WORD}') AS w1, regexp_extract_all(lower(bare), '{WORD}') AS w2, regexp_extract_all(lower(coalesce(turned, '')), '{WORD}') AS w3 FROM i)
SELECT topic, path, kind, (contains(lower(topic), 'disambiguation') OR NOT regexp_matches(lower(path), '[_ ]\\(disambiguation\\)\\s*$')) AND len(tw) > 0 AND ({STRONG_FORM.format(w="w1")} OR {STRONG_FORM.format(w="w2")} OR (turned IS NOT NULL AND len(tw) >= len(w3) AND {STRONG_FORM.format(w="w3")})) AS strong FROM w""")
def gate_strong_canonical(spark, sf):
    return gated(spark, sf, strong=PM.strong_canonical(F.col("topic"), F.col("path"), F.col("path")))


PROMOTED = ("the best small ring", "red widget of blue bolt", "hot gear", "small rign", "cold anvil's plate", "Blue Bolt", "large gizmo large plate set", "nothing at all", "widget")


@query()
def topic_promotion(spark, sf):
    """The title of the parts that each topic is promoted to, by all passes; tested against a plain version."""
    t = part_titles(spark, sf).select(F.lit("parts").alias("archive"), F.lit(1).alias("ord"), "path", "title", F.lit(None).cast("string").alias("pre"))
    return PM.promote(topics(spark, PROMOTED), t).drop("ord")


# Titles and suggestions.


@query("WITH t AS (SELECT p_name AS title, p_brand AS archive, replace(p_name, ' ', '_') AS path FROM part), q AS (SELECT unnest(['Small Ring', 'red widget', 'hot gear']) AS topic), m AS (SELECT DISTINCT topic, archive, path, title, CASE WHEN title = topic OR path = replace(topic, ' ', '_') OR path = replace(lower(topic), ' ', '_') THEN 'direct' ELSE 'fuzzy_suggest' END AS match_type FROM t JOIN q ON lower(title) = lower(topic)),"
 " r AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY archive, path) AS rn FROM m) SELECT topic, archive, path, title, CAST(1.0 AS DOUBLE) AS score, match_type, rn FROM r WHERE rn <= 5")
def title_results(spark, sf):
    t = table(spark, sf, "part").select(F.struct("p_brand", "p_partkey").alias("id"), F.col("p_brand").alias("archive"), F.replace("p_name", F.lit(" "), F.lit("_")).alias("path"), F.col("p_name").alias("title"))
    return TI.results(TI.lookup(t.select("id", "title", "path"), topics(spark, ("Small Ring", "red widget", "hot gear"))), t, 5)


@query(ORACLE["title_results"].replace("SELECT topic, archive, path, title, CAST(1.0 AS DOUBLE) AS score, match_type, rn FROM r WHERE rn <= 5", """, k AS (SELECT * FROM r WHERE rn <= 5), q2 AS (SELECT topic, 'Brand#9' AS archive, replace(lower(topic), ' ', '_') AS path, topic AS title FROM q WHERE topic <> 'hot gear'),
j AS (SELECT topic, archive, path, coalesce(k.title, q2.title) AS title, coalesce(match_type, 'promoted') AS match_type, CASE WHEN q2.title IS NOT NULL THEN 0 ELSE k.rn END AS o FROM k FULL JOIN q2 USING (topic, archive, path)), z AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY o) AS rn FROM j)
SELECT topic, archive, path, title, CAST(1.0 AS DOUBLE) AS score, match_type, rn FROM z WHERE rn <= 4"""))
def title_results_promoted(spark, sf):
    wanted = topics(spark, ("Small Ring", "red widget"))
    return TI.with_promotion(title_results(spark, sf), wanted.select("topic", F.lit("Brand#9").alias("archive"), F.replace(F.lower("topic"), F.lit(" "), F.lit("_")).alias("path"), F.col("topic").alias("title")), 4)


RESPELT = ("smal", "rde", "bleu", "larg", "coldd", "hot", "xyz", "olld bolt")


@query(f"""WITH t AS (SELECT p_name AS title, min(p_partkey) AS key FROM part GROUP BY p_name), q AS (SELECT unnest({sql_list(RESPELT)}) AS topic), w AS (SELECT *, split_part(title, ' ', 1) AS variant FROM t)
SELECT topic, variant, key, title FROM w, q WHERE NOT contains(topic, ' ') AND length(topic) >= 4 AND topic <> variant AND damerau_levenshtein(topic, variant) = 1 AND (length(topic) >= 5 OR (length(topic) = length(variant) AND levenshtein(topic, variant) = 2))""")
def typo_whole_word(spark, sf):
    t = table(spark, sf, "part").groupBy(F.col("p_name").alias("title")).agg(F.min("p_partkey").alias("key"))
    return TI.respelt(t, topics(spark, RESPELT))


@query(RANKED.replace("rn <= 20", "rn <= 50") + """, h AS (SELECT CAST(doc_id AS VARCHAR) AS path, trim(split_part(text, chr(10), 1)) AS title, rn FROM t), d AS (SELECT title, arg_min(path, rn) AS path, min(rn) AS rn FROM h WHERE title <> '' GROUP BY title),
pool AS (SELECT *, CASE WHEN starts_with(lower(title), 'the') THEN 0 ELSE 1 END AS k FROM d WHERE contains(lower(title), 'the') ORDER BY rn LIMIT 10)
SELECT path, title, CASE k WHEN 0 THEN 'search_start_match' ELSE 'search_contains_match' END AS match_type, row_number() OVER (ORDER BY k, length(title), rn) AS rn FROM pool""")
def suggest_from_search(spark, sf):
    hits = S.page(hits_of(spark, sf, "text"), 50)
    hits = hits.select(F.col("doc_id").cast("string").alias("path"), F.trim(F.split_part("text", F.lit("\n"), F.lit(1))).alias("title"), "rn")
    return TI.suggest_ranked(hits, part_titles(spark, sf).select("path", "title"), "the", 10)


@query("""SELECT path, title, match_type, row_number() OVER (ORDER BY k, length(title), title, path) AS rn FROM (SELECT replace(p_name, ' ', '_') AS path, p_name AS title, CASE WHEN starts_with(p_name, 'b') THEN 'title_start_match' ELSE 'title_contains_match' END AS match_type, CASE WHEN starts_with(p_name, 'b') THEN 0 ELSE 1 END AS k
 FROM (SELECT DISTINCT p_name FROM part) WHERE contains(p_name, 'b') ORDER BY k, length(title), title, path LIMIT 10)""")
def suggest_from_titles(spark, sf):
    t = part_titles(spark, sf).select("path", "title")
    return TI.suggest_ranked(t.where("false").withColumn("rn", F.lit(0)), t, "b", 10)


# Search: filters, scans and fusion.


@query(bm25_sql("lang = 'en' AND starts_with(source, 'src')") + f""", named AS (SELECT doc_id, lang || '/' || md5(text) AS path, score FROM hits), d AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY score DESC, doc_id) AS k FROM named)
SELECT doc_id, path, score, {TOP} AS rn, (SELECT count(*) FROM d WHERE k = 1) AS total FROM d WHERE k = 1 ORDER BY rn LIMIT 10""")
def filtered_search_distinct(spark, sf):
    d = docs_of(spark, sf).select("doc_id", "text", "lang", "source").withColumn("path", F.concat("lang", F.lit("/"), F.md5("text")))
    hits = S.bm25(d, QUERY, where=(U.namespace(F.col("path")) == "en") & F.col("source").startswith("src"))
    once = S.canonical_first(hits.select("doc_id", U.canonical(F.col("path")).alias("path"), "score", F.struct((-F.col("score")).alias("s"), "doc_id").alias("o")), "path", "o").drop("o")
    return S.page(once, 10).join(F.broadcast(once.agg(F.count("*").alias("total"))))  # one row


@query(RANKED.replace("rn <= 20", "rn <= 200") + ", k AS (SELECT doc_id, score, rn, row_number() OVER (ORDER BY rn) AS n FROM t WHERE lang = 'de') SELECT doc_id, score, rn, (SELECT count(*) FROM t) AS scanned, (SELECT count(*) FROM k) AS matched, (SELECT count(*) > 200 FROM r) AS total_is_lower_bound, CASE WHEN (SELECT count(*) FROM k) > 15 THEN 15 END AS next_skip FROM k WHERE n > 5 AND n <= 15".replace("lang = 'de'", "doc_id IN (SELECT doc_id FROM documents WHERE lang = 'de')"))
def filtered_scan_page(spark, sf):
    hits = hits_of(spark, sf, "lang")
    got, about = S.scan_page(hits, F.col("lang") == "de", 10, 5, 200)
    return got.join(F.broadcast(about)).drop("lang")  # one row


FUSED = bm25_sql() + """, k AS (SELECT source, md5(text) AS path, doc_id, score, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) AS rn FROM hits), t AS (SELECT * FROM k WHERE rn <= 10),
p AS (SELECT source, path, min(rn) AS rn, max(score) AS score FROM t GROUP BY source, path), f AS (SELECT path, round(sum(1.0 / (60 + rn)), 9) AS score, min(struct_pack(rn := rn, source := source)) AS o FROM p GROUP BY path)"""


@query(FUSED + " SELECT o.source AS archive, path, score, row_number() OVER (ORDER BY score DESC, path) AS rn FROM f ORDER BY rn LIMIT 5")
def fused_owners(spark, sf):
    hits = hits_of(spark, sf, "text", "source")
    top = S.top_per_group(hits.select("source", F.md5("text").alias("path"), "doc_id", "score"), "source", 10)
    top = top.groupBy(F.col("source").alias("archive"), "path").agg(F.min("rn").alias("rn"), F.max("score").alias("relevance"))
    rows = top.select("archive", F.col("archive").alias("ord"), "path", F.col("path").alias("title"), "relevance", "rn")
    return SY.fuse(rows, True).select("archive", "path", "score", "rn")


@query()
def synthesis_hits(spark, sf):
    """The stages fuse, promote, demote and the leakage floor over the documents' sources; the stages are tested one by one."""
    hits = hits_of(spark, sf, "text", "source")
    top = S.top_per_group(hits.select("source", F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("path"), "doc_id", "score"), "source", 10)
    rows = top.select(F.col("source").alias("archive"), F.col("source").alias("ord"), "path", F.col("path").alias("title"), F.col("score").alias("relevance"), "rn")
    none = rows.where("false").select("archive", "path", "title")
    return SY.select_hits(rows, none, QUERY, True)


@query(RANKED + """, b AS (SELECT doc_id, rn, split_part(text, chr(10), 1) AS line FROM t), k AS (SELECT *, least(length(line), 600 - (sum(length(line)) OVER (ORDER BY rn) - length(line))) AS kept FROM b), cuts AS (SELECT *, substr(line, 1, CAST(kept AS BIGINT)) AS cut FROM k WHERE kept > 0),
w AS (SELECT *, kept - instr(reverse(cut), ' ') AS stop FROM cuts)
SELECT doc_id, rn, CASE WHEN length(line) <= kept THEN line WHEN contains(cut, ' ') AND stop > kept / 2 THEN rtrim(substr(line, 1, CAST(stop AS BIGINT))) ELSE cut END AS passage FROM w""")
def budget_cut_at_word(spark, sf):
    ranked = S.page(hits_of(spark, sf, "text"), 20).select("doc_id", "rn", F.split_part("text", F.lit("\n"), F.lit(1)).alias("line"))
    kept = P.within_budget(ranked.withColumn("n_chars", F.length("line")), 600)
    return kept.select("doc_id", "rn", P.cut_at_word(F.col("line"), F.col("kept").cast("int")).alias("passage"))


@query(RANKED + " SELECT string_agg(split_part(text, chr(10), 1) || chr(10) || '[cite: ' || source || '/' || doc_id || ']', chr(10) || chr(10) ORDER BY rn) AS answer, count(*) AS n_passages FROM t WHERE rn <= 5")
def answer_render(spark, sf):
    p = S.page(hits_of(spark, sf, "text", "source"), 5)
    return P.answer(p.select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("cite_id"), "rn", F.split_part("text", F.lit("\n"), F.lit(1)).alias("passage")))


@query(RANKED + " SELECT source AS cite_id, min(rn) AS rn FROM t GROUP BY source")
def answer_citations(spark, sf):
    p = S.page(hits_of(spark, sf, "text", "source"), 20)
    return P.citations(p.select(F.col("source").alias("cite_id"), "rn"))


# Sections and passages of texts.


@query(SECTIONS_SQL + """, h AS (SELECT doc_id, pos, line, s, 1 + length(line) % 4 AS level, split_part(line, ' ', 1) AS title FROM sec), e AS (SELECT doc_id, length(text) AS n FROM documents), x AS (SELECT h.*, n, regexp_replace(regexp_replace(trim(lower(title)), '\\s+', '-', 'g'), '[^\\p{L}\\p{N}_-]', '', 'g') AS slug FROM h JOIN e USING (doc_id)),
other AS (SELECT doc_id, pos AS p2, level AS l2, s AS s2 FROM h), a AS (SELECT x.doc_id, x.pos, min(s2) AS nxt FROM x JOIN other l ON l.doc_id = x.doc_id AND p2 > x.pos AND l2 <= x.level GROUP BY 1, 2), b AS (SELECT x.doc_id, x.pos, max(p2) AS par FROM x JOIN other l ON l.doc_id = x.doc_id AND p2 < x.pos AND l2 < x.level GROUP BY 1, 2),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, slug ORDER BY pos) AS k FROM x)
SELECT o.doc_id, CAST(o.pos AS INTEGER) AS pos, CAST(level AS INTEGER) AS level, slug || CASE WHEN k > 1 THEN '_' || k ELSE '' END AS id, CAST(s AS INTEGER) AS char_start, CAST(coalesce(nxt, n) AS INTEGER) AS char_end, CAST(par AS INTEGER) AS parent_pos FROM o LEFT JOIN a ON a.doc_id = o.doc_id AND a.pos = o.pos LEFT JOIN b ON b.doc_id = o.doc_id AND b.pos = o.pos""")
def heading_sections(spark, sf):
    d = docs_of(spark, sf).select("doc_id", "text")
    h = P.sections(d).join(d.select("doc_id", F.length("text").alias("length")), "doc_id")
    h = h.select("doc_id", "pos", (1 + F.length("line") % 4).alias("level"), F.split_part("line", F.lit(" "), F.lit(1)).alias("text"), F.col("char_start").alias("start"), "length")
    return P.heading_sections(h, "doc_id").drop("text")


@query("""WITH RECURSIVE w AS (SELECT doc_id, text, 0 AS page_no, 0 AS char_offset, CASE WHEN length(text) <= 1000 THEN length(text) ELSE coalesce(nullif(length(regexp_replace(substr(text, 1, 1000), '\\s+$', '')), 0), 1000) END AS n FROM documents WHERE length(text) > 0
 UNION ALL SELECT doc_id, text, page_no + 1, char_offset + n, CASE WHEN length(text) - char_offset - n <= 1000 THEN length(text) - char_offset - n ELSE coalesce(nullif(length(regexp_replace(substr(text, char_offset + n + 1, 1000), '\\s+$', '')), 0), 1000) END FROM w WHERE char_offset + n < length(text))
SELECT doc_id, page_no, CAST(char_offset AS INTEGER) AS char_offset, CAST(n AS INTEGER) AS n_chars FROM w""")
def content_pages_trimmed(spark, sf):
    return P.trimmed_pages(docs_of(spark, sf), 1000)


# Places are counted in the page as it is: marks before a hit and runs of spaces count in full.  The SQL cuts the page into
# marks, spaces and words and sums their lengths in the page, without marks, and with single spaces.
@query("""WITH d AS (SELECT doc_id, replace(text, ' that ', '  **that** ') AS md, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, md, replace(l[len(l)], '**', '') AS exact, replace(replace(l[len(l)], ' ', '   '), '**', '') AS loose FROM d),
t AS (SELECT doc_id, unnest(regexp_extract_all(md, '\\*\\*|\\s+|(?:[^*\\s]|\\*[^*\\s])+|\\*')) AS tok, generate_subscripts(regexp_extract_all(md, '\\*\\*|\\s+|(?:[^*\\s]|\\*[^*\\s])+|\\*'), 1) AS i FROM p),
s AS (SELECT *, CASE WHEN tok = '**' THEN 0 ELSE length(tok) END AS pl FROM t), r AS (SELECT *, pl > 0 AND trim(tok) = '' AND NOT regexp_matches(tok, '\\S') AS sp FROM s),
v AS (SELECT *, lag(sp) OVER w AS was FROM r WHERE pl > 0 WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
c AS (SELECT doc_id, i, CASE WHEN sp THEN CASE WHEN coalesce(was, true) THEN 0 ELSE 1 END ELSE pl END AS fl FROM v),
u AS (SELECT r.doc_id, r.i, sum(length(tok)) OVER w - length(tok) AS o, pl, sum(pl) OVER w - pl AS po, coalesce(fl, 0) AS fl, sum(coalesce(fl, 0)) OVER w - coalesce(fl, 0) AS fo FROM r LEFT JOIN c ON c.doc_id = r.doc_id AND c.i = r.i WINDOW w AS (PARTITION BY r.doc_id ORDER BY r.i)),
q AS (SELECT doc_id, exact, loose, replace(md, '**', '') AS plain, trim(regexp_replace(replace(md, '**', ''), '\\s+', ' ', 'g')) AS flat, substr(trim(regexp_replace(loose, '\\s+', ' ', 'g')), 1, 80) AS head, substr(trim(regexp_replace(exact, '\\s+', ' ', 'g')), 1, 80) AS ehead FROM p),
k AS (SELECT doc_id, CASE WHEN exact <> '' THEN instr(plain, exact) ELSE 0 END - 1 AS ep, CASE WHEN length(ehead) >= 12 THEN instr(flat, ehead) ELSE 0 END - 1 AS ef, CASE WHEN loose <> '' THEN instr(plain, loose) ELSE 0 END - 1 AS lp, CASE WHEN length(head) >= 12 THEN instr(flat, head) ELSE 0 END - 1 AS lf FROM q)
SELECT k.doc_id, CAST(coalesce(max(o + ep - po) FILTER (WHERE ep >= 0 AND pl > 0 AND po <= ep AND ep < po + pl), max(o + ef - fo) FILTER (WHERE ep < 0 AND ef >= 0 AND fl > 0 AND fo <= ef AND ef < fo + fl), -1) AS INTEGER) AS exact_at,
 CAST(coalesce(max(o + lp - po) FILTER (WHERE lp >= 0 AND pl > 0 AND po <= lp AND lp < po + pl), max(o + lf - fo) FILTER (WHERE lp < 0 AND lf >= 0 AND fl > 0 AND fo <= lf AND lf < fo + fl), -1) AS INTEGER) AS loose_at FROM k LEFT JOIN u ON u.doc_id = k.doc_id GROUP BY k.doc_id""")
def passage_places(spark, sf):
    lines = F.split("text", "\n")
    d = docs_of(spark, sf).where("text is not null").select("doc_id", F.replace("text", F.lit(" that "), F.lit("  **that** ")).alias("md"), F.element_at(lines, -1).alias("exact"))
    return d.select("doc_id", PL.located(F.col("exact"), F.col("md")).alias("exact_at"), PL.located(F.replace("exact", F.lit(" "), F.lit("   ")), F.col("md")).alias("loose_at"))


@query()
def excerpts_of_texts(spark, sf):
    """The passage of every text about the query; tested against examples of each rule."""
    return docs_of(spark, sf).select("doc_id", SN.excerpt(QUERY)("text").alias("snippet"))


# Archives.


@query(f"""WITH v AS (SELECT page_id, unnest([html, regexp_replace(html, '(?is)<title[^>]*>.*?</title>', ''), 'plain ' || page_id, repeat('word ' || page_id || ' ', 200)]) AS value FROM pages),
s AS (SELECT *, trim(regexp_replace(regexp_extract(value, '(?is)<title[^>]*>(.*?)</title>', 1), '\\s+', ' ', 'g')) AS title,
 trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(value, '(?is)<script\\b.*?</script>', ' ', 'g'), '(?is)<style\\b.*?</style>', ' ', 'g'), '(?is)<head\\b.*?</head>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) AS body,
 regexp_matches(lower(substr(value, 1, 512)), '<!doctype html|<html|<head|<title>') AS page FROM v), k AS (SELECT page_id, CASE WHEN page THEN CASE WHEN title <> '' THEN title ELSE body END ELSE value END AS shown FROM s)
SELECT page_id, CASE WHEN length(shown) > 800 THEN rtrim(substr(shown, 1, 800)) || '… [truncated, ' || format('{{:,}}', length(shown)) || ' chars total]' ELSE shown END AS value FROM k""")
def metadata_values(spark, sf):
    no_title = F.regexp_replace("html", r"(?is)<title[^>]*>.*?</title>", "")
    key = F.col("page_id").cast("string")
    v = table(spark, sf, "pages").select("page_id", F.explode(F.array("html", no_title, F.concat(F.lit("plain "), key), F.repeat(F.concat(F.lit("word "), key, F.lit(" ")), F.lit(200)))).alias("value"))
    return v.select("page_id", A.distilled(F.col("value")).alias("value"))


MADE_SQL = """WITH e AS (SELECT n_name AS archive, unnest(['M/Title', 'M/Language', 'M/Illustration_48x48@1', 'C/' || n_name, 'C/logo.png', 'W/robots.txt', 'W/other', 'X/title']) AS path, n_nationkey AS k FROM nation),
a AS (SELECT n_name AS archive, CASE WHEN n_nationkey % 3 = 0 THEN 'C/' || n_name WHEN n_nationkey % 3 = 1 THEN 'C/gone' END AS main_path, n_nationkey % 2 = 0 AS has_illustration, n_nationkey FROM nation)"""


def made_entries(spark, sf):
    name = F.col("n_name")
    paths = F.array(F.lit("M/Title"), F.lit("M/Language"), F.lit("M/Illustration_48x48@1"), F.concat(F.lit("C/"), name), F.lit("C/logo.png"), F.lit("W/robots.txt"), F.lit("W/other"), F.lit("X/title"))
    e = table(spark, sf, "nation").select(name.alias("archive"), F.posexplode(paths).alias("i", "path"), F.col("n_nationkey").alias("k"))
    return e.select("archive", "path", (F.col("k") * 8 + F.col("i")).alias("entry_id"), F.concat(F.lit("value of "), "path", F.lit(" in "), "archive").alias("html"))


def made_archive_rows(spark, sf):
    k = F.col("n_nationkey")
    main = F.when(k % 3 == 0, F.concat(F.lit("C/"), "n_name")).when(k % 3 == 1, "C/gone")
    return table(spark, sf, "nation").select(F.col("n_name").alias("archive"), main.alias("main_path"), (k % 2 == 0).alias("has_illustration"))


@query(MADE_SQL + " SELECT archive, substr(path, 3) AS key, 'value of ' || path || ' in ' || archive AS value FROM e WHERE starts_with(path, 'M/') AND NOT starts_with(path, 'M/Illustration_')")
def metadata_keys(spark, sf):
    return A.metadata_entries(made_entries(spark, sf))


@query(MADE_SQL + " SELECT archive, 'Title' AS key, 'value of ' || path || ' in ' || archive AS value FROM e WHERE path = 'M/Title'")
def metadata_entry(spark, sf):
    return A.metadata_entries(made_entries(spark, sf), "Title")


@query(MADE_SQL + " SELECT archive, CASE WHEN n_nationkey % 3 = 0 THEN 'C/' || archive ELSE 'M/Title' END AS path, CASE WHEN n_nationkey % 3 = 0 THEN 'main' ELSE 'first entry' END AS found_by FROM a")
def main_pages(spark, sf):
    return A.main_page(made_archive_rows(spark, sf), made_entries(spark, sf))


KNOWN = "SELECT archive, 'W/mainPage' AS path FROM a WHERE main_path IS NOT NULL UNION ALL SELECT archive, 'W/favicon' FROM a WHERE has_illustration UNION ALL SELECT archive, path FROM e WHERE path IN ('W/index', 'W/robots.txt', 'W/exception.html', 'W/404.html')"


@query(MADE_SQL + " " + KNOWN)
def well_known_entries(spark, sf):
    return A.known_walk(made_archive_rows(spark, sf), made_entries(spark, sf), "W")


@query(MADE_SQL + f", u AS (SELECT archive, 'C' AS ns FROM e WHERE NOT regexp_matches(path, '^[MWX]/') UNION ALL SELECT archive, 'M' FROM e WHERE starts_with(path, 'M/') UNION ALL SELECT archive, 'W' FROM ({KNOWN})) SELECT archive, ns, count(*) AS n, CASE ns WHEN 'C' THEN 'Content' WHEN 'M' THEN 'Metadata' ELSE 'Well-known entries' END AS description FROM u GROUP BY archive, ns")
def namespaces_of_archives(spark, sf):
    return A.all_namespaces(made_archive_rows(spark, sf), made_entries(spark, sf))


@query("WITH e AS (SELECT p_partkey AS entry_id, 'C/' || replace(p_name, ' ', '_') || CASE p_size % 3 WHEN 0 THEN '.css' WHEN 1 THEN '' ELSE '?v=1' END AS path, CASE p_size % 5 WHEN 0 THEN 'image/png' ELSE 'text/html' END AS mime FROM part), x AS (SELECT *, ends_with(path, '.css') OR mime = 'image/png' AS asset FROM e WHERE entry_id >= 7), p AS (SELECT entry_id, path FROM x WHERE NOT asset ORDER BY entry_id LIMIT 12)"
 " SELECT entry_id, path, (SELECT count(*) FROM x WHERE asset AND entry_id < (SELECT max(entry_id) FROM p)) AS assets_filtered FROM p")
def content_entry_page(spark, sf):
    size = F.col("p_size")
    path = F.concat(F.lit("C/"), F.replace("p_name", F.lit(" "), F.lit("_")), F.when(size % 3 == 0, ".css").when(size % 3 == 1, "").otherwise("?v=1"))
    e = table(spark, sf, "part").select(F.col("p_partkey").alias("entry_id"), path.alias("path"), F.lit("C").alias("ns"), F.when(size % 5 == 0, "image/png").otherwise("text/html").alias("mimetype"))
    return A.content_page(e, "C", 12, 7)


@query(MADE_SQL + " SELECT archive, 8 AS entries, 0 AS redirects, 0 AS empty FROM a")
def archive_health(spark, sf):
    return Engine(made_entries(spark, sf).withColumns({"title": F.col("path"), "mimetype": F.lit("text/plain"), "redirect_to": F.lit(None).cast("string")})).health()


KINDS = ("text/html", "text/plain; charset=utf-8", "image/png", None)


@query(f"""WITH p AS (SELECT p_partkey AS path, {sql_list(KINDS)}[p_partkey % 4 + 1] AS mime, p_name FROM part) SELECT path, CASE WHEN mime LIKE 'text/html%' THEN 'page' WHEN mime LIKE 'text/%' THEN 'text' ELSE 'other' END AS kind,
 CASE WHEN mime LIKE 'text/html%' THEN '# ' || p_name || chr(10) || chr(10) || '**' || p_name || '** done' WHEN mime LIKE 'text/%' THEN '<h1>' || p_name || '</h1><p><b>' || p_name || '</b> done</p>' ELSE '(Non-text content: ' || coalesce(mime, 'unknown') || ')' END AS text FROM p""")
def content_by_kind(spark, sf):
    html = F.concat(F.lit(" <h1>"), "p_name", F.lit("</h1><p><b>"), "p_name", F.lit("</b> done</p> "))
    e = table(spark, sf, "part").select(F.col("p_partkey").alias("path"), picked(KINDS, F.col("p_partkey")).alias("mimetype"), html.alias("html"))
    return HT.readable(e)


@query("SELECT n_nationkey, 'description' AS k, 'About ' || n_name AS v FROM nation UNION ALL SELECT n_nationkey, 'og:title', n_name FROM nation UNION ALL SELECT n_nationkey, 'keywords', 'a, b' FROM nation WHERE n_regionkey > 1")
def page_meta_tags(spark, sf):
    name = F.col("n_name")
    words = F.when(F.col("n_regionkey") > 1, "a, b").otherwise("")
    html = F.concat(F.lit('<head><meta charset="utf-8"><meta content="About '), name, F.lit('" name="Description"><META property=\'og:title\' content=\''), name, F.lit("'><meta name='keywords' content='"), words, F.lit("'><meta name='description' content='second'></head>"))
    return table(spark, sf, "nation").select("n_nationkey", F.explode(HT.meta_tags(html)).alias("k", "v"))


def zim_of_documents(spark, sf):
    """A folder of archives written by tasks: the documents in archives of some thousands, with a redirect to each that has a language."""
    d = docs_of(spark, sf)
    parts = max(1, -(-d.count() // 3000))
    d = d.select(F.concat(F.lit("docs-"), F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("string")).alias("archive"), F.lit("C").alias("namespace"), F.col("doc_id").cast("string").alias("path"), F.concat(F.lit("Title "), "doc_id").alias("title"), F.lit("text/plain").alias("mimetype"), F.lit(None).cast("string").alias("redirect_to"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"), "lang")
    to = d.where("lang is not null").select("archive", "namespace", F.concat_ws("-", F.lit("to"), "path").alias("path"), F.col("lang").alias("title"), F.lit(None).cast("string").alias("mimetype"), F.col("path").alias("redirect_to"), F.lit(None).cast("binary").alias("content"))
    return ZIM.write_archives(d.drop("lang").unionByName(to), Scratch(spark, "zim").root)


@query("SELECT 'C' AS namespace, CAST(doc_id AS VARCHAR) AS path, 'Title ' || doc_id AS title, 'text/plain' AS mimetype, false AS is_redirect, md5(coalesce(text, '')) AS body FROM documents UNION ALL SELECT 'C', 'to-' || doc_id, lang, NULL, true, NULL FROM documents WHERE lang IS NOT NULL")
def zim_entries(spark, sf):
    e = ZIM.read_archives(zim_of_documents(spark, sf))
    return e.select("namespace", "path", "title", "mimetype", "is_redirect", F.md5("content").alias("body"))


@query("SELECT CAST(sum(n) AS BIGINT) AS entries, 0 AS damaged, true AS whole FROM (SELECT count(*) + count(lang) AS n FROM documents)")
def zim_listing(spark, sf):
    """What the listing and the checksums of the archives say that the tasks wrote."""
    made = zim_of_documents(spark, sf)
    made = Scratch(spark, "zim-files").write(made, "files")
    folder = made.agg(F.min(F.regexp_replace("path", "/[^/]*$", ""))).first()[0]
    found = ZIM.list_archives(spark, folder) if folder else made.select("path").where("false")
    rows = found.select(F.element_at(F.split("path", "/"), -1).alias("file"), "path", "readable", "length").join(ZIM.check_archives(found), "path")
    rows = made.select(F.concat("archive", F.lit(".zim")).alias("file"), "entries", "bytes").join(rows, "file", "left")
    bad = ~F.coalesce(F.col("readable") & F.col("ok"), F.lit(False))
    return rows.agg(F.sum("entries").alias("entries"), F.count_if(bad).alias("damaged"), F.min(F.col("length") == F.col("bytes")).alias("whole"))


# Links.


@query(EDGES + """, d AS (SELECT target, count(*) AS n FROM edges GROUP BY target), m AS (SELECT target FROM d ORDER BY n DESC, target LIMIT 1)
SELECT e.source AS path, e.anchor, coalesce(d.n, 0) AS inbound_degree FROM edges e JOIN m ON e.target = m.target LEFT JOIN d ON d.target = e.source ORDER BY inbound_degree DESC, path LIMIT 10""")
def stored_link_graph(spark, sf):
    scratch = Scratch(spark, "graph")
    e = page_edges(spark, sf)
    GS.write_graph(e, f"{scratch.root}/links", "archive-1")
    edges, nodes = GS.open_graph(spark, f"{scratch.root}/links", "archive-1")
    top = L.inbound_degree(edges).orderBy(F.desc("inbound_degree"), "path").first()
    return GS.linkers(edges, nodes, top["path"] if top else "", 10)


@query(LINKS + """, e AS (SELECT DISTINCT target AS path, 'about ' || target AS title FROM links WHERE target IS NOT NULL AND contains(target, 'e')) SELECT page_id, pos, target, e.title AS target_title FROM links LEFT JOIN e ON e.path = target""")
def link_titles(spark, sf):
    links = page_links(spark, sf)
    e = links.where(F.contains("target", F.lit("e"))).select(F.col("target").alias("path"), F.concat(F.lit("about "), "target").alias("title")).distinct()
    return L.with_titles(links.select("page_id", "pos", "target"), e)


# HTML pages made of regions and nations, so that what they hold is known.

PAGES_SQL = """WITH r AS (SELECT r_regionkey AS k, r_name AS t FROM region), n AS (SELECT n_regionkey AS k, n_name AS t, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) AS i FROM nation)"""


def made_pages(spark, sf):
    """A page a region: a heading with an id, an infobox, a media link, and a section for each nation, every other one with an anchor before its heading."""
    n = table(spark, sf, "nation").withColumn("i", F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_name")))
    part = F.concat(F.when(F.col("i") % 2 == 0, F.concat(F.lit('<a name="at-'), F.col("i").cast("string"), F.lit('"></a>'))).otherwise(F.lit("")), F.lit("<h2>"), "n_name", F.lit("</h2><p>Text about "), "n_name", F.lit(". <a href='"), "n_name", F.lit("'>x</a></p>"))
    body = n.groupBy("n_regionkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", part.alias("p")))), lambda x: x["p"]), "").alias("body"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", F.concat(F.lit("<tr><th>Nation "), F.col("i").cast("string"), F.lit("</th><td>"), "n_name", F.lit("</td></tr>")).alias("p")))), lambda x: x["p"]), "").alias("rows"))
    r = table(spark, sf, "region").join(body, F.col("r_regionkey") == F.col("n_regionkey"))
    key = F.col("r_regionkey").cast("string")
    page = F.concat(F.lit("<html><head><title>"), "r_name", F.lit('</title></head><body><nav>menu</nav><h1 id="top-'), key, F.lit('">'), "r_name", F.lit('</h1><table class="infobox"><tr><th>Members</th></tr>'), "rows", F.lit('</table><p><a href="pics/'), key, F.lit('.png">pic</a> <a href="http://e.org">out</a> <img src="i'), key, F.lit('.jpg" alt="seen"></p>'), "body", F.lit("</body></html>"))
    return r.select(F.col("r_regionkey").alias("page_id"), page.alias("html"))


def made_bundles(spark, sf):
    return HT.bundles(made_pages(spark, sf))


SLUG = "regexp_replace(regexp_replace(trim(lower(t)), '\\s+', '-', 'g'), '[^\\p{L}\\p{N}_-]', '', 'g')"


@query(PAGES_SQL + f" SELECT k AS page_id, 0 AS pos, 1 AS level, 'top-' || k AS id, t AS title, NULL AS parent_id, 'id' AS id_source FROM r UNION ALL SELECT k, CAST(i AS INTEGER), 2, CASE WHEN i % 2 = 0 THEN 'at-' || i ELSE {SLUG} END, t, 'top-' || k, CASE WHEN i % 2 = 0 THEN 'preceding_anchor' ELSE 'slug' END FROM n")
def page_headings(spark, sf):
    b = made_bundles(spark, sf).select("page_id", F.posexplode("sections").alias("pos", "s"))
    return b.select("page_id", "pos", "s.level", "s.id", "s.title", "s.parent_id", "s.id_source")


@query(PAGES_SQL + " SELECT k AS page_id, t AS title, 'Text about ' || t || '. [x](' || t || ')' AS preview, CAST(3 + len(string_split(t, ' ')) AS BIGINT) AS words FROM n")
def page_section_views(spark, sf):
    return HT.section_views(made_bundles(spark, sf)).where("level = 2").select("page_id", "title", "preview", "words")


@query(PAGES_SQL + " SELECT k AS page_id, count(*) + 1 AS n_headings, 2 AS max_depth FROM n GROUP BY k")
def page_depths(spark, sf):
    return HT.depths(made_bundles(spark, sf))


@query(PAGES_SQL + " SELECT k AS page_id, CAST(i - 1 AS INTEGER) AS pos, 'Members — Nation ' || i AS label, t AS value FROM n")
def page_infobox(spark, sf):
    return made_bundles(spark, sf).select("page_id", F.posexplode("infobox").alias("pos", "x")).select("page_id", "pos", "x.label", "x.value")


@query(PAGES_SQL + " SELECT k AS page_id, 'i' || k || '.jpg' AS url, 'seen' AS text FROM r")
def page_media(spark, sf):
    return made_bundles(spark, sf).select("page_id", F.explode("links").alias("l")).where("l.kind = 'media'").select("page_id", "l.url", "l.text")


@query(PAGES_SQL + " SELECT k AS page_id, count(*) AS internal, 1 AS external, 2 AS media, 0 AS anchor FROM n GROUP BY k")
def page_link_buckets(spark, sf):
    rows = made_bundles(spark, sf).select("page_id", F.explode("links").alias("l")).select("page_id", F.col("l.kind").alias("kind"), U.resolved(F.col("l.url"), F.lit("w/p")).alias("target"))
    return L.bucket_totals(rows, "page_id")


@query(PAGES_SQL + " SELECT k AS page_id, t AS title, '## ' || t || chr(10) || chr(10) || 'Text about ' || t || '. [x](' || t || ')' || chr(10) || chr(10) AS text FROM n WHERE i = 2")
def page_section_fetch(spark, sf):
    return HT.section(made_bundles(spark, sf), "at-2").select("page_id", "title", "text")


@query(PAGES_SQL + """, h AS (SELECT k, '## ' || t || chr(10) || chr(10) || 'Text about ' || t || '. [x](' || t || ')' || chr(10) || chr(10) AS md FROM n WHERE i = 1), o AS (SELECT k, t, '# ' || t || chr(10) || chr(10) || CASE WHEN k % 2 = 0 THEN '[pic](pics/' || k || '.png) [out](http://e.org)' || chr(10) || chr(10) ELSE '' END AS own FROM r)
SELECT k AS page_id, t AS title, 1 AS level, own || CASE WHEN length(own) <= 20 THEN md ELSE '' END AS text, length(own) <= 20 AS widened FROM o JOIN h USING (k)""")
def page_section_alone(spark, sf):
    key = F.concat(F.lit("top-"), F.col("page_id").cast("string"))
    # Every other page has no text between its first two headings.
    bare = F.when(F.col("page_id") % 2 == 1, F.regexp_replace("html", '<p><a href="pics.*?</p>', "")).otherwise(F.col("html"))
    b = HT.bundles(made_pages(spark, sf).withColumn("html", bare)).withColumn("sections", F.transform("sections", lambda s: F.when(s["id"] == key, s.withField("id", F.lit("top"))).otherwise(s)))
    return HT.section(b, "top", subsections=False).select("page_id", "title", "level", "text", "widened")


@query(PAGES_SQL + f" SELECT k AS page_id, 'section_not_found' AS reason, count(*) + 1 AS n_sections, 'at-2' AS closest FROM n GROUP BY k")
def page_section_closest(spark, sf):
    return HT.closest_sections(made_bundles(spark, sf), "AT-22")


@query(PAGES_SQL + " SELECT r.k AS page_id, '# ' || r.t || chr(10) || chr(10) || '[pic](pics/' || r.k || '.png) [out](http://e.org)' AS lead, (SELECT string_agg('- ' || n.t, chr(10) ORDER BY n.i) FROM n WHERE n.k = r.k) AS contents FROM r")
def page_lead(spark, sf):
    return HT.lead_with_contents(made_bundles(spark, sf))


@query(PAGES_SQL + " SELECT k AS page_id, '# ' || t || ' [pic](pics/' || k || '.png) [out](http://e.org)' AS summary FROM r")
def page_summary(spark, sf):
    b = made_bundles(spark, sf)
    # The first heading's section is the whole page, so pages are cut where their second heading begins.
    lead = b.withColumn("sections", F.transform("sections", lambda s: s.withField("char_end", F.least(s["char_end"], F.coalesce(F.get("sections", F.lit(1))["char_start"], s["char_end"])))))
    return HT.summary(lead, 60)


@query(RANKED + f", q AS (SELECT list_distinct(regexp_extract_all(lower('{QUERY}'), '[\\p{{L}}\\p{{N}}]+')) AS w), x AS (SELECT doc_id, rn, round(len(list_intersect(w, regexp_extract_all(lower(substr(text, 1, 512)), '[\\p{{L}}\\p{{N}}]+'))) / len(w), 6) AS rerank_score FROM t, q) SELECT *, row_number() OVER (ORDER BY rerank_score DESC, rn) AS new_rn FROM x")
def rerank_page(spark, sf):
    return S.rerank(S.page(hits_of(spark, sf, "text"), 20), QUERY, "text").select("doc_id", "rn", "rerank_score", "new_rn")


LADDER_KEY = "regexp_replace(lower(trim(regexp_replace(regexp_replace(regexp_extract(split_part(split_part({0}, '?', 1), '#', 1), '([^/]*)/*$', 1), '\\.(html?|md|php)$', ''), '[_.+-]+', ' ', 'g'))), '[^\\p{{L}}\\p{{N}}]+', '', 'g')"


@query("WITH e AS (SELECT p_partkey AS entry_id, 'C/' || replace(p_name, ' ', '_') || '_' || p_partkey AS path FROM part), r AS (SELECT entry_id * 4 + i AS idx, CASE i WHEN 0 THEN path WHEN 1 THEN '/' || path WHEN 2 THEN upper(replace(substr(path, 3), '_', '-')) || '.html' ELSE '../' || path END AS path FROM e, (SELECT unnest([0, 1, 2, 3]) AS i)),"
 f" k AS (SELECT entry_id, path, {LADDER_KEY.format('path')} AS k FROM e) SELECT idx, r.path, CASE idx % 4 WHEN 0 THEN idx // 4 WHEN 1 THEN idx // 4 WHEN 2 THEN (SELECT min(entry_id) FROM k WHERE k.k = {LADDER_KEY.format('r.path')}) END AS entry_id, CASE idx % 4 WHEN 0 THEN 'path' WHEN 1 THEN 'path' WHEN 2 THEN CASE WHEN (SELECT min(entry_id) FROM k WHERE k.k = {LADDER_KEY.format('r.path')}) IS NOT NULL THEN 'search' END ELSE 'refused' END AS found_by FROM r")
def fetch_by_ladder(spark, sf):
    e = table(spark, sf, "part").select(F.col("p_partkey").alias("entry_id"), F.concat(F.lit("C/"), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"), F.col("p_partkey").cast("string")).alias("path"))
    path = F.col("path")
    forms = F.array(path, F.concat(F.lit("/"), path), F.concat(F.upper(F.replace(F.substring(path, F.lit(3), F.length(path)), F.lit("_"), F.lit("-"))), F.lit(".html")), F.concat(F.lit("../"), path))
    r = e.select("entry_id", F.posexplode(forms).alias("i", "path")).select((F.col("entry_id") * 4 + F.col("i")).alias("idx"), "path")
    return A.fetch_ladder(r, e)


@query(PAGES_SQL + " SELECT k AS page_id, t AS title, 0 AS found FROM r")
def page_title_bundle(spark, sf):
    b = made_bundles(spark, sf)
    return b.select("page_id", "title", F.instr("markdown", F.lit("menu")).alias("found"))


HEADS = ("Music and dance", "Microfilm", "Notable people", "Film", "Sports teams", "Content", "History", "Local politics", "Musicians", "", "Literature", "Government")
ASKED = ("famous musician from ", "notable ", "actors in ", "music of the ", "People of ", "", "politicians and authors ", "persons ", "Customer scientists ")


@query(f"""WITH a AS (SELECT c_custkey AS k, c_name AS title, {sql_list(ASKED)}[c_custkey % {len(ASKED)} + 1] || c_name AS topic FROM customer), h AS (SELECT o_custkey AS k, o_orderkey AS pos, 2 + CAST(o_orderkey % 3 = 0 AS INTEGER) AS level, {sql_list(HEADS)}[o_orderkey % {len(HEADS)} + 1] AS section FROM orders),
v AS (SELECT unnest({[(s, i, n) for s, names in SJ.SUBJECTS.items() if s not in SJ.WEAK for i, n in enumerate(names)]}) AS v), s AS (SELECT *, list_filter(regexp_extract_all(lower(topic), '[a-z0-9]+'), lambda t: list_contains({[x for x in SJ.SUBJECTS if x not in SJ.WEAK]}, t) AND NOT list_contains(regexp_extract_all(lower(title), '[a-z0-9]+'), t))[1] AS subject FROM a)
SELECT k AS page_id, topic, title, subject, m.pos, m.section FROM (SELECT s.*, arg_min(struct_pack(pos := h.pos, section := h.section), v[2] * 1000000000000 + h.pos) AS m FROM s JOIN v ON v[1] = subject JOIN h ON h.k = s.k AND h.level = 2 AND h.section NOT IN ('', 'Content') AND regexp_matches(lower(h.section), '\\b' || lower(v[3]) || '\\b') GROUP BY ALL)""")
def subject_sections(spark, sf):
    a = table(spark, sf, "customer").select(F.col("c_custkey").alias("page_id"), F.concat(picked(ASKED, F.col("c_custkey")), "c_name").alias("topic"), F.col("c_name").alias("title"))
    h = table(spark, sf, "orders").select(F.col("o_custkey").alias("page_id"), F.col("o_orderkey").alias("pos"), (2 + (F.col("o_orderkey") % 3 == 0).cast("int")).alias("level"), picked(HEADS, F.col("o_orderkey")).alias("title"))
    return SJ.subject_sections(a, h, "page_id")


BITS = ("recieve", "(Goverment's)", "the", "'seperate'", "Bilogy.", "recieved", "truely,", "«existance»", "embarass's", "red", "millenium", "parralel")
WRONG = {k: v for k, v in MISSPELLINGS.items()}


@query(f"""WITH r AS (SELECT p_partkey AS id, {sql_list(BITS)}[p_partkey % {len(BITS)} + 1] || '  ' || p_name || chr(9) || {sql_list(BITS)}[p_partkey // {len(BITS)} % {len(BITS)} + 1] AS query FROM part), m AS (SELECT unnest({list(WRONG.items())}) AS m),
t AS (SELECT id, generate_subscripts(regexp_extract_all(query, '\\s+|\\S+'), 1) AS pos, unnest(regexp_extract_all(query, '\\s+|\\S+')) AS token FROM r), c AS (SELECT *, lower(token) AS low, regexp_extract(lower(token), '^[^\\p{{L}}\\p{{N}}_]*') AS a, regexp_extract(lower(token), '[^\\p{{L}}\\p{{N}}_]*$') AS z FROM t),
d AS (SELECT *, substr(low, length(a) + 1, greatest(length(low) - length(a) - length(z), 0)) AS core FROM c), e AS (SELECT *, CASE WHEN suffix(core, chr(39) || 's') THEN chr(39) || 's' ELSE '' END AS own FROM d), f AS (SELECT *, CASE WHEN own <> '' THEN left(core, length(core) - 2) ELSE core END AS word FROM e),
g AS (SELECT id, pos, CASE WHEN m IS NOT NULL AND word <> 'truely' AND NOT (low IN ('millenium', 'red')) THEN a || m[2] || own || z ELSE token END AS t FROM f LEFT JOIN m ON m[1] = word)
SELECT id, query, string_agg(t, '' ORDER BY pos) AS respelt FROM g JOIN r USING (id) GROUP BY id, query""")
def misspelling_rewrite(spark, sf):
    """Thousands of requests with misspelt words in signs and possessives; one word is excluded and one is a title."""
    r = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.concat(picked(BITS, F.col("p_partkey")), F.lit("  "), "p_name", F.lit("\t"), picked(BITS, F.floor(F.col("p_partkey") / len(BITS)))).alias("query"))
    wrong = spark.createDataFrame(list(WRONG.items()), "word string, spelling string")
    titles = table(spark, sf, "part").select(F.col("p_name").alias("title")).unionByName(spark.createDataFrame([("Millenium",), ("red",)], "title string"))
    return RP.respelt(r, wrong, titles, spark.createDataFrame([("truely",)], "word string"))


# Streams: the same plans over files that arrive.


@query(EDGES + ", kept AS (SELECT edges.* FROM edges JOIN (SELECT path, max(page_id) AS m FROM links GROUP BY path) p ON p.path = edges.source WHERE p.m % 3 <> 0) SELECT target AS path, CAST(count(*) AS BIGINT) AS inbound_degree FROM kept GROUP BY target")
def stream_link_graph(spark, sf):
    """Degrees after two batches: all pages, and then those of every third path again, without links."""
    scratch = Scratch(spark, "graph")
    links = page_links(spark, sf).select("page_id", "path", "pos", "anchor", "target")
    every = links.groupBy("path").agg(F.max("page_id").alias("m"))
    pages = scratch.write(links.select("path", "pos", "anchor", "target"), "links")
    again = every.where("m % 3 = 0").select("path", F.lit(0).alias("pos"), F.lit(None).cast("string").alias("anchor"), F.lit(None).cast("string").alias("target"))
    for i, part in enumerate((pages, again)):
        part.coalesce(1).write.mode("append").parquet(f"{scratch.root}/in/{i}")
        stream = spark.readStream.schema(pages.schema).parquet(f"{scratch.root}/in/*")
        G.build(stream, lambda b: L.edges(b), f"{scratch.root}/graph", f"{scratch.root}/checkpoint").awaitTermination()
    return G.degrees_of(spark, f"{scratch.root}/graph")


def event_stream(spark, sf, scratch):
    """The events as a stream of files, each micro-batch one file."""
    table(spark, sf, "events").repartition(3).write.parquet(f"{scratch.root}/events")
    return spark.readStream.schema(table(spark, sf, "events").schema).option("maxFilesPerTrigger", 1).parquet(f"{scratch.root}/events")


def streamed(spark, frame, scratch, name, mode):
    """What a stream has written when it has read all its input."""
    last = {}

    def keep(batch, batch_id):
        last["df"] = scratch.write(batch, f"{name}-{batch_id}")

    q = frame.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{scratch.root}/checkpoint-{name}").trigger(availableNow=True).start()
    q.awaitTermination()
    return last["df"]


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def stream_tumbling(spark, sf):
    scratch = Scratch(spark, "stream")
    out = streamed(spark, W.tumbling(event_stream(spark, sf, scratch), late="3650 days"), scratch, "tumbling", "complete")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 2).alias("total"))


@query("WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS no FROM e) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS \"end\", count(*) AS n FROM s GROUP BY user_id, no")
def stream_sessions(spark, sf):
    scratch = Scratch(spark, "stream")
    out = streamed(spark, W.sessions(event_stream(spark, sf, scratch), "6 hours", "3650 days"), scratch, "sessions", "complete")
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@query("""WITH a AS (SELECT user_id, max(ts) AS m, count(*) AS n FROM events WHERE event_type <> 'error' GROUP BY user_id), b AS (SELECT user_id, max(ts) AS m, count(*) AS n FROM events WHERE event_type <> 'click' GROUP BY user_id)
SELECT 0 AS batch, CAST(user_id AS VARCHAR) AS path, 'added' AS change FROM a UNION ALL SELECT 1, CAST(coalesce(a.user_id, b.user_id) AS VARCHAR), CASE WHEN a.user_id IS NULL THEN 'added' WHEN b.user_id IS NULL THEN 'removed' ELSE 'changed' END FROM a FULL JOIN b USING (user_id) WHERE a.user_id IS NULL OR b.user_id IS NULL OR a.m <> b.m OR a.n <> b.n""")
def stream_snapshot_changes(spark, sf):
    """Two snapshots arrive one after the other; what each changes is published."""
    scratch = Scratch(spark, "watch")
    events = table(spark, sf, "events")
    snap = lambda kind: events.where(F.col("event_type") != kind).groupBy(F.col("user_id").cast("string").alias("path")).agg(F.max("ts").alias("mtime"), F.count("*").alias("size"))
    done = []
    for i, kind in enumerate(("error", "click")):
        snap(kind).coalesce(1).write.parquet(f"{scratch.root}/in/{i}")
        stream = spark.readStream.schema(snap(kind).schema).parquet(f"{scratch.root}/in/*")
        q = W.watch(stream, lambda df, b: done.append(scratch.write(df.withColumn("batch", F.lit(b).cast("int")), f"changes-{b}")), f"{scratch.root}/state", f"{scratch.root}/checkpoint")
        q.awaitTermination()
    return done[0].unionByName(done[1]).select("batch", "path", "change")
