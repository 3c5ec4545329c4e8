"""Title promotion: the gates a candidate title must pass, as expressions, and the passes that find one.

Gates read the columns ``topic``, ``path`` (of the candidate), ``title``, ``match_type``
(direct, redirect, fuzzy_suggest, typo_corrected) and ``pre_redirect_path``.  Tokens are
lower-cased runs of letters and digits that may hold apostrophes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textquarry.functions import text as T
from textquarry.operators import titles as TI
from textquarry.session import small

# Results depend on these patterns and word lists.
TOKEN = r"[\p{L}\p{N}]+(?:['’][\p{L}\p{N}]+)*"
WORD = r"[\p{L}\p{N}]+"
POSSESSIVE = r"([\p{L}\p{N}]{1,64})['’](?:s\b|\B)"
LOAD_BEARING = "+#*&?!"
FUNCTION_WORDS = "a an the and or but nor of in on at to from by with for as into onto over under".split()
STOP_WORDS = (
    "what when where who whom whose which why how a an the and or but nor yet of in on at to from by with as into onto over under about "
    "is are was were be been being have has had do does did will would shall should may might can could "
    "i me my we us our you your he him his she her it its they them their this that these those "
    "please kindly also too very just really live lived lives make makes made"
).split()


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(0))


def words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(0))


def bare(path: Column) -> Column:
    """A path without its namespace letter."""
    return F.regexp_replace(path, r"^[\p{L}\p{N}]/", "")


def name_of(path: Column, title: Column | None = None) -> Column:
    """What a candidate is called: its path, or the title (without its site) where the path is a URL."""
    if title is None:
        return bare(path)
    own = F.replace(T.without_site(F.coalesce(title, F.lit(""))), F.lit(" "), F.lit("_"))
    return F.when(path.rlike(r"(?i)^[a-z0-9-]+(\.[a-z0-9-]+)+/") & (own != ""), own).otherwise(bare(path))


def is_possessive(topic: Column) -> Column:
    return topic.rlike(POSSESSIVE)


def possessors(topic: Column) -> Column:
    return F.regexp_extract_all(F.lower(topic), F.lit(POSSESSIVE), F.lit(1))


def _smears(topic: Column, path: Column) -> Column:
    count = lambda c, mark: F.length(c) - F.length(F.replace(c, F.lit(mark), F.lit("")))
    out = F.lit(False)
    for mark in LOAD_BEARING:
        out = out | (count(topic, mark) > count(path, mark))
    return out


def smeared(topic: Column, path: Column) -> Column:
    """Whether a mark that is part of a name was lost in the words of the topic that the path covers."""
    own = words(bare(path))
    met = F.array_join(F.filter(F.split(F.trim(topic), r"\s+"), lambda w: F.arrays_overlap(words(w), own)), " ")
    return _smears(F.when(met == "", topic).otherwise(met), path)


def possessive_ok(topic: Column, name: Column, match_type: Column, pre: Column) -> Column:
    """Topics with a possessive: direct hits pass; fuzzy ones must hold a possessor; a redirect's own words must all be the topic's, or the page hold a possessor."""
    held = F.arrays_overlap(possessors(topic), words(name))
    within = F.size(F.array_except(words(bare(pre)), words(topic))) == 0
    return F.when(match_type == "fuzzy_suggest", held).when(match_type == "redirect", within | held).otherwise(True)


def tail_hijack(topic: Column, name: Column, least: int = 3) -> Column:
    """A candidate of one token that is the last one of a topic of ``least`` tokens or more."""
    t, c = tokens(topic), tokens(name)
    return (F.size(t) >= least) & (F.size(c) == 1) & (F.get(c, F.lit(0)) == F.try_element_at(t, F.lit(-1)))


def base_ok(topic: Column, name: Column, match_type: Column, pre: Column) -> Column:
    """The gate that all promotions pass: possessives by their rule, others no hijack of the tail and no hit by stems alone."""
    t, c = tokens(topic), tokens(name)
    plain = (F.size(t) < 3) | (~tail_hijack(topic, name) & ((match_type != "fuzzy_suggest") | F.arrays_overlap(t, c)))
    return F.when(is_possessive(topic), possessive_ok(topic, name, match_type, pre)).otherwise(plain)


def tangential(topic: Column, name: Column) -> Column:
    """Both of two tokens or more, and the candidate has words of its own besides function words."""
    t, c = tokens(topic), tokens(name)
    own = F.array_except(c, F.array(*[F.lit(w) for w in FUNCTION_WORDS]))
    return (F.size(t) >= 2) & (F.size(c) >= 2) & (F.size(F.array_except(own, t)) > 0)


def same_digits(topic: Column, path: Column) -> Column:
    """Both the topic and what the candidate adds to it hold a digit."""
    has = lambda a: F.exists(a, lambda w: w.rlike("[0-9]"))
    t, c = tokens(topic), tokens(path)
    return has(t) & has(F.array_except(c, t))


def extends_run(topic: Column, name: Column) -> Column:
    """The candidate begins with a run of two or more of the topic's tokens and goes on with none of them."""
    t, c = tokens(topic), tokens(name)
    n = F.least(F.size(c), F.size(t))
    # A run of k tokens of the topic, from its start s on, equal to the first k of the candidate.
    runs = lambda k: F.exists(F.sequence(F.lit(1), F.greatest(F.size(t) - k + 1, F.lit(1))), lambda s: F.slice(t, s, k) == F.slice(c, F.lit(1), k))
    clean = lambda k: ~F.arrays_overlap(F.slice(c, k + 1, F.greatest(F.size(c) - k, F.lit(0))), t)
    return (n >= 2) & F.exists(F.sequence(F.lit(2), F.greatest(n, F.lit(2))), lambda k: clean(k) & runs(k))


def z4(topic: Column, path: Column, name: Column, same_page: Column) -> Column:
    """The gate against tangential titles; ``same_page``: a token of the topic that is one of the path names the same page."""
    exempt = same_page | same_digits(topic, path) | extends_run(topic, name)
    return ~smeared(topic, path) & (is_possessive(topic) | ~tangential(topic, name) | exempt)


def tail_ok(topic: Column, path: Column, name: Column, match_type: Column, pre: Column, others: Column, same_page: Column) -> Column:
    """The gate of titles found by a part of the topic; ``others``: further tokens of the topic that are titles."""
    base = base_ok(topic, name, match_type, pre)
    rest = F.when(base, z4(topic, path, name, same_page)).otherwise(tail_hijack(topic, name) & (others < 2))
    return ~smeared(topic, path) & F.when(is_possessive(topic), base).otherwise(rest)


def strong_canonical(topic: Column, path: Column, title: Column) -> Column:
    """A strong match of path or title, but not by a disambiguation page that the topic does not ask for."""
    twin = lambda c: F.lower(c).rlike(r"[_ ](\(disambiguation\)|%28disambiguation%29)\s*$")
    asked = F.lower(topic).contains("disambiguation")
    return (asked | ~(twin(path) | twin(title))) & (T.strong_form(topic, path) | T.strong_form(topic, title))


def _topic_tokens(topics: DataFrame, titles: DataFrame) -> DataFrame:
    """topic, token, pos, last, path: the titles that are single tokens of the topics, and hold them."""
    rows = topics.select("topic", F.posexplode(tokens(F.col("topic"))).alias("pos", "token")).withColumn("last", F.size(tokens(F.col("topic"))) - 1)
    rows = rows.where(~F.col("token").isin(STOP_WORDS))
    named = titles.select("ord", "path", "pre", F.explode(F.array_distinct(F.array(F.lower("title"), F.lower(T.site_title(F.col("title")))))).alias("token"))
    return named.join(small(rows), "token").where(F.array_contains(tokens(F.col("path")), F.col("token")) | F.array_contains(tokens(F.coalesce("pre", F.lit(""))), F.col("token")))


def promote(topics: DataFrame, titles: DataFrame, passes: tuple[int, ...] = (0, 1, 2, 3)) -> DataFrame:
    """topic, pass, ord, path, title, match_type, score: for each topic the title that is put before its hits, if any.

    ``titles`` has path, title, ``ord`` (order of the archives) and ``pre`` (the path of the redirect that
    led here, null for none).  Passes: the whole topic; its tails, longest first; runs
    elsewhere in it; its tails with one typo.  The first that passes its gate wins.
    Every pass is a join of a few short strings with the titles.
    """
    topics = topics.select("topic").distinct()
    least = F.when(is_possessive(F.col("topic")), 2).otherwise(1)
    parts = [topics.select("topic", F.lit(0).alias("pass"), F.lit(0).alias("place"), F.col("topic").alias("probe"))]
    grams = topics.select("topic", least.alias("least"), tokens(F.col("topic")).alias("t")).withColumn("n", F.size("t")).where("n > 0")
    runs = grams.select("topic", "least", "t", "n", F.explode(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(4)))).alias("len")).where("len >= least")
    gram = lambda start: F.array_join(F.slice("t", start, F.col("len")), " ")
    tails = runs.select("topic", F.explode(F.array(F.lit(1), F.lit(3))).alias("pass"), (F.lit(4) - F.col("len")).alias("place"), gram(F.col("n") - F.col("len") + 1).alias("probe"))
    inner = runs.where("len < n").select("topic", "t", "n", "len", F.explode(F.sequence(F.lit(1), F.col("n") - F.col("len"))).alias("start"))
    parts += [tails, inner.select("topic", F.lit(2).alias("pass"), ((F.lit(4) - F.col("len")) * 1000 + F.col("start")).cast("int").alias("place"), gram(F.col("start")).alias("probe"))]
    probes = parts[0]
    for p in parts[1:]:
        probes = probes.unionByName(p)
    probes = probes.where(F.col("pass").isin(*passes))
    # One lookup for all probes; typos count in the last pass only, redirects under their own name.
    keyed = titles.withColumn("__key", F.struct("ord", "path", F.coalesce("pre", F.lit("")).alias("pre")))
    found = TI.lookup(keyed.select(F.col("__key").alias("id"), "title", F.coalesce("pre", "path").alias("path")), probes.select(F.col("probe").alias("topic")), key="id")
    found = found.select(F.col("topic").alias("probe"), "key.ord", "key.path", F.nullif(F.col("key.pre"), F.lit("")).alias("pre"), "score", "match_type")
    found = found.withColumn("match_type", F.when(F.col("pre").isNotNull() & (F.col("match_type") != "typo_corrected"), "redirect").otherwise(F.col("match_type")))
    bar = F.when(F.col("pass") == 0, 0.95).when(F.col("pass") == 3, 0.8).otherwise(1.0)
    rows = probes.join(found, "probe").where((F.col("score") >= bar) & ~_smears(F.col("probe"), F.col("path")))
    rows = rows.join(titles.groupBy("ord", "path").agg(F.min("title").alias("title")), ["ord", "path"])
    hits = _topic_tokens(topics, titles)
    others = hits.where("pos < last").groupBy("topic").agg(F.count_distinct("token").alias("others"))
    pages = hits.select("topic", "ord", "path", "token").where(F.array_contains(tokens(F.col("path")), F.col("token"))).select("topic", "ord", "path", F.lit(True).alias("same")).distinct()
    rows = rows.join(others, "topic", "left").join(pages, ["topic", "ord", "path"], "left")
    topic, path, pre = F.col("topic"), F.col("path"), F.coalesce("pre", "path")
    name, same, other = name_of(path, F.col("title")), F.coalesce("same", F.lit(False)), F.coalesce("others", F.lit(0))
    by_part = tail_ok(topic, path, name, F.col("match_type"), pre, other, same)
    whole = base_ok(topic, name, F.col("match_type"), pre) & z4(topic, path, name, same)
    rows = rows.where(F.when(F.col("pass").isin(1, 2), by_part).otherwise(whole))
    best = F.min(F.struct("pass", "place", (-F.col("score")).alias("s"), "ord", "path", "title", "match_type")).alias("b")
    return rows.groupBy("topic").agg(best).select("topic", "b.pass", "b.ord", "b.path", "b.title", "b.match_type", (-F.col("b.s")).alias("score"))
