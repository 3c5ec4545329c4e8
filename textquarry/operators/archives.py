"""Entries of archives: namespaces, pages of entries, metadata, types, presets, fetches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textquarry.functions import urls as U
from textquarry.session import few, small

# Descriptions of namespaces, and marks of archive types.
NAMESPACES = {"A": "Articles", "C": "Content", "I": "Images", "M": "Metadata", "W": "Well-known entries", "X": "Search indexes", "-": "Layout"}
QUESTION_HOSTS = ("stackexchange.com", "superuser.com", "serverfault.com", "askubuntu.com", "stackoverflow.com", "mathoverflow.net")
HTML_MARKS = ("<!doctype html", "<html", "<head", "<title>")
METADATA_CAP = 800
WELL_KNOWN = ("W/index", "W/robots.txt", "W/exception.html", "W/404.html")


def pages_as_entries(pages: DataFrame) -> DataFrame:
    """entry_id, archive (host), path (host and path), ns (first segment), title, html of crawled pages."""
    path = U.url_path(F.col("url"))
    seg = F.split_part(U.canonical(path), F.lit("/"), F.lit(2))
    title = F.trim(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1))
    return pages.select(F.col("page_id").alias("entry_id"), U.host(F.col("url")).alias("archive"), path.alias("path"), seg.alias("ns"), title.alias("title"), "html")


def namespace_inventory(entries: DataFrame, samples: int = 5) -> DataFrame:
    """ns, n, samples: entries of each namespace and the paths of its first ones.

    Counts are partial sums; samples are ranked under a group limit, so no group is gathered.
    """
    counts = entries.groupBy("ns").agg(F.count("*").alias("n"))
    w = Window.partitionBy("ns").orderBy("entry_id")
    first = entries.select("ns", "entry_id", "path").withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= samples)
    lists = first.groupBy("ns").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "path"))), lambda x: x["path"]), "|").alias("samples"))
    return counts.join(lists, "ns")


def namespace_projection(entries: DataFrame, every: int = 4, least: int = 3) -> DataFrame:
    """ns, sampled, projected: totals projected from the share of ids divisible by ``every``; exact where too few."""
    hit = F.col("entry_id") % every == 0
    rows = entries.groupBy("ns").agg(F.count_if(hit).alias("sampled"), F.count("*").alias("n"))
    return rows.select("ns", "sampled", F.when(F.col("sampled") >= least, F.greatest(F.col("sampled") * every, F.col("sampled"))).otherwise(F.col("n")).alias("projected"))


def browse(entries: DataFrame, ns: str, limit: int, offset: int = 0) -> DataFrame:
    """A page of a namespace in path order."""
    return entries.where(F.col("ns") == ns).select("entry_id", "path").orderBy("path", "entry_id").offset(offset).limit(limit)


def walk(entries: DataFrame, scan_at: int, limit: int) -> DataFrame:
    """The next entries by id from ``scan_at`` on; the filter reaches the scan (keyset paging)."""
    return entries.where(F.col("entry_id") >= scan_at).select("entry_id", "path").orderBy("entry_id").limit(limit)


def fetch(requests: DataFrame, entries: DataFrame) -> DataFrame:
    """idx, path, entry_id, success: each request by its raw, decoded or un-rooted spelling, in that order.

    A few requests are sent to all tasks; many are merged with the entries.
    """
    return _fetch(requests, entries, _way(requests))


def _way(requests: DataFrame) -> str:
    """How requests meet entries: a hint for joins."""
    return "broadcast" if few(requests) else "merge"


def _fetch(requests: DataFrame, entries: DataFrame, way: str) -> DataFrame:
    spelt = F.array(*[F.struct(F.lit(i).alias("prio"), c.alias("k")) for i, c in enumerate((F.col("path"), F.coalesce(F.try_url_decode("path"), F.col("path")), F.regexp_replace("path", "^/+", "")))])
    asked = requests.select("idx", "path", F.explode(spelt).alias("s")).select("idx", "path", "s.prio", "s.k")
    hits = entries.select(F.col("path").alias("k"), "entry_id").join(asked.hint(way), "k").groupBy("idx").agg(F.min(F.struct("prio", "entry_id")).getField("entry_id").alias("entry_id"))
    return requests.join(hits, "idx", "left").select("idx", "path", "entry_id", F.col("entry_id").isNotNull().alias("success"))


def fetch_ladder(requests: DataFrame, entries: DataFrame) -> DataFrame:
    """idx, path, entry_id, found_by: as ``fetch``, and where no spelling is a path, the entry whose last segment reads the same.

    Refused paths (``urls.climbs``) are not looked up; found_by is path, search, refused or null.
    """
    safe = requests.where(~U.climbs(F.col("path")))
    way = _way(requests)
    direct = _fetch(safe, entries, way)
    lost = direct.where("not success").select("idx", "path").withColumn("k", U.path_key(F.col("path"))).where("k <> ''")
    near = entries.select("entry_id", U.path_key(F.col("path")).alias("k")).join(lost.hint(way), "k").groupBy("idx").agg(F.min("entry_id").alias("near"))
    rows = requests.join(direct.select("idx", "entry_id"), "idx", "left").join(near, "idx", "left")
    by = F.when(U.climbs(F.col("path")), "refused").when(F.col("entry_id").isNotNull(), "path").when(F.col("near").isNotNull(), "search")
    return rows.select("idx", "path", F.coalesce("entry_id", "near").alias("entry_id"), by.alias("found_by"))


def binary(entries: DataFrame, cap: int, content: str = "html") -> DataFrame:
    """entry_id, size, truncated, data: base64 of contents of at most ``cap`` bytes."""
    size = F.octet_length(F.col(content)).cast("long")
    return entries.select("entry_id", size.alias("size"), (size > cap).alias("truncated"), F.when(size <= cap, F.regexp_replace(F.base64(F.col(content).cast("binary")), r"\s", "")).alias("data"))


def archive_type(archives: DataFrame) -> DataFrame:
    """archive, type, confidence from ``scraper``, ``name``, ``title``, ``creator`` and ``tags``: the first rule that holds.

    Only the scraper gives high confidence.  The host is what stands before the first ``_`` of the name.
    """
    scraper, name, title, creator, tags = (F.lower(F.trim(F.coalesce(F.col(c), F.lit("")))) for c in ("scraper", "name", "title", "creator", "tags"))
    host = F.split_part(name, F.lit("_"), F.lit(1))
    about = lambda word: tags.contains(word) | creator.contains(word)
    rules = (
        (scraper.startswith("sotoki"), "stackexchange", "high"), (scraper.startswith("ted2zim"), "ted", "high"),
        (scraper.startswith("mwoffliner") & (name.startswith("wiktionary") | title.contains("wiktionary")), "wiktionary", "high"), (scraper.startswith("mwoffliner"), "wikipedia", "high"),
        (name.startswith("wikipedia"), "wikipedia", "medium"), (name.startswith("wiktionary"), "wiktionary", "medium"), (name.rlike("^ted[_-]"), "ted", "medium"),
        (host.isin(*QUESTION_HOSTS) | host.endswith(".stackexchange.com"), "stackexchange", "medium"), (creator.contains("stack exchange") | tags.contains("stackexchange"), "stackexchange", "medium"),
        (about("wiktionary"), "wiktionary", "medium"), (about("wikipedia"), "wikipedia", "medium"),
    )
    first = F.coalesce(*[F.when(test, F.struct(F.lit(kind).alias("type"), F.lit(sure).alias("confidence"))) for test, kind, sure in rules], F.struct(F.lit("generic").alias("type"), F.lit("none").alias("confidence")))
    return archives.select("archive", first.alias("t")).select("archive", "t.type", "t.confidence")


def effective_preset(types: DataFrame, pins: DataFrame, by_type: DataFrame) -> DataFrame:
    """archive, preset: a pin beats the type's preset, which needs high confidence; else ``default``."""
    typed = types.join(small(by_type.select("type", F.col("preset").alias("__t"))), "type", "left")
    both = typed.join(pins.select("archive", F.col("preset").alias("__p")), "archive", "left")
    return both.select("archive", F.coalesce("__p", F.when(F.col("confidence") == "high", F.col("__t")), F.lit("default")).alias("preset"))


def distilled(value: Column, cap: int = METADATA_CAP) -> Column:
    """A metadata value as shown: of an HTML page its title, else its text; at most ``cap`` characters, then a note."""
    title = F.regexp_extract(value, r"(?is)<title[^>]*>(.*?)</title>", 1)
    body = value
    for tag in ("script", "style", "head"):
        body = F.regexp_replace(body, rf"(?is)<{tag}\b.*?</{tag}>", " ")
    body = F.regexp_replace(body, r"(?s)<[^>]*>", " ")
    clean = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    low = F.lower(F.substring(value, 1, 512))
    page = F.lit(False)
    for mark in HTML_MARKS:
        page = page | low.contains(mark)
    shown = F.when(page, F.when(clean(title) != "", clean(title)).otherwise(clean(body))).otherwise(value)
    note = F.concat(F.rtrim(F.substring(shown, 1, cap)), F.lit("… [truncated, "), F.format_number(F.length(shown), 0), F.lit(" chars total]"))
    return F.when(F.length(shown) > cap, note).otherwise(shown)


def metadata_entries(entries: DataFrame, key: str | None = None) -> DataFrame:
    """archive, key, value of the readable entries of the M namespace (``M/<key>`` or, with ``key``, this one), distilled."""
    path = F.col("path")
    rows = entries.where(path == f"M/{key}") if key is not None else entries.where(path.startswith("M/") & ~path.startswith("M/Illustration_"))
    return rows.select("archive", F.substring(path, F.lit(3), F.length(path)).alias("key"), distilled(F.coalesce("html", F.lit(""))).alias("value"))


def known_walk(archives: DataFrame, entries: DataFrame, namespace: str) -> DataFrame:
    """archive, path of the entries of M or W: the metadata keys, or the main page, favicon and fixed paths there are.

    ``archives`` has main_path (null: none) and has_illustration.
    """
    if namespace == "M":
        return entries.where(F.col("path").startswith("M/")).select("archive", "path")
    main = archives.where("main_path is not null").select("archive", F.lit("W/mainPage").alias("path"))
    icon = archives.where("has_illustration").select("archive", F.lit("W/favicon").alias("path"))
    return main.unionByName(icon).unionByName(entries.where(F.col("path").isin(list(WELL_KNOWN))).select("archive", "path"))


def all_namespaces(archives: DataFrame, entries: DataFrame) -> DataFrame:
    """archive, ns, n, description: content entries, metadata keys and well-known entries of each archive."""
    content = entries.where(~F.col("path").rlike("^[MWX]/")).select("archive", F.lit("C").alias("ns"))
    rows = content
    for ns in "MW":
        rows = rows.unionByName(known_walk(archives, entries, ns).select("archive", F.lit(ns).alias("ns")))
    described = F.create_map(*[F.lit(x) for kv in NAMESPACES.items() for x in kv])
    return rows.groupBy("archive", "ns").agg(F.count("*").alias("n")).withColumn("description", described[F.col("ns")])


def content_page(entries: DataFrame, ns: str, limit: int, scan_at: int = 0, mimetype: str = "mimetype") -> DataFrame:
    """A page of articles by id from ``scan_at`` on, with ``assets_filtered``: the assets passed over on the way.

    The page's last id bounds the count, which is one filtered sum over the ids before it.
    """
    rows = entries.where((F.col("ns") == ns) & (F.col("entry_id") >= scan_at)).withColumn("asset", U.is_asset(F.col("path"), F.col(mimetype)))
    page = rows.where("not asset").select("entry_id", "path").orderBy("entry_id").limit(limit)
    end = page.agg(F.max("entry_id").alias("end"))
    # One row on each side.
    passed = rows.where("asset").join(F.broadcast(end), F.col("entry_id") < F.col("end")).agg(F.count("*").alias("assets_filtered"))
    return page.join(F.broadcast(passed))


def metadata_map(entries: DataFrame) -> DataFrame:
    """archive, metadata: readable keys of the M namespace as a map."""
    rows = entries.where(F.col("path").startswith("M/") & ~F.col("path").startswith("M/Illustration_"))
    pair = F.struct(F.substring(F.col("path"), F.lit(3), F.length("path")).alias("key"), F.col("html").alias("value"))
    return rows.groupBy("archive").agg(F.map_from_entries(F.array_sort(F.collect_set(pair))).alias("metadata"))


def sample(entries: DataFrame, n: int, seed: str = "") -> DataFrame:
    """``n`` entries in the order of a seeded hash: the same ones on every run."""
    return entries.select("entry_id", "path").orderBy(F.md5(F.concat(F.lit(seed), "path", F.col("entry_id").cast("string"))), "entry_id").limit(n)


def main_page(archives: DataFrame, entries: DataFrame) -> DataFrame:
    """archive, path, found_by: the archive's main path, else ``C/mainPage``, ``A/index.html`` or the first entry."""
    tries = F.array(*[F.struct(F.lit(i).alias("prio"), c.alias("path")) for i, c in enumerate((F.col("main_path"), F.lit("C/mainPage"), F.lit("A/mainPage"), F.lit("A/index.html")))])
    asked = archives.select("archive", F.explode(tries).alias("t")).select("archive", "t.prio", "t.path").where("path is not null")
    hit = entries.select("archive", "path").join(small(asked), ["archive", "path"]).groupBy("archive").agg(F.min(F.struct("prio", "path")).alias("h"))
    first = entries.groupBy("archive").agg(F.min(F.struct("entry_id", "path")).alias("f"))
    rows = archives.select("archive").join(hit, "archive", "left").join(first, "archive", "left")
    return rows.select("archive", F.coalesce("h.path", "f.path").alias("path"), F.when(F.col("h.prio") == 0, "main").when(F.col("h.prio").isNotNull(), "usual name").when(F.col("f").isNotNull(), "first entry").alias("found_by"))
