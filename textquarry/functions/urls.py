"""Namespaces, canonical paths, links and assets as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textquarry.functions.text import ASSET_EXTENSIONS, ASSET_MIME_PREFIXES, ASSET_MIMES

HREF = r'<a [^>]*href="([^"]*)"[^>]*>([^<]*)'
SKIPPED_SCHEMES = r"(?i)^(javascript|mailto|tel|data|blob|vbscript):"


def canonical(path: Column) -> Column:
    """A path without query and fragment."""
    return F.split_part(F.split_part(path, F.lit("?"), F.lit(1)), F.lit("#"), F.lit(1))


def url_path(url: Column) -> Column:
    """Host and path of a URL, as the path of an entry."""
    return F.regexp_replace(url, "^[a-z]+://", "")


def host(url: Column) -> Column:
    return F.regexp_extract(url, "^[a-z]+://([^/?#]+)", 1)


def namespace(path: Column, new_scheme: Column | None = None) -> Column:
    """The first segment of a path, or its first letter; ``Unknown`` of nothing; ``C`` in the new scheme."""
    old = F.when(F.length(path) == 0, F.lit("Unknown")).when(F.instr(path, "/") > 1, F.split_part(path, F.lit("/"), F.lit(1))).otherwise(F.substring(path, 1, 1))
    return old if new_scheme is None else F.when(new_scheme, F.lit("C")).otherwise(old)


def canonical_namespace(name: Column) -> Column:
    """Long names as letters; one letter in upper case; anything else as it is."""
    n = F.lower(F.trim(name))
    return (
        F.when(n == "content", "C").when(n == "metadata", "M").when(n.isin("wellknown", "well-known"), "W").when(n.isin("search", "index"), "X")
        .when((F.length(n) == 1) & n.rlike("[a-z]"), F.upper(n)).otherwise(name)
    )


def link_kind(href: Column) -> Column:
    """skip, anchor, external or internal."""
    return F.when(href.rlike(SKIPPED_SCHEMES) | (F.trim(href) == ""), "skip").when(href.startswith("#"), "anchor").when(href.rlike("(?i)^(https?:)?//"), "external").otherwise("internal")


def resolved(href: Column, base: Column) -> Column:
    """The entry path of an internal href seen from the page ``base``; null where there is none.

    ``.`` and ``..`` are applied, a rooted href starts at the root, and query and fragment go.
    """
    bare = canonical(href)
    folder = F.when(bare.startswith("/"), F.lit("")).otherwise(F.regexp_replace(base, "[^/]*$", ""))
    parts = F.split(F.concat(folder, bare), "/")
    step = lambda acc, p: F.when(p.isin("", "."), acc).when(p == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p)))
    path = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")
    path = F.when(bare.endswith("/") & (path != ""), F.concat(path, F.lit("/"))).otherwise(path)
    return F.when((link_kind(href) == "internal") & ~bare.isin("", ".", "./", "/"), F.nullif(path, F.lit("")))


def is_asset(path: Column, mimetype: Column | None = None) -> Column:
    """Whether a target is no article: by a MIME type of assets if there is one, else by its extension."""
    by_name = F.lower(canonical(path)).rlike(r"\.(" + "|".join(ASSET_EXTENSIONS) + ")$")
    if mimetype is None:
        return by_name
    kind = F.lower(F.trim(F.split_part(mimetype, F.lit(";"), F.lit(1))))
    by_mime = kind.isin(ASSET_MIMES)
    for p in ASSET_MIME_PREFIXES:
        by_mime = by_mime | kind.startswith(p)
    return F.coalesce(by_mime, F.lit(False)) | by_name


def is_content_source(path: Column, new_scheme: Column) -> Column:
    """Whether links are taken from an entry: those of A and C in the old scheme, any that has a path in the new one."""
    return F.when(new_scheme, F.length(path) > 0).otherwise(path.rlike("^[AC]/."))


def parse_counter(c: Column) -> Column:
    """``mime=n;mime=n`` as a map; a MIME type may itself hold ``;`` and ``=``."""
    found = F.regexp_extract_all(c, F.lit(r"([^=;]+(?:;\s*[^=;]+=[^=;]+?)*)=(\d+)(?:;|$)"), F.lit(0))
    pair = lambda x: F.struct(F.regexp_extract(x, r"^(.*)=(\d+);?$", 1).alias("key"), F.regexp_extract(x, r"^(.*)=(\d+);?$", 2).cast("long").alias("value"))
    return F.map_from_entries(F.transform(found, pair))


def normal_path(path: Column) -> Column:
    """A path as entries spell it: trimmed, one slash between segments, none in front."""
    return F.regexp_replace(F.regexp_replace(F.trim(path), "/+", "/"), "^/", "")


def climbs(path: Column) -> Column:
    """Whether a path, as it is or decoded, has a ``..`` segment or a drive, and must be refused."""
    bad = r"(^|[/\\])\.\.([/\\]|$)|^[A-Za-z]:[/\\]|\x00"
    return path.rlike(bad) | F.coalesce(F.try_url_decode(path).rlike(bad), F.lit(False))


def search_terms(path: Column) -> Column:
    """What to search for when no entry has a path: its last segment without namespace, extension and marks."""
    name = F.regexp_replace(F.regexp_extract(canonical(path), "([^/]*)/*$", 1), r"\.(html?|md|php)$", "")
    return F.trim(F.regexp_replace(F.coalesce(F.try_url_decode(name), name), r"[_\-.+]+", " "))


def path_key(c: Column) -> Column:
    """What is left of a path without case, marks, namespace and extension."""
    return F.regexp_replace(F.lower(F.regexp_replace(search_terms(c), r"^[A-Za-z-]/", "")), r"[^\p{L}\p{N}]+", "")


def same_path(a: Column, b: Column) -> Column:
    """Whether two paths name one entry: without case, marks, namespace and extension."""
    return (path_key(a) != "") & (path_key(a) == path_key(b))
