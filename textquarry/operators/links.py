"""The link graph: extraction, edges, degrees, inbound, related, redirects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.functions import urls as U

REDIRECT_DEPTH = 10


def outbound(pages: DataFrame, html: str = "html", path: str = "path") -> DataFrame:
    """All anchors of each page in document order: columns of ``pages`` but the html, and pos, href, anchor, kind, target."""
    hits = F.regexp_extract_all(F.col(html), F.lit(U.HREF), F.lit(0))
    rows = pages.select(*[c for c in pages.columns if c != html], F.posexplode(hits).alias("pos", "__a"))
    rows = rows.withColumns({"href": F.regexp_extract("__a", U.HREF, 1), "anchor": F.trim(F.regexp_extract("__a", U.HREF, 2))}).drop("__a")
    return rows.withColumns({"kind": U.link_kind(F.col("href")), "target": U.resolved(F.col("href"), F.col(path))})


def edges(links: DataFrame, source: str = "path", within: tuple[str, ...] = ()) -> DataFrame:
    """source, target, anchor: internal links to articles, once for each pair, with the first anchor text.

    ``within`` names columns, such as the archive, that a link does not leave.
    """
    kept = links.where("target is not null").where((F.col(source) != F.col("target")) & ~U.is_asset(F.col("target")))
    return kept.groupBy(*within, F.col(source).alias("source"), "target").agg(F.min(F.struct("pos", "anchor")).getField("anchor").alias("anchor"))


def inbound_degree(edges_: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """path, inbound_degree: of all targets, or of all ``nodes`` (path), with 0 for those never linked."""
    degree = edges_.groupBy(F.col("target").alias("path")).agg(F.count("*").alias("inbound_degree"))
    return degree if nodes is None else nodes.select("path").distinct().join(degree, "path", "left").withColumn("inbound_degree", F.coalesce("inbound_degree", F.lit(0)))


def inbound(edges_: DataFrame, target: str, limit: int = 10, offset: int = 0) -> DataFrame:
    """The pages that link ``target``, most linked first, then by path: path, anchor, inbound_degree."""
    linkers = edges_.where(F.col("target") == target).select(F.col("source").alias("path"), "anchor")
    ranked = linkers.join(inbound_degree(edges_), "path", "left").withColumn("inbound_degree", F.coalesce("inbound_degree", F.lit(0)))
    return ranked.orderBy(F.desc("inbound_degree"), "path").offset(offset).limit(limit)


def related(links: DataFrame, source: str = "path") -> DataFrame:
    """source, target, mentions, anchor, first_pos: how often each page mentions each article."""
    kept = links.where("target is not null").where(~U.is_asset(F.col("target")))
    first = F.min(F.struct("pos", "anchor"))
    return kept.groupBy(F.col(source).alias("source"), "target").agg(F.count("*").alias("mentions"), first.getField("anchor").alias("anchor"), first.getField("pos").alias("first_pos"))


def kind_totals(links: DataFrame, source: str = "path") -> DataFrame:
    """Anchors of each page by kind."""
    of = lambda k: F.count_if(F.col("kind") == k).alias(k)
    return links.groupBy(source).agg(of("internal"), of("external"), of("anchor"), of("skip"))


def with_media(links: DataFrame) -> DataFrame:
    """Links whose internal target is an asset as links of the kind ``media``: an image in an anchor is no article."""
    return links.withColumn("kind", F.when((F.col("kind") == "internal") & F.coalesce(U.is_asset(F.col("target")), F.lit(False)), "media").otherwise(F.col("kind")))


def bucket_totals(links: DataFrame, source: str = "path") -> DataFrame:
    """Links of each page by bucket: internal, external, media, anchor."""
    of = lambda k: F.count_if(F.col("kind") == k).alias(k)
    return with_media(links).groupBy(source).agg(of("internal"), of("external"), of("media"), of("anchor"))


def with_titles(links: DataFrame, entries: DataFrame, within: tuple[str, ...] = ()) -> DataFrame:
    """``links`` with the title of the entry each target names (null: no such entry)."""
    return links.join(entries.select(*within, F.col("path").alias("target"), F.col("title").alias("target_title")), [*within, "target"], "left")


def resolve_redirects(entries: DataFrame, path: str = "path", to: str = "redirect_to", depth: int = REDIRECT_DEPTH, within: tuple[str, ...] = ()) -> DataFrame:
    """path, canonical, hops, state: where each path ends after at most ``depth`` redirects.

    ``within`` names columns, such as the archive, that come first and that a redirect does not leave.
    Pointers of the redirects alone are doubled, so four joins follow ten hops; ``state`` is ok, dangling (the target
    does not exist), or unresolved (a cycle or too long a chain: the path itself stays).
    """
    table = entries.select(*within, F.col(path).alias("path"), F.col(to).alias("next"))
    # Only redirects are followed: (path, here, next, hops), where ``next`` is null once ``here`` is no redirect.
    jump = table.where("next is not null").select(*within, "path", F.col("next").alias("here"), F.lit(1).alias("hops"))
    done = 1
    while done < depth:
        # Pointers double: what k hops lead to is looked up among what the same hops lead to from there.
        step = jump.select(*within, F.col("path").alias("here"), F.col("here").alias("far"), F.col("hops").alias("more"))
        jump = jump.join(step, [*within, "here"], "left").select(*within, "path", F.coalesce("far", "here").alias("here"), (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops"))
        done *= 2
    ends = table.select(*within, F.col("path").alias("here"), F.lit(True).alias("exists"), F.col("next").isNotNull().alias("goes_on"))
    jump = jump.join(ends, [*within, "here"], "left")
    # A cycle never ends, so its rows go on beyond the depth, as those of longer chains do.
    long = (F.col("hops") > depth) | F.coalesce("goes_on", F.lit(False))
    jump = jump.select(*within, "path", F.when(long, F.col("path")).otherwise(F.col("here")).alias("canonical"), F.least("hops", F.lit(depth)).alias("hops"), F.when(long, "unresolved").when(F.col("exists").isNull(), "dangling").otherwise("ok").alias("state"))
    own = table.where("next is null").select(*within, "path", F.col("path").alias("canonical"), F.lit(0).alias("hops"), F.lit("ok").alias("state"))
    return own.unionByName(jump)
