"""HTML pages as bundles: text, headings, sections, links and infobox, in one parse.

A page becomes a tree (``page_tree``), its article markdown (``markdown``); pages are handled
batch by batch in Arrow.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textquarry.functions import text as T
from textquarry.functions.markdown import Markdown
from textquarry.functions.page_tree import Node, main_content, parse, without_furniture
from textquarry.functions.snippets import slugify

MEDIA = {"img": "src", "video": "src", "audio": "src", "source": "src", "embed": "src", "object": "data"}

SECTION = "struct<id:string,title:string,level:int,char_start:int,char_end:int,parent_id:string,id_source:string>"
LINK = "struct<kind:string,url:string,text:string,pos:int>"
BUNDLE = f"title string, markdown string, word_count int, char_count int, sections array<{SECTION}>, links array<{LINK}>, infobox array<struct<label:string,value:string>>"


def link_kind(href: str) -> str:
    low = href.strip().lower()
    if not low or re.match(r"(javascript|mailto|tel|data|blob|vbscript):", low):
        return "skip"
    if low.startswith("#"):
        return "anchor"
    return "external" if re.match(r"(https?:)?//", low) else "internal"


def _visible(node: Node, hidden: bool = False) -> Iterator[tuple[Node, bool]]:
    """All elements in document order, and whether they stand in one that is no text."""
    todo = [(node, hidden)]
    while todo:
        n, h = todo.pop()
        if n.parent is not None:
            yield n, h
        todo += [(c, h or n.hidden) for c in reversed(n.children) if isinstance(c, Node)]


def _links(root: Node) -> list[dict]:
    """Anchors of the whole page and media that are shown, in document order; ``pos`` counts all anchors."""
    out, pos = [], 0
    for n, hidden in _visible(root):
        if n.tag in MEDIA and n.attrs.get(MEDIA[n.tag]) and not hidden and not n.hidden:
            out.append({"kind": "media", "url": n.attrs[MEDIA[n.tag]], "text": n.attrs.get("alt") or "", "pos": pos})
            pos += 1
        elif n.tag == "a" and "href" in n.attrs:
            kind = link_kind(n.attrs["href"])
            if kind != "skip":
                out.append({"kind": kind, "url": n.attrs["href"], "text": " ".join(n.text().split()), "pos": pos})
            pos += 1
    return out


def _identity(heading: Node, before: str | None) -> tuple[str | None, str]:
    """The id of a heading and where it is from: its own, one inside it, an anchor before it, or none."""
    if heading.attrs.get("id"):
        return heading.attrs["id"], "id"
    inside = next((n.attrs["id"] for n in heading.nodes() if n.attrs.get("id")), None)
    if inside:
        return inside, "descendant_anchor"
    return (before, "preceding_anchor") if before else (None, "slug")


def bundle(html: str | None, cut_entities: bool = True) -> dict:
    """The bundle of one page; all fields are empty for a null."""
    root = parse(html or "", cut_entities)
    article, landmark = main_content(root)
    page = Markdown(without_furniture(article) if landmark else set())
    page.children(article)
    page.finish()
    text = page.text()
    title = next((n.text() for n in root.nodes() if n.tag == "title"), "")
    sections, seen, stack = [], {}, []
    for i, (node, start) in enumerate(page.headings):
        level, name = int(node.tag[1]), " ".join(node_text(node).split())
        before = next((a for a, n in reversed(page.anchors) if n == i), None)
        own, source = _identity(node, before)
        ident = own or slugify(name) or f"section-{i + 1}"
        seen[ident] = seen.get(ident, 0) + 1
        if seen[ident] > 1:
            ident = f"{ident}_{seen[ident]}"
        while stack and stack[-1][0] >= level:
            stack.pop()
        end = next((at for g, at in page.headings[i + 1 :] if int(g.tag[1]) <= level), len(text))
        sections.append({"id": ident, "title": name, "level": level, "char_start": start, "char_end": end, "parent_id": stack[-1][1] if stack else None, "id_source": source if name or own else "none"})
        stack.append((level, ident))
    return {"title": " ".join(title.split()), "markdown": text, "word_count": len(text.split()), "char_count": len(text), "sections": sections, "links": _links(root), "infobox": [{"label": a, "value": b} for a, b in page.infobox]}


def node_text(node: Node) -> str:
    """The words of a heading, without what is hidden in it."""
    return "".join(c if isinstance(c, str) else "" if c.hidden else " " if c.tag == "br" else node_text(c) for c in node.children)


def keys(key: str | list[str]) -> list[str]:
    """The columns that tell pages apart."""
    return [key] if isinstance(key, str) else list(key)


def bundles(pages: DataFrame, html: str = "html", key: str | list[str] = "page_id", cut_entities: bool = True) -> DataFrame:
    """The key columns and those of ``BUNDLE`` for each page; ``cut_entities`` as in ``page_tree.parse``."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    own = keys(key)
    schema = ", ".join([f"`{k}` {pages.schema[k].dataType.simpleString()}" for k in own] + [BUNDLE])
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), 200):
                part = batch.slice(a, 200)
                rows = [bundle(x, cut_entities) for x in part.column(len(own)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(own)], *[pa.array([r[f.name] for r in rows], f.type) for f in list(arrow)[len(own) :]]], schema=arrow)

    return pages.select(*own, html).mapInArrow(parse, schema)


def section_text(markdown: Column, section: Column) -> Column:
    """The text of one section of a bundle."""
    return F.substring(markdown, section["char_start"] + 1, section["char_end"] - section["char_start"])


NARROW = 20


def section(bundles_: DataFrame, section_id: str, key: str | list[str] = "page_id", subsections: bool = True, max_chars: int = 100_000) -> DataFrame:
    """key, title, level, parent_id, text, char_count, truncated, widened of the section with an id on each page that has it.

    Without subsections the text ends at the next heading; where that leaves no more than the
    heading itself (``NARROW`` characters) and a subsection follows, it goes on to that one's end.
    """
    at = F.array_position(F.transform("sections", lambda s: s["id"]), section_id).cast("int")
    rows = bundles_.withColumn("__i", at).where("__i > 0").withColumn("__s", F.element_at("sections", F.col("__i")))
    own = F.col("__s")
    later = F.filter(F.slice("sections", F.col("__i") + 1, F.size("sections")), lambda s: s["char_start"] > own["char_start"])
    rows = rows.withColumns({"__n": F.get(later, F.lit(0)), "__m": F.get(later, F.lit(1))})
    narrow = F.least(own["char_end"], F.coalesce(F.col("__n.char_start"), own["char_end"]))
    widened = (narrow - own["char_start"] <= NARROW) & F.coalesce(F.col("__n.level") > own["level"], F.lit(False))
    # The first subsection, up to the heading after it.
    child = F.least(F.col("__n.char_end"), F.coalesce(F.col("__m.char_start"), F.col("__n.char_end")))
    end = own["char_end"] if subsections else F.when(widened, child).otherwise(narrow)
    text = F.substring("markdown", own["char_start"] + 1, end - own["char_start"])
    rows = rows.select(*keys(key), own["title"].alias("title"), own["level"].alias("level"), own["parent_id"].alias("parent_id"), text.alias("__t"), (widened if not subsections else F.lit(False)).alias("widened"))
    return rows.select(*keys(key), "title", "level", "parent_id", F.substring("__t", 1, max_chars).alias("text"), F.least(F.length("__t"), F.lit(max_chars)).alias("char_count"), (F.length("__t") > max_chars).alias("truncated"), "widened")


def closest_sections(bundles_: DataFrame, section_id: str, key: str | list[str] = "page_id", share: float = 0.6) -> DataFrame:
    """key, reason, n_sections, closest of the pages without a section of an id: the id that is most like it, in any letter case."""
    ids = F.transform("sections", lambda s: s["id"])
    like = lambda i: 1 - F.levenshtein(F.lower(i), F.lit(section_id.lower())) / F.greatest(F.length(i), F.lit(len(section_id)))
    best = F.array_max(F.transform(ids, lambda i: F.struct(like(i).alias("s"), i.alias("id"))))
    rows = bundles_.where(~F.array_contains(ids, section_id))
    return rows.select(*keys(key), F.when(F.size("sections") == 0, "no_headings").otherwise("section_not_found").alias("reason"), F.size("sections").cast("long").alias("n_sections"), F.when(best["s"] >= share, best["id"]).alias("closest"))


def table_of_contents(bundles_: DataFrame, key: str | list[str] = "page_id") -> DataFrame:
    """A row for each section: key, pos, level, id, title, parent_id, words."""
    rows = bundles_.select(*keys(key), "markdown", F.posexplode("sections").alias("pos", "s"))
    return rows.select(*keys(key), "pos", "s.level", "s.id", "s.title", "s.parent_id", F.regexp_count(section_text(F.col("markdown"), F.col("s")), F.lit(r"\S+")).alias("words"))


def section_views(bundles_: DataFrame, key: str | list[str] = "page_id", size: int = 300) -> DataFrame:
    """A row for each section: key, pos, level, id, title, preview (``size`` characters after the heading line, white space squeezed), words."""
    rows = bundles_.select(*keys(key), "markdown", F.posexplode("sections").alias("pos", "s"))
    text = section_text(F.col("markdown"), F.col("s"))
    body = F.trim(F.regexp_replace(F.regexp_replace(text, r"^#+ [^\n]*\n?", ""), r"\s+", " "))
    return rows.select(*keys(key), "pos", "s.level", "s.id", "s.title", F.substring(body, 1, size).alias("preview"), F.regexp_count(body, F.lit(r"\S+")).cast("long").alias("words"))


def depths(bundles_: DataFrame, key: str | list[str] = "page_id") -> DataFrame:
    """key, n_headings, max_depth."""
    return bundles_.select(*keys(key), F.size("sections").cast("long").alias("n_headings"), F.coalesce(F.array_max(F.transform("sections", lambda s: s["level"])), F.lit(0)).alias("max_depth"))


def structure(bundles_: DataFrame, key: str | list[str] = "page_id", size: int = 300) -> DataFrame:
    """key, content: each page as JSON: title, word count, headings with their ids, and sections with a preview and words."""
    text = lambda s: F.trim(F.regexp_replace(F.regexp_replace(section_text(F.col("markdown"), s), r"^#+ [^\n]*\n?", ""), r"\s+", " "))
    heads = F.transform("sections", lambda s: F.struct(s["level"].alias("level"), s["title"].alias("text"), s["id"].alias("id"), s["id_source"].alias("id_source")))
    parts = F.transform("sections", lambda s: F.struct(s["title"].alias("title"), s["level"].alias("level"), F.substring(text(s), 1, size).alias("content_preview"), F.regexp_count(text(s), F.lit(r"\S+")).alias("word_count")))
    return bundles_.select(*keys(key), F.to_json(F.struct("title", "word_count", heads.alias("headings"), parts.alias("sections"))).alias("content"))


def meta_tags(html: Column) -> Column:
    """The meta tags of a page as a map of their name or property to their content; the first of a name counts."""
    tags = F.regexp_extract_all(html, F.lit(r"(?is)<meta\b[^>]*>"), F.lit(0))
    value = lambda t, names: F.regexp_extract(t, rf'(?is)\b(?:{names})\s*=\s*["\']([^"\']*)["\']', 1)
    pairs = F.filter(F.transform(tags, lambda t: F.struct(F.lower(value(t, "name|property")).alias("k"), F.trim(value(t, "content")).alias("v"))), lambda p: (p["k"] != "") & (p["v"] != ""))
    keys = F.transform(pairs, lambda p: p["k"])
    return F.map_from_entries(F.filter(pairs, lambda p, i: F.array_position(keys, p["k"]) == i + 1))


def readable(entries: DataFrame, content: str = "html", mimetype: str = "mimetype", key: str = "path") -> DataFrame:
    """key, kind, text of each entry by its MIME type: pages as markdown, other texts trimmed, of the rest only what they are."""
    mime = F.coalesce(F.lower(F.col(mimetype)), F.lit(""))
    pages = bundles(entries.where(mime.startswith("text/html")), content, key).select(*keys(key), F.lit("page").alias("kind"), F.col("markdown").alias("text"))
    texts = entries.where(mime.startswith("text/") & ~mime.startswith("text/html")).select(*keys(key), F.lit("text").alias("kind"), F.trim(F.col(content)).alias("text"))
    rest = entries.where(~mime.startswith("text/")).select(*keys(key), F.lit("other").alias("kind"), F.concat(F.lit("(Non-text content: "), F.coalesce(mimetype, F.lit("unknown")), F.lit(")")).alias("text"))
    return pages.unionByName(texts).unionByName(rest)


#: Words of headings by which a style of summary picks its section.
STYLES = {"q_and_a": r"(?i)\b(accepted|best|top)?\s*answers?\b"}


def summary(bundles_: DataFrame, n_words: int = 200, key: str | list[str] = "page_id", style: str | None = None) -> DataFrame:
    """key, summary: the first words of the section that the style asks for, else of the page up to its first section's end.

    The answer of a question page loses the line of its votes.
    """
    end = F.coalesce(F.get("sections", F.lit(0))["char_end"], F.length("markdown"))
    text = F.substring(F.col("markdown"), F.lit(1), end)
    if style in STYLES:
        hit = F.get(F.filter("sections", lambda s: s["title"].rlike(STYLES[style])), F.lit(0))
        answer = F.regexp_replace(section_text(F.col("markdown"), hit), r"^#+ [^\n]*\n*", "")
        text = F.when(hit.isNotNull(), T.without_votes(F.concat(F.lit("\n"), answer))).otherwise(text)
    return bundles_.select(*keys(key), F.array_join(F.slice(F.split(F.regexp_replace(text, r"^\s+|\s+$", ""), r"\s+"), 1, n_words), " ").alias("summary"))


def lead_with_contents(bundles_: DataFrame, key: str | list[str] = "page_id") -> DataFrame:
    """key, lead, contents: the page up to its first heading of level 2 (the whole page without one), and a list of these headings."""
    second = F.filter("sections", lambda s: s["level"] == 2)
    lead = F.when(F.size(second) > 0, F.regexp_replace(F.substring(F.col("markdown"), F.lit(1), F.get(second, F.lit(0))["char_start"]), r"\s+$", "")).otherwise(F.col("markdown"))
    return bundles_.select(*keys(key), lead.alias("lead"), F.array_join(F.transform(second, lambda s: F.concat(F.lit("- "), s["title"])), "\n").alias("contents"))
