"""The engine's calls over an ``entries`` table: search, get, sections, browse, metadata, links, health, ask.

``entries`` has archive, entry_id, path, title, mimetype, redirect_to and html.  An entry is
told by its archive and path; redirects and links stay within their archive.  Frames
that many calls share (bundles, links, edges) are built once and persisted.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textquarry.functions import html as HT
from textquarry.functions import places as PL
from textquarry.functions import snippets as SN
from textquarry.functions import text as T
from textquarry.functions import urls as U
from textquarry.operators import archives as A
from textquarry.operators import index as IX
from textquarry.operators import links as L
from textquarry.operators import passages as P
from textquarry.operators import promotion as PM
from textquarry.operators import rerank as RR
from textquarry.operators import search as S
from textquarry.operators import synthesis as SY
from textquarry.operators import titles as TI
from textquarry.plans import language, paging
from textquarry.session import Scratch, small

MOST_PATHS = 50
#: What tells entries apart: a path names a page of one archive only.
KEY = ["archive", "path"]


class Engine:
    """Calls over one set of entries.  ``index`` names a folder with a stored index, or where to build one;
    ``scorer`` re-ranks passages (see ``operators.rerank``).

    What calls share is built at the first call that needs it and let go by ``close``.
    """

    def __init__(self, entries: DataFrame, index: str | None = None, scorer: Callable | None = None):
        self.entries = entries
        self.spark = entries.sparkSession
        self.scorer = scorer
        self._index, self._scratch = index, None

    @cached_property
    def bundles(self) -> DataFrame:
        """One parse of every HTML entry, kept for all calls."""
        pages = self.entries.where("redirect_to is null and html is not null and (mimetype is null or mimetype like 'text/html%')")
        return HT.bundles(pages.select(*KEY, "html"), key=KEY).persist()

    @cached_property
    def index(self) -> str:
        """The folder of the inverted index over the entries' texts; built if the given folder has none.

        A stored index tells what it was built from; one of other entries is refused.
        """
        path, wanted = self._index, None
        if path is None:
            self._scratch = Scratch(self.spark, "engine")
            path = f"{self._scratch.root}/index"
        else:
            wanted = IX.fingerprint(self.entries.select(*KEY, "mimetype", "redirect_to", "html"))
        if not IX.exists(self.spark, path):
            rows = self.bundles.select(F.struct(*KEY).alias("key"), T.without_links(F.col("markdown")).alias("text"))  # targets are no words of a page
            IX.build(rows, path, "text", "key", wanted)
        elif IX.built_from(self.spark, path) != wanted:
            raise ValueError(f"the index in {path} was built from other entries; name another folder")
        return path

    @cached_property
    def archives(self) -> DataFrame:
        """archive, ord: the archives in the order in which they are asked; one row an archive."""
        return self.entries.select("archive").distinct().withColumn("ord", F.dense_rank().over(Window.orderBy("archive")))

    @cached_property
    def titles(self) -> DataFrame:
        """archive, ord, path, title, pre: every title with the page it leads to; ``pre`` is the path of a redirect."""
        ends = self.entries.select(*KEY, "title").join(self.redirects.where("state = 'ok'"), KEY)
        rows = ends.select("archive", F.col("canonical").alias("path"), "title", F.when(F.col("hops") > 0, F.col("path")).alias("pre"))
        return rows.join(small(self.archives), "archive")

    def close(self) -> None:
        """Lets go of all frames and tables that calls shared."""
        for name in ("bundles", "redirects", "outbound", "edges"):
            if name in self.__dict__:
                self.__dict__.pop(name).unpersist()
        for name in ("index", "titles", "archives"):
            self.__dict__.pop(name, None)
        if self._scratch is not None:
            self._scratch.drop()

    @cached_property
    def redirects(self) -> DataFrame:
        return L.resolve_redirects(self.entries, within=("archive",)).persist()

    @cached_property
    def outbound(self) -> DataFrame:
        """The anchors of every page; targets are resolved within the archive and through its redirects."""
        rows = self.bundles.select(*KEY, F.posexplode("links").alias("pos", "l")).select(*KEY, "pos", F.col("l.url").alias("href"), F.col("l.text").alias("anchor"), F.col("l.kind").alias("kind"))
        rows = rows.withColumn("target", F.when(F.col("kind") == "internal", U.resolved(F.col("href"), F.col("path"))))
        end = self.redirects.select("archive", F.col("path").alias("target"), "canonical")
        return rows.join(end, ["archive", "target"], "left").withColumn("target", F.coalesce("canonical", "target")).drop("canonical").persist()

    @cached_property
    def edges(self) -> DataFrame:
        return L.edges(self.outbound, within=("archive",)).persist()

    def home_of(self, path: str, archive: str | None = None) -> str | None:
        """The archive that a path is asked of: the one given, else the first that has it."""
        if archive is not None:
            return archive
        return self.entries.where(F.col("path") == path).agg(F.min("archive")).first()[0]

    def _page(self, path: str, archive: str | None) -> DataFrame:
        home = self.home_of(path, archive)
        return self.bundles.where((F.col("path") == path) & (F.col("archive") == home))

    def ranked(self, query: str) -> DataFrame:
        """archive, path, title, mimetype, score of all entries that hold a word of the query, from the stored index."""
        hits = IX.search(self.spark, self.index, query).select("id.archive", "id.path", "score")
        return self.entries.select(*KEY, "title", "mimetype").join(hits, KEY)

    def search(self, query: str, mode: str = "fulltext", archive: str | None = None, namespace: str | None = None, content_type: str | None = None, limit: int = 10, offset: int = 0, per_archive: int | None = None):
        """A page of hits (path, title, snippet, score); the meta tells why it is empty or weak.

        Scores come from the index; only the rows of the page have their text read for a snippet.
        """
        if not S.parsed_query(query):
            return paging.Page([], 0, offset, limit, None, True, {"reason": "0_hits" if query.strip() else "bad_query"})
        if mode == "title":
            return self.find_title(query, limit)
        if mode == "suggest":
            return paging.take_page(TI.suggest(self.entries.where(~T.is_pseudo_entry(F.col("path"), F.col("title"))), query, limit, key="path"), "suggest", limit)
        where = F.lit(True)
        if namespace is not None:
            where = where & (U.namespace(F.col("path")) == U.canonical_namespace(F.lit(namespace)))
        if content_type is not None:
            where = where & F.coalesce(F.col("mimetype"), F.lit("")).startswith(content_type)
        hits = self.ranked(query)
        hits = hits if archive is None else hits.where(F.col("archive") == archive)
        order = F.struct((-F.col("score")).alias("s"), F.col("path").alias("p"))
        # A page counts once an archive; the same path in two archives is two pages.
        canon = S.canonical_first(hits.where(where).withColumn("canon", U.canonical(F.col("path"))).withColumn("__o", order), ["archive", "canon"], "__o").drop("canon", "__o")
        if per_archive is not None:
            canon = S.top_per_group(canon, "archive", per_archive, "path").drop("rn")
        canon = canon.persist()
        try:
            weak = S.weak_result(canon, query, "title").first()
            before = weak["hits"] if weak["hits"] or content_type is None else hits.count()
            known = namespace is None or weak["hits"] > 0 or not self.entries.where(U.namespace(F.col("path")) == U.canonical_namespace(F.lit(namespace))).isEmpty()
            page = paging.take_page(canon.select("archive", "path", "title", "score").orderBy(F.desc("score"), *KEY), "search", limit, offset, weak["hits"], q=query, ns=namespace)
        finally:
            canon.unpersist()
        page.results = self._with_snippets(page.results, query)
        why = paging.reason(query, weak["hits"], before, weak["strong"], known)
        if why:
            page.meta["reason"] = why
        if why in ("0_hits", "low_relevance"):
            page.meta["suggestions"] = self.recovery(query, why)
        return page

    def _with_snippets(self, rows: list, query: str) -> list:
        """The rows of a page with the snippet of each text."""
        if not rows:
            return rows
        asked = self.spark.createDataFrame([(r["archive"], r["path"]) for r in rows], "archive string, path string")
        texts = self.bundles.join(F.broadcast(asked), KEY).select(*KEY, SN.excerpt(query)("markdown").alias("snippet"))  # the rows of a page
        found = {(r["archive"], r["path"]): r["snippet"] for r in texts.collect()}
        make = Row("archive", "path", "title", "snippet", "score")
        return [make(r["archive"], r["path"], r["title"], found.get((r["archive"], r["path"])), r["score"]) for r in rows]

    def recovery(self, query: str, why: str, most: int = 5) -> list[dict]:
        """What to try after an empty or weak page: other titles, and archives named like a word of the query."""
        out = []
        if why == "0_hits":
            first = query.split()[0]
            rows = TI.suggest(self.entries.where(~T.is_pseudo_entry(F.col("path"), F.col("title"))), first, 3 * most, key="path").collect()
            names = dict.fromkeys(r["title"].replace("_", " ") for r in rows)
            out += [{"type": "alt_spelling", "value": n} for n in names if n.lower() != query.lower()][:most]
        names = [r["archive"] for r in self.entries.select("archive").distinct().orderBy("archive").collect()]
        return out + [{"type": "alt_archive", "value": a} for a in language.alternative_archives(query, names)]

    def find_title(self, title: str, limit: int = 10):
        """Entries that a title names, best tier first, each path of an archive once."""
        topic = self.spark.range(1).select(F.lit(title).alias("topic"))
        keyed = self.entries.select(F.struct("archive", "path").alias("id"), "archive", "path", "title")
        found = TI.results(TI.lookup(keyed.select("id", "title", "path"), topic), keyed, 1000)
        rows = found.select("archive", "path", "title", "score", "match_type").orderBy(F.desc("score"), "archive", "path")
        return paging.take_page(rows, "title", limit, total=found.count())

    def promoted(self, query: str) -> DataFrame:
        """archive, path, title of the page that a query names, by the gated passes of ``promotion``; one row or none."""
        topic = self.spark.range(1).select(F.lit(query).alias("topic"))
        return PM.promote(topic, self.titles).select("ord", "path", "title").join(self.archives, "ord").select(*KEY, "title")

    def get(self, paths: list[str], view: str = "full", content_offset: int = 0, max_chars: int = 100_000, style: str | None = None, archive: str | None = None) -> DataFrame:
        """idx, path, archive, found_by and the view (full, summary, toc, structure, lead, binary) of each asked entry, in the order asked.

        A path is looked up as it is, decoded, without its slash, then by its title among all titles; ``M/<key>`` gives a
        metadata value.  Without ``archive`` the first archive that has a path answers.  Redirects are followed within
        the archive.  At most ``MOST_PATHS`` a call.
        """
        if len(paths) > MOST_PATHS:
            raise ValueError(f"at most {MOST_PATHS} paths a call")
        asked = self.spark.range(1).select(F.posexplode(F.array(*[F.lit(p) for p in paths])).alias("idx", "path"))
        mine = self.entries if archive is None else self.entries.where(F.col("archive") == archive)
        # Entries are told apart by archive and id, so the first archive wins where several have a spelling.
        named = A.fetch_ladder(asked, mine.select("path", F.struct("archive", "entry_id").alias("entry_id")))
        named = named.select("idx", "path", "entry_id.archive", "entry_id.entry_id", "found_by")
        end = mine.select("archive", "entry_id", "path").join(self.redirects, KEY).select("archive", "entry_id", "canonical")
        named = named.join(end, ["archive", "entry_id"], "left")
        keyed = ["archive", "canonical"]
        b = self.bundles.withColumnRenamed("path", "canonical")
        if view == "summary":
            b = HT.summary(b, key=keyed, style=style).withColumnRenamed("summary", "content")
        elif view == "lead":
            b = HT.lead_with_contents(b, keyed).select(*keyed, F.concat_ws("\n\n", "lead", F.nullif("contents", F.lit(""))).alias("content"))
        elif view == "toc":
            b = b.select(*keyed, F.to_json("sections").alias("content"))
        elif view == "structure":
            b = HT.structure(b, keyed)
        elif view == "binary":
            ends = mine.select("archive", F.col("path").alias("canonical"), "mimetype", "html")
            data = A.binary(ends.select(F.struct(*keyed).alias("entry_id"), "html"), max_chars)
            b = data.select("entry_id.archive", "entry_id.canonical", F.col("data").alias("content"), "size", "truncated").join(ends.select(*keyed, "mimetype"), keyed)
        else:
            b = b.select(*keyed, F.substring(F.col("markdown"), F.lit(content_offset + 1), F.lit(max_chars)).alias("content"), "char_count")
        meta = A.metadata_entries(mine.where(F.col("path").isin(paths)))
        meta = meta.groupBy(F.concat(F.lit("M/"), "key").alias("path")).agg(F.min(F.struct("archive", "value")).getField("value").alias("__m"))
        rows = named.join(b, keyed, "left").join(meta, "path", "left")
        return rows.withColumn("content", F.coalesce("__m", "content")).withColumn("success", F.coalesce(F.col("found_by").isin("path", "search") | F.col("content").isNotNull(), F.lit(False))).drop("__m").orderBy("idx")

    def section(self, path: str, section_id: str, subsections: bool = True, archive: str | None = None) -> DataFrame:
        return HT.section(self._page(path, archive), section_id, KEY, subsections)

    def why_no_section(self, path: str, section_id: str, archive: str | None = None) -> DataFrame:
        """archive, path, reason, n_sections, closest: why a page has no section of an id, and the id most like it."""
        return HT.closest_sections(self._page(path, archive), section_id, KEY)

    def browse(self, namespace: str, limit: int = 50, offset: int = 0, walk_from: int | None = None, include_assets: bool = False):
        rows = self.entries.withColumn("ns", U.namespace(F.col("path")))
        if not include_assets:
            rows = rows.where(~U.is_asset(F.col("path"), F.col("mimetype")))
        if walk_from is not None:
            return paging.take_page(rows.where((F.col("ns") == namespace) & (F.col("entry_id") >= walk_from)).select("entry_id", "path", "title").orderBy("entry_id"), "walk", limit)
        return paging.take_page(rows.where(F.col("ns") == namespace).select("entry_id", "path", "title").orderBy("path"), "browse", limit, offset, ns=namespace)

    def metadata(self) -> DataFrame:
        return A.metadata_map(self.entries)

    def namespaces(self) -> DataFrame:
        return A.namespace_inventory(self.entries.withColumn("ns", U.namespace(F.col("path"))))

    def links(self, path: str, direction: str = "outbound", kind: str | None = None, limit: int = 50, offset: int = 0, archive: str | None = None):
        """A page of the links of a page (with the titles of their targets), of the pages that link it, or of those it mentions."""
        own = F.col("archive") == self.home_of(path, archive)
        if direction == "inbound":
            return paging.take_page(L.inbound(self.edges.where(own), path, 1 << 30), "inbound", limit, offset)
        rows = self.outbound.where(own & (F.col("path") == path))
        if direction == "related":
            rows = L.related(rows).where("source <> target").orderBy(F.desc("mentions"), "first_pos")
            return paging.take_page(rows, "related", limit, offset)
        rows = rows if kind is None else rows.where(F.col("kind") == kind)
        rows = L.with_titles(rows, self.entries.where(own), ("archive",))
        return paging.take_page(rows.select("pos", "kind", "href", "anchor", "target", "target_title").orderBy("pos"), "links", limit, offset, ep=path)

    def health(self) -> DataFrame:
        return self.entries.groupBy("archive").agg(F.count("*").alias("entries"), F.count_if(F.col("redirect_to").isNotNull()).alias("redirects"), F.count_if(F.col("html").isNull() & F.col("redirect_to").isNull()).alias("empty"))

    def synthesize(self, query: str, per_archive: int = 10, keep: int = 5, budget: int = 4800) -> tuple[DataFrame, DataFrame]:
        """(passages with citations in order, the answer).

        Hits of each archive are fused, the page that the query names goes first, list articles go last, the floors
        apply; a query without hits is answered by the page it names, if any.  Sections like the query
        gain, and the passages are cut to the budget.
        """
        hits = S.top_per_group(self.ranked(query), "archive", per_archive, "path").join(small(self.archives), "archive")
        hits = hits.select("archive", "ord", "path", "title", F.col("score").alias("relevance"), "rn")
        promoted = self.promoted(query)
        promoted = self.spark.createDataFrame(promoted.collect(), promoted.schema)  # one row or none
        top = SY.select_hits(hits, promoted, query, self.archives.count() > 1, keep)
        rows = self.bundles.select(*KEY, "markdown", "sections")
        top = top.select(*KEY, "title", "score", "rn").join(rows, KEY)
        top = top.withColumn("passage", SN.excerpt(query, most=0)("markdown")).withColumn("at", PL.located(F.col("passage"), F.col("markdown")))
        top = top.withColumn("passage", T.without_links(F.col("passage")))
        if self.scorer is not None:
            top = RR.rerank(top, query, "passage", self.scorer, KEY)
        inside = F.filter("sections", lambda s: (s["char_start"] <= F.col("at")) & (F.col("at") < s["char_end"]))
        smallest = F.array_min(F.transform(inside, lambda s: F.struct((s["char_end"] - s["char_start"]).alias("n"), s.alias("s"))))
        top = top.withColumn("section", F.coalesce(smallest["s"], F.get("sections", F.lit(0))))
        top = top.withColumn("cite_id", F.concat_ws("#", F.concat_ws("/", *KEY), F.col("section.id"))).withColumn("heading", F.coalesce("section.title", F.lit("")))
        ranked = P.affinity(top, query, "heading").select("cite_id", *KEY, "title", "heading", "passage", F.col("boosted").alias("score"), F.col("new_rn").alias("rn"))
        kept = P.within_budget(ranked.withColumn("n_chars", F.length("passage")), budget)
        kept = kept.withColumn("passage", P.cut_at_word(F.col("passage"), F.col("kept").cast("int"))).drop("n_chars", "kept")
        kept = self.spark.createDataFrame(kept.collect(), kept.schema)  # at most ``keep`` + 1 rows, for both results
        return kept.orderBy("rn"), P.answer(kept)

    def considered_sections(self, passages: DataFrame, most: int = 10) -> DataFrame:
        """pos, section_id, title: the first sections of the first passage's page, without the one it cites."""
        first = passages.orderBy("rn").limit(1).select(*KEY, "cite_id")  # one row
        rows = self.bundles.join(F.broadcast(first), KEY).select(*KEY, "cite_id", F.posexplode("sections").alias("pos", "s"))
        others = rows.where((F.col("s.id") != "") & (F.concat_ws("#", F.concat_ws("/", *KEY), F.col("s.id")) != F.col("cite_id")))
        return others.select("pos", F.col("s.id").alias("section_id"), F.col("s.title").alias("title")).orderBy("pos").limit(most)

    def ask(self, request: str, **options):
        """Reads a request in words and makes the call it asks for: (intent, result)."""
        kind, _ = language.intent(request)
        topic = language.topic(request)
        subject = language.subject(request, kind)
        page = None
        if kind in ("summary", "toc", "structure", "get_article", "get_section", "links", "related", "tell_me_about", "binary"):
            page = self.promoted(subject).first()
        if kind == "list_namespaces":
            return kind, self.namespaces()
        if kind == "metadata":
            return kind, self.metadata()
        if kind == "list_files":
            return kind, self.health()
        if kind == "main_page":
            names = self.entries.select("archive").distinct().withColumn("main_path", F.lit(None).cast("string"))
            return kind, A.main_page(names, self.entries)
        if kind in ("browse", "walk_namespace"):
            ns = language.namespace_in(request)
            return kind, self.browse(ns, walk_from=0 if kind == "walk_namespace" else None, **options)
        if kind == "suggestions":
            return kind, self.search(topic.split()[-1] if topic else request, "suggest", **options)
        if kind == "find_by_title":
            return kind, self.find_title(subject, **options)
        if kind == "search_all":
            return kind, self.search(re_topic(topic), per_archive=10, **options)
        if kind == "filtered_search":
            return kind, self.search(re_topic(language.without_filter(topic)), namespace=language.namespace_in(request) if "namespace" in request.lower() else None, **options)
        if kind == "get_zim_entries":
            return kind, self.get([language.without_article(p) for p in language.listed(subject)])
        if page is not None:
            if kind in ("toc", "structure", "summary"):
                return kind, self.get([page["path"]], kind, archive=page["archive"])
            if kind in ("links", "related"):
                return kind, self.links(page["path"], "outbound" if kind == "links" else "related", archive=page["archive"], **options)
            if kind == "get_section":
                wanted = HT.slugify(language.section_in(request))
                return kind, self.section(page["path"], wanted, archive=page["archive"])
            return kind, self.get([page["path"]], {"tell_me_about": "summary", "binary": "binary"}.get(kind, "full"), archive=page["archive"])
        return kind, self.search(re_topic(topic), **options)


def re_topic(topic: str) -> str:
    """The topic without the words of a search request."""
    import re

    return re.sub(r"^(?:search|find|look (?:up|for)|about|all (?:files|archives))\s+(?:for\s+)?", "", topic, flags=re.I) or topic
