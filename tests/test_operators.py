import datetime

import pytest
from pyspark.sql import functions as F

from textquarry.engine import Engine
from textquarry.functions.html import bundle
from textquarry.operators import archives as A
from textquarry.operators import changes, graph_store, links, promotion
from textquarry.operators import passages as P
from textquarry.plans import language, paging
from textquarry.sources import zim
from textquarry.streaming import watch

HTML = """<html><head><title>Berlin</title><style>p{}</style></head><body><nav><a href="/nav">n</a></nav>
<h1 id="berlin">Berlin</h1><p>Capital of <b>Germany</b>. See <a href="Rhine.html">Rhine</a>, <a href="#x">here</a>, <a href="http://e.org">out</a>.</p>
<table class="infobox"><tr><th>Area</th></tr><tr><th>City</th><td>891 km</td></tr></table>
<h2>Geography</h2><p>Flat land with rivers.</p><h3>Rivers</h3><p>Spree.</p><h2>Geography</h2><p>Again<br>more</p>
<table><tr><td>a</td><td>b</td></tr>%s</table><img src="a.png" alt="pic"></body>""" % ("<tr><td>1</td><td>2</td></tr>" * 9)


def test_bundle():
    b = bundle(HTML)
    assert b["title"] == "Berlin" and [s["id"] for s in b["sections"]] == ["berlin", "geography", "rivers", "geography_2"]
    assert [s["parent_id"] for s in b["sections"]] == [None, "berlin", "geography", "berlin"]
    geo = b["sections"][1]
    text = b["markdown"][geo["char_start"] : geo["char_end"]]
    assert text.startswith("## Geography\n\nFlat land") and "Spree." in text and "Again" not in text
    assert b["infobox"] == [{"label": "Area — City", "value": "891 km"}]
    assert "[Table 1: 10 rows x 2 cols - pass compact=False to expand]" in b["markdown"] and "p{}" not in b["markdown"] and "**Germany**" in b["markdown"]
    assert [x["kind"] for x in b["links"]] == ["internal", "internal", "anchor", "external", "media"]
    assert bundle(None)["markdown"] == "" and bundle("<b>open <p>x")["char_count"] > 0


def test_bundle_leaves_furniture_out():
    page = """<body><h1>Site</h1><div class="ad">buy</div><article><h1>Heart</h1><div class="hatnote">other <div>uses</div></div><p>It beats<sup class="reference">[1]</sup>.</p><figure><img src="x.png"><figcaption>pic</figcaption></figure>
    <h2>Learn More</h2><p>links</p><h3>Sub</h3><p>more</p><h2>Parts</h2><p>Four.</p><h2>Review Date 2/10/2023</h2><p>by</p></article><p>foot <a href="z">z</a></p></body>"""
    b = bundle(page)
    assert [s["title"] for s in b["sections"]] == ["Heart", "Parts"] and b["markdown"].split() == "# Heart It beats. ## Parts Four.".split()
    assert [x["url"] for x in b["links"]][-1] == "z"
    assert [s["char_end"] for s in b["sections"]] == [len(b["markdown"])] * 2
    assert bundle("<article><h1>Learn more</h1><p>x</p></article>")["markdown"] == "# Learn more\n\nx"  # nothing else is there
    empty = bundle("<article> </article><p>text</p>")
    assert empty["markdown"].strip() == "text" and bundle("<article>a</article><article>b</article>")["markdown"].split() == ["a", "b"]
    assert bundle("<h1>Learn more</h1><p>kept without a landmark</p>")["sections"][0]["title"] == "Learn more"


GOLDEN = {
    # numbered and nested lists, with and without end tags and paragraphs
    "<ol start=3><li>x</li><li>y <ol><li>z</ol></ol><ul><li>a<li><p>b</p><p>c</p></ul>": "  3. x\n  4. y\n      1. z\n\n  * a\n  * b\n\n  c",
    # links with titles and brackets, emphasis with spaces inside, code
    'A <b>bold </b>and <i> it</i><a href="x_(y)" title="t">li<em>n</em>k</a> <a href="e"></a><code>c()</code>.': 'A **bold** and _it_[li_n_k](x_\\(y\\) "t") `c()`.',
    "<a href=q><img src=x></a>t <u>u</u><br>next": "t _u_  \nnext",
    # blocks
    "<h2>A<br>B</h2><blockquote><p>q</p><p>r</p></blockquote>s<pre>a\n  b</pre><hr><dl><dt>k<dd>v</dl>": "## A B\n\n> q\n>\n> r\n\ns\n\n    a\n      b\n\n* * *\n\nk\n    v",
    "<table><tr><th>A<th>B<tr><td>1<td><p>2</p><p>3</p></table>": "A | B\n---|---\n1 | 2 3",
    "<p>1. no list</p><p>- dash</p><p>+ plus</p>": "1\\. no list\n\n\\- dash\n\n\\+ plus",
    # the one landmark, menus by shape, and what is no menu
    '<p>chrome</p><div role="main"><h1>M</h1><section><h3>On this page</h3><a href="#1">Alpha one</a><a href="#2">Beta two</a><a href="#3">Gamma</a></section><p>Body <em>text</em>.</p></div><p>foot</p>': "# M\n\nBody _text_.",
    '<main><div><a href="#1">a</a><a href="#2">b</a><a href="#3">c</a><p>%s</p></div></main>' % ("long " * 20): "[a](#1)[b](#2)[c](#3)\n\n" + ("long " * 20).strip(),
    '<main><ol><li><a href="#1">a</a><li><a href="#2">b</a><li><a href="#3">c</a></ol></main>': "  1. [a](#1)\n  2. [b](#2)\n  3. [c](#3)",
    '<main><div><a href="#1">aaaa</a><a href="#2">bbbb</a><a href="#3">cccc</a></div></main>': "[aaaa](#1)[bbbb](#2)[cccc](#3)",
    "<main>a</main><main>b</main><div role=main>c</div>": "c",
    "<p>open <b>bold <i>both</p><p>after</b></i>": "open **bold _both_**\n\nafter",
    "</div></p>text<p>a<p>b": "text\n\na\n\nb",
    "": "", "   ": "", "<p> </p>": "",
}


@pytest.mark.parametrize("page", GOLDEN)
def test_pages_as_markdown(page):
    b = bundle(page)
    assert b["markdown"] == GOLDEN[page]
    for s in b["sections"]:
        assert b["markdown"][s["char_start"]] == "#" and s["char_end"] <= len(b["markdown"])


def test_entities_without_their_end():
    page = '<title>a&amp b&ampc;</title><h1>x &amp;amp; &#38; &copy y&amp</h1><a href="/?a=1&b=2&amp;c">z</a>'
    loose, strict = bundle(page), bundle(page, cut_entities=False)
    assert (loose["title"], loose["sections"][0]["title"]) == ("a& b&c;", "x &amp; & © y&")
    assert (strict["title"], strict["sections"][0]["title"]) == ("a&amp b&ampc;", "x &amp; & &copy y&amp")
    assert loose["links"] == strict["links"] and strict["links"][0]["url"] == "/?a=1&b=2&c"


def test_headings_and_their_ids():
    page = '<a name="before"></a><h2>One</h2><h2><span id="in">Two</span><span class="mw-editsection">[edit]</span></h2><h2 id="own">Three</h2><h2>One</h2><h2></h2><h4>Deep</h4>'
    b = bundle(page)
    assert [(s["id"], s["title"], s["id_source"], s["parent_id"]) for s in b["sections"]] == [("before", "One", "preceding_anchor", None), ("in", "Two", "descendant_anchor", None), ("own", "Three", "id", None), ("one", "One", "slug", None), ("deep", "Deep", "slug", "one")]
    assert all(b["markdown"][s["char_start"] :].startswith("#" * s["level"] + " " + s["title"]) for s in b["sections"])


@pytest.fixture(scope="module")
def entries(spark):
    rows = [
        ("one", 0, "C/Berlin", "Berlin", "text/html", None, HTML), ("one", 1, "C/Rhine.html", "Rhine", "text/html", None, "<h1>Rhine</h1><p>A river near <a href='Berlin'>Berlin</a>.</p>".replace("'", '"')),
        ("one", 2, "C/Capital", "Capital", None, "C/Berlin", None), ("two", 3, "C/List_of_rivers", "List of rivers", "text/html", None, '<h1>List of rivers</h1><p>Rivers: <a href="Capital">Capital</a> <a href="Rhine.html">Rhine</a> <a href="Rhine.html">again</a></p>'),
        ("two", 4, "M/Title", "Title", "text/plain", None, "An archive"), ("two", 5, "C/pic.png", "pic", "image/png", None, None),
    ]
    return spark.createDataFrame(rows, "archive string, entry_id long, path string, title string, mimetype string, redirect_to string, html string")


@pytest.fixture(scope="module")
def engine(entries):
    return Engine(entries)


def test_engine_search(engine):
    page = engine.search("rivers spree")
    assert page.results[0]["path"] in ("C/Berlin", "C/List_of_rivers") and page.done and page.total == 2
    assert engine.search(" ").meta["reason"] == "bad_query" and engine.search("zzz").meta["reason"] == "0_hits"
    assert engine.search("rivers", content_type="image/").meta["reason"] == "no_content_type_match"
    assert [r["path"] for r in engine.search("rivers", limit=1).results] and engine.search("rivers", limit=1).next_cursor
    assert [r["title"] for r in engine.search("ber", "suggest").results] == ["Berlin"]
    assert engine.search("berlin", "title").results[0]["path"] == "C/Berlin"


def test_engine_get_and_sections(engine):
    got = engine.get(["C/Capital", "/C/Berlin", "C/none"], "summary").collect()
    assert [r["success"] for r in got] == [True, True, False] and got[0]["canonical"] == "C/Berlin" and got[1]["content"].startswith("# Berlin")
    s = engine.section("C/Berlin", "geography").first()
    assert s["text"].startswith("## Geography") and "Spree" in s["text"] and "Spree" not in engine.section("C/Berlin", "geography", False).first()["text"]


def test_engine_links_browse_health(engine):
    inbound = {r["path"] for r in engine.links("C/Berlin", "inbound").results}
    assert inbound == {"C/Rhine.html"}  # links stay in their archive
    related = engine.links("C/List_of_rivers", "related").results
    assert [(r["target"], r["mentions"]) for r in related] == [("C/Rhine.html", 2), ("C/Capital", 1)]
    assert [r["kind"] for r in engine.links("C/Berlin").results] == ["internal", "internal", "anchor", "external", "media"]
    assert [r["path"] for r in engine.browse("C", 2).results] == ["C/Berlin", "C/Capital"]
    assert [r["entry_id"] for r in engine.browse("C", 2, walk_from=1).results] == [1, 2]
    assert {r["archive"]: r["redirects"] for r in engine.health().collect()} == {"one": 1, "two": 0}
    assert engine.metadata().first()["metadata"] == {"Title": "An archive"}
    assert {r["ns"]: r["n"] for r in engine.namespaces().collect()} == {"C": 5, "M": 1}


def test_engine_synthesize_and_ask(engine):
    passages, answer = engine.synthesize("rivers geography")
    rows = passages.collect()
    assert rows and all("/" in r["cite_id"] for r in rows) and "[cite: " in answer.first()["answer"]
    assert engine.ask("list the namespaces")[0] == "list_namespaces"
    kind, found = engine.ask("tell me about Rhine")
    assert kind == "tell_me_about" and found.first()["content"].startswith("# Rhine")
    assert engine.ask("search for rivers")[1].total == 2


def test_engine_answers_words_titles_and_ladders(engine):
    assert engine.search(" ?! ").meta["reason"] == "0_hits" and engine.search("rivers", namespace="Q").meta["reason"] == "bad_namespace"
    lost = engine.search("Rhein zzz")
    assert lost.meta["reason"] == "0_hits" and all(x["type"] in ("alt_spelling", "alt_archive") for x in lost.meta["suggestions"])
    assert {"type": "alt_archive", "value": "two"} not in engine.recovery("one", "0_hits") and engine.recovery("about archive two2", "low_relevance") == []
    assert any("**Rhine**" in r["snippet"] for r in engine.search("rhine").results)
    assert engine.promoted("the capital").collect()[0]["path"] == "C/Berlin"  # by a redirect
    got = engine.get(["RHINE", "C/Berlin", "../x", "M/Title"]).collect()
    assert [(r["found_by"], r["success"]) for r in got] == [("search", True), ("path", True), ("refused", False), ("path", True)] and got[3]["content"] == "An archive"
    with pytest.raises(ValueError):
        engine.get(["x"] * 51)
    assert engine.get(["C/Berlin"], "lead").first()["content"].endswith("- Geography\n- Geography")
    why = engine.why_no_section("C/Berlin", "Geografy").first()
    assert (why["reason"], why["closest"]) == ("section_not_found", "geography")


@pytest.mark.parametrize(("request_", "kind", "test"), [
    ("table of contents of Berlin", "toc", lambda r: '"geography"' in r.first()["content"]),
    ("summary of the Rhine", "summary", lambda r: r.first()["content"].startswith("# Rhine")),
    ("links in Berlin", "links", lambda r: len(r.results) == 5),
    ("articles related to List of rivers", "related", lambda r: r.results[0]["target"] == "C/Rhine.html"),
    ("get the geography section of Berlin", "get_section", lambda r: r.first()["title"] == "Geography"),
    ("main page", "main_page", lambda r: r.count() == 2),
    ("walk namespace C", "walk_namespace", lambda r: r.results[0]["entry_id"] == 0),
    ("browse namespace M", "browse", lambda r: [x["path"] for x in r.results] == ["M/Title"]),
    ("get the articles Berlin and Rhine", "get_zim_entries", lambda r: [x["success"] for x in r.collect()] == [True, True]),
    ("find the article titled Rhine", "find_by_title", lambda r: r.results[0]["path"] == "C/Rhine.html"),
    ("search all files for rivers", "search_all", lambda r: r.total == 2),
])
def test_engine_reads_requests(engine, request_, kind, test):
    got, result = engine.ask(request_)
    assert got == kind and test(result)


def test_engine_answers_without_hits_by_title_and_lets_go(spark, entries):
    engine = Engine(entries)
    passages, _ = engine.synthesize("capital")
    assert [r["path"] for r in passages.collect()][0] == "C/Berlin"
    root = engine.index
    engine.close()
    assert "bundles" not in engine.__dict__ and "index" not in engine.__dict__
    again = Engine(entries, root + "-kept")
    assert again.search("rhine").total == 3 and Engine(entries, root + "-kept").index == root + "-kept"


def test_passages_find_the_smallest_section_around_them(spark):
    import random

    rng = random.Random(3)
    sections = [(d, i, a, a + rng.choice((1, 40, 700, 3000))) for d in range(3) for i, a in enumerate(sorted(rng.sample(range(5000), 12)))]
    passages = [(d, at) for d in range(4) for at in rng.sample(range(6000), 40)]
    got = {(r["d"], r["at"]): (r["section_pos"], r["section_start"]) for r in P.attributed(spark.createDataFrame(passages, "d int, at int"), spark.createDataFrame(sections, "d int, pos int, char_start int, char_end int"), "d", 64).collect()}
    for d, at in passages:
        own = [(e - a, i, a) for x, i, a, e in sections if x == d and a <= at < e] or [(0, i, a) for x, i, a, e in sections if x == d and i == 0]
        assert got[d, at] == (min(own)[1:] if own else (None, None))


def test_redirects(spark):
    chain = [(f"p{i}", f"p{i + 1}") for i in range(12)] + [("p12", None), ("a", "b"), ("b", "a"), ("d", "gone")]
    got = {r["path"]: (r["canonical"], r["state"]) for r in links.resolve_redirects(spark.createDataFrame(chain, "path string, redirect_to string")).collect()}
    assert got["p2"] == ("p12", "ok") and got["p1"] == ("p1", "unresolved") and got["a"] == ("a", "unresolved") and got["d"] == ("gone", "dangling") and got["p12"] == ("p12", "ok")


def test_edges_and_store(spark, tmp_path):
    rows = [("A", 0, "T", "t"), ("A", 1, "B", "b"), ("B", 0, "T", "t"), ("A", 2, "A", "self"), ("A", 3, "T", "later"), ("T", 0, None, "")]
    e = links.edges(spark.createDataFrame(rows, "path string, pos int, target string, anchor string"))
    assert sorted(map(tuple, e.collect())) == [("A", "B", "b"), ("A", "T", "t"), ("B", "T", "t")]
    assert [r["path"] for r in links.inbound(e, "T").collect()] == ["B", "A"]
    graph_store.write_graph(e, str(tmp_path / "g"), "u1")
    edges, nodes = graph_store.open_graph(spark, str(tmp_path / "g"), "u1")
    assert [(r["path"], r["inbound_degree"]) for r in graph_store.linkers(edges, nodes, "T").collect()] == [("B", 1), ("A", 0)]
    with pytest.raises(graph_store.StaleGraph):
        graph_store.open_graph(spark, str(tmp_path / "g"), "other")
    with pytest.raises(Exception, match="(?i)exist"):
        graph_store.write_graph(e, str(tmp_path / "g"), "u1")


def test_zim(spark, tmp_path):
    path = str(tmp_path / "a.zim")
    items = [("C", "main", "Main", "text/html", b"<h1>Hi</h1>"), ("C", "old", "Old", None, 0), ("M", "Title", "Title", "text/plain", b"T" * 5000)]
    for packed in (True, False):
        zim.write_zim(path, items, zstd=packed)
        got = {r["path"]: r for r in zim.read_zim(spark, path, 2).collect()}
        assert bytes(got["main"]["content"]) == b"<h1>Hi</h1>" and got["old"]["is_redirect"] and got["old"]["redirect_to"] == "main"
        assert bytes(got["Title"]["content"]) == b"T" * 5000 and got["Title"]["mimetype"] == "text/plain"
        assert zim.check_integrity(path)
    (tmp_path / "bad.zim").write_bytes(b"nothing")
    assert {r["path"].rsplit("/", 1)[1]: r["readable"] for r in zim.list_archives(spark, str(tmp_path)).collect()} == {"a.zim": True, "bad.zim": False}
    assert zim.list_archives(spark, str(tmp_path), "BAD").count() == 1
    data = bytearray((tmp_path / "a.zim").read_bytes())
    data[100] ^= 1
    (tmp_path / "a.zim").write_bytes(data)
    assert not zim.check_integrity(path)


def test_zim_filters_reach_the_directory(spark, tmp_path):
    from types import SimpleNamespace

    from pyspark.sql.datasource import EqualTo, GreaterThan, In, StringContains, StringStartsWith

    path = str(tmp_path / "big.zim")
    items = [(ns, f"{ns}{i:04}é" if i % 7 else f"p{i:04}", f"t{i}", "text/html", f"{ns}{i}".encode() * 50) for ns in "CMW" for i in range(1000)]
    data = bytearray(zim.zim_bytes(items, cluster_bytes=5000))
    (tmp_path / "big.zim").write_bytes(data)
    want = {(ns, p): c for ns, p, _, _, c in items}

    def run(columns, *filters):
        reader = zim.ZimReader({"path": path, "entriesPerTask": "400"}, SimpleNamespace(names=columns))
        left = list(reader.pushFilters(list(filters)))
        parts = reader.partitions()
        probed, rows, read = reader.counts["entries"], [], 0
        clusters = 0
        for p in parts:
            rows += list(reader.read(p))
            read += reader.counts["entries"]
            clusters += reader.counts["clusters"]
        return rows, left, probed, read, clusters

    rows, left, probed, read, clusters = run(["namespace", "path", "content"], EqualTo(("path",), "p0007"))
    assert sorted(rows) == sorted((ns, "p0007", want[ns, "p0007"]) for ns in "CMW") and not left and read == 3 and clusters == 3 and probed < 200
    rows, _, _, read, clusters = run(["path"], StringStartsWith(("path",), "C00"), EqualTo(("namespace",), "C"))
    assert len(rows) == read == sum(ns == "C" and p.startswith("C00") for ns, p in want) and clusters == 0
    rows, _, probed, read, _ = run(["entry_id"], GreaterThan(("entry_id",), 2990), In(("entry_id",), (5, 2995, 9999, None)))
    assert rows == [(2995,)] and read == 1 and probed == 0
    assert run(["path"], EqualTo(("namespace",), "Q"))[0] == [] and len(run(["path"], StringContains(("path",), "x"))[1]) == 1 and len(run(["entry_id"])[0]) == 3000
    e = zim.read_zim(spark, path, 400)
    assert [(r["namespace"], bytes(r["content"])) for r in e.where("path = 'C0011é' and namespace = 'C'").collect()] == [("C", want["C", "C0011é"])]
    assert e.where("path like 'M09%'").count() == sum(p.startswith("M09") for _, p in want) and e.where("entry_id between 10 and 19").count() == 10
    # Totals from a bounded share of the directory; exact in small archives.
    got = {r["namespace"]: (r["sampled"], r["projected"], r["exact"]) for r in zim.projected_totals(spark, path, 300).collect()}
    assert sum(s for s, _, _ in got.values()) == 300 and all(abs(p - 1000) < 60 and not x for _, p, x in got.values())
    assert {(r["projected"], r["exact"]) for r in zim.projected_totals(spark, path, 3000).collect()} == {(1000, True)}
    # A damaged entry and a damaged cluster are rows with an error.
    z = zim.ZimFile(open(path, "rb"))
    import struct

    at = struct.unpack("<Q", z._at(z.paths + 8 * 1500, 8))[0]
    data[at : at + 2] = b"\x77\x77"
    data[struct.unpack("<Q", z._at(z.cluster_table, 8))[0] + 3] ^= 0xFF
    (tmp_path / "big.zim").write_bytes(data)
    e = zim.read_zim(spark, path, 400)
    bad = e.where("error is not null")
    assert e.count() == 3000 and e.where("path is null").select("entry_id").collect() == [(1500,)] and 1 < bad.count() < 40 and e.where("path = 'W0900é'").count() == 1


def test_archives_written_by_tasks(spark, tmp_path):
    rows = [(a, "C", f"p{i}", None, "text/plain", None, f"{a}{i}".encode()) for a in ("x", "y") for i in range(50)] + [("x", "C", "again", "t", None, "p7", None)]
    made = zim.write_archives(spark.createDataFrame(rows, "archive string, namespace string, path string, title string, mimetype string, redirect_to string, content binary"), f"file:{tmp_path}").collect()
    assert {(r["archive"], r["entries"]) for r in made} == {("x", 51), ("y", 50)} and zim.check_integrity(str(tmp_path / "x.zim"))
    back = zim.read_zim(spark, str(tmp_path / "x.zim")).where("path in ('again', 'p9')").select("path", "redirect_to", "content").collect()
    assert sorted((r["path"], r["redirect_to"], r["content"] and bytes(r["content"])) for r in back) == [("again", "p7", None), ("p9", None, b"x9")]
    (tmp_path / "z.zim").write_bytes(b"no archive")
    every = zim.read_archives(spark.createDataFrame([(str(tmp_path / f"{n}.zim"),) for n in "xyz"], "path string"), content=False)
    assert every.count() == 102 and every.where("error is not null").count() == 1


def test_sections_and_budget(spark):
    rows = [(1, 100, 0, 1, "Top", 0), (1, 100, 1, 2, "Part", 20), (1, 100, 2, 3, "Sub", 40), (1, 100, 3, 2, "Part", 60)]
    got = P.heading_sections(spark.createDataFrame(rows, "page_id int, length int, pos int, level int, text string, start int")).orderBy("pos").collect()
    assert [(r["id"], r["char_start"], r["char_end"], r["parent_pos"]) for r in got] == [("top", 0, 100, None), ("part", 20, 60, 0), ("sub", 40, 60, 1), ("part_2", 60, 100, 0)]
    ranked = spark.createDataFrame([(1, 30), (2, 50), (3, 40)], "rn int, n_chars int")
    assert [r["kept"] for r in P.within_budget(ranked, 60).orderBy("rn").collect()] == [30, 30]
    cut = spark.range(1).select(P.cut_at_word(F.lit("some words to be cut"), F.lit(12)).alias("x")).first()["x"]
    assert cut == "some words"


def test_diff(spark):
    a = spark.createDataFrame([("x", 1, 1), ("y", 1, 1), ("z", 1, 1)], "path string, mtime int, size int")
    b = spark.createDataFrame([("x", 1, 1), ("y", 2, 1), ("w", 1, 1)], "path string, mtime int, size int")
    assert {tuple(r) for r in changes.diff(a, b).collect()} == {("y", "changed"), ("z", "removed"), ("w", "added")}
    assert {tuple(r) for r in changes.diff(a, b, False).collect()} == {("y", "changed"), ("w", "added")}


def test_watch_stream(spark, tmp_path):
    schema, seen = "path string, mtime int, size int", []
    for i, rows in enumerate(([("x", 1, 1), ("y", 1, 1)], [("x", 2, 1)], [("x", 2, 1), ("y", 5, 9)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        watch.watch(stream, lambda df, n: seen.append({tuple(r) for r in df.collect()}), str(tmp_path / "state"), str(tmp_path / "check")).awaitTermination()
    assert seen == [{("x", "added"), ("y", "added")}, {("x", "changed"), ("y", "removed")}, {("y", "changed")}]


def test_event_streams(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    rows = [(1, start + datetime.timedelta(minutes=10 * i), "view", 1.0) for i in range(6)] + [(1, start + datetime.timedelta(days=3), "view", 2.0)]
    spark.createDataFrame(rows, "user_id long, ts timestamp_ntz, event_type string, value double").write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema("user_id long, ts timestamp_ntz, event_type string, value double").parquet(str(tmp_path / "e"))
    for name, df in (("t", watch.tumbling(stream)), ("s", watch.sessions(stream))):
        df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
    assert [(r["n"], r["total"]) for r in spark.table("t").collect()] == [(6, 6.0)]
    assert [r["n"] for r in spark.table("s").collect()] == [6]


def test_archive_types(spark):
    rows = [
        ("a", "sotoki 2.0", "", "", "", "", "stackexchange", "high"), ("b", "mwoffliner 1", "wiktionary_fr", "", "", "", "wiktionary", "high"), ("c", "", "wikipedia_de", "", "", "", "wikipedia", "medium"),
        ("d", "mwoffliner", "en.wikivoyage.org", "", "", "", "wikipedia", "high"), ("e", None, None, None, None, None, "generic", "none"), ("f", "", "superuser.com_en_all", "", "", "", "stackexchange", "medium"),
        ("g", "", "ted_en_x", "", "", "", "ted", "medium"), ("h", "zimit", "x", "", "Stack Exchange", "", "stackexchange", "medium"), ("i", "mwoffliner", "x", "The Wiktionary", "", "", "wiktionary", "high"),
        ("j", "", "notsuperuser.com_x", "", "", "", "generic", "none"), ("k", "", "", "", "", "a;wikipedia", "wikipedia", "medium"),
    ]
    frame = spark.createDataFrame(rows, "archive string, scraper string, name string, title string, creator string, tags string, t string, c string")
    assert {r["archive"]: (r["type"], r["confidence"]) for r in A.archive_type(frame).collect()} == {r[0]: r[6:] for r in rows}


def test_cursors():
    c = paging.encode_cursor("browse", o=10, ns="C")
    assert paging.decode_cursor(c, "browse", ns="C") == {"o": 10, "ns": "C"}
    for call in (lambda: paging.decode_cursor(c, "walk"), lambda: paging.decode_cursor(c, "browse", ns="M"), lambda: paging.decode_cursor("??", "browse"), lambda: paging.decode_cursor("e30", "browse")):
        with pytest.raises(paging.CursorError):
            call()
    text, at, parts = "ab cd   ef " * 9, 0, []
    while at < len(text):
        n = paging.page_length(text[at:], 10)
        parts.append(text[at : at + n])
        at += n
    assert "".join(parts) == text


@pytest.mark.parametrize(("request_", "want"), [
    ("show the main page", "main_page"), ("list all namespaces", "list_namespaces"), ("table of contents of Berlin", "toc"), ("tell me about Ada", "tell_me_about"), ("search for rivers", "search"),
    ("search across all archives for rivers", "search_all"), ("articles related to Rome", "related"), ("summary of Rome", "summary"), ("xyz", "search"),
])
def test_intents(request_, want):
    assert language.intent(request_)[0] == want


def test_language():
    assert language.topic("what is the Rhine?") == "Rhine"
    assert language.snippet_terms('title:"Berlin wall" AND fal* in') == [("berlin", False), ("wall", False)]
    assert language.respelt("Teh recieve's end", {"teh": "the", "recieve": "receive"}) == "The receive's end"
    assert language.of_parts("history of the Rhine") == ("Rhine", "history") and language.of_parts("list of rivers") is None
    assert language.entities("Rome, Paris and Berlin") == ["Rome", "Paris", "Berlin"] and language.entities("Rome and Paris") == []
    assert language.alternative_archives("python lists", ["docs.python.zim", "wiki.zim"]) == ["docs.python.zim"]


GATES = [  # topic, path, match type, path before a redirect: what the gates say (base, z4, tail with no other titles, tail with two)
    ("stalin ussr russia", "A/Russia", "direct", None, False, True, True, False),
    ("hamlet denmark prince", "Hamlet", "direct", None, True, True, True, True),
    ("apollo 11 moon landing", "Moon_landing", "direct", None, True, True, True, True),
    ("berlin germany", "Berlin", "fuzzy_suggest", None, True, True, True, True),
    ("marie curie radioactivity", "Radioactive_(Redniss_book)", "fuzzy_suggest", None, False, False, False, False),
    ("tesla electricity", "Tesla's_Wireless_Electricity", "fuzzy_suggest", None, True, False, False, False),
    ("united states constitution", "Constitution_of_the_United_States", "direct", None, True, True, True, True),
    ("beethoven symphony", "Symphony_No._1_(Beethoven)", "fuzzy_suggest", None, True, False, False, False),
    ("beethoven 9th symphony", "Symphony_No._9_(Beethoven)", "fuzzy_suggest", None, True, True, True, True),
    ("big rapids michigan ferris state", "Ferris_State_University", "fuzzy_suggest", None, True, True, True, True),
    ("darwin's evolution", "Evolution", "fuzzy_suggest", None, False, True, False, False),
    ("newton's gravity", "Newton's_law_of_universal_gravitation", "redirect", "Newton_Laws_of_Gravity", True, True, True, True),
    ("plato's cave", "Allegory_of_the_cave", "redirect", "Plato's_cave", True, True, True, True),
    ("plato's republic philosophy", "Czech_philosophy", "redirect", "Bohemian_thought", False, True, False, False),
    ("c++", "C", "direct", None, True, False, False, False),
    ("carbon capture & storage technology", "A/Carbon_capture", "direct", None, True, True, True, True),
]


def test_promotion_gates(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([g[:4] for g in GATES], "topic string, path string, kind string, pre string")
    topic, path, kind, pre = F.col("topic"), F.col("path"), F.col("kind"), F.coalesce("pre", "path")
    name, no = promotion.name_of(path), F.lit(False)
    tail = lambda n: promotion.tail_ok(topic, path, name, kind, pre, F.lit(n), no)
    got = df.select("topic", "path", promotion.base_ok(topic, name, kind, pre), promotion.z4(topic, path, name, no), tail(0), tail(2)).collect()
    assert [tuple(r) for r in got] == [(g[0], g[1], *g[4:]) for g in GATES]
    twin = spark.createDataFrame([("mercury", "Mercury_(disambiguation)"), ("mercury disambiguation", "Mercury_(disambiguation)"), ("mercury", "Mercury_(planet)"), ("immanuel kant", "Kant, Immanuel | Encyclopedia"), ("texas", "Paris, Texas")], "t string, p string")
    assert [r[0] for r in twin.select(promotion.strong_canonical(F.col("t"), F.col("p"), F.col("p"))).collect()] == [False, True, True, True, False]


def test_archives_of_several_folders(spark, tmp_path):
    import os

    for f in ("a", "b", "out"):
        (tmp_path / f).mkdir()
    zim.write_zim(str(tmp_path / "a" / "one.zim"), [("C", "x", "X", "text/html", b"hello")])
    zim.write_zim(str(tmp_path / "out" / "far.zim"), [("C", "x", "X", "text/html", b"hello")])
    (tmp_path / "b" / "bad.zim").write_bytes(b"nothing")
    os.symlink(tmp_path / "out" / "far.zim", tmp_path / "b" / "far.zim")
    folders = [str(tmp_path / "a"), str(tmp_path / "b"), str(tmp_path / "a")]
    got = zim.list_archives(spark, folders)
    rows = sorted((r["path"].rsplit("/", 2)[1:], r["readable"], r["warning"]) for r in got.collect())
    assert rows == [(["a", "one.zim"], True, None), (["b", "bad.zim"], False, "not an archive")]
    checked = {r["path"].rsplit("/", 1)[1]: (r["ok"], r["error"] is None) for r in zim.check_archives(got).collect()}
    assert checked["one.zim"] == (True, True) and checked["bad.zim"][0] is False


def test_settings(spark, tmp_path):
    from textquarry.operators import archives as A
    from textquarry.sources import settings

    (tmp_path / "w.txt").write_text("# words\nTeh=the\nbad line\nrecieve=receive\n")
    (tmp_path / "x.txt").write_text("teh\n")
    (tmp_path / "p.toml").write_text('[preset.stackexchange]\nmax_paragraphs = 5\n[pin.mine]\ntype = "wikipedia"\nsummary_style = "q_and_a"\n')
    words = settings.load_misspellings(tmp_path / "w.txt", {})
    assert words == {"teh": "the", "recieve": "receive"} and settings.load_misspellings(None, {"a": "b"}) == {"a": "b"}
    assert language.respelt("Teh goverment's (recieve)") == "Teh government's (receive)"
    assert language.respelt("teh recieve", words, excluded=settings.load_exclusions(tmp_path / "x.txt")) == "teh receive"
    p = settings.load_presets(tmp_path / "p.toml")
    assert p.effective("stackexchange", "high", "other") == {"summary_style": "q_and_a", "max_paragraphs": 5} and p.effective("stackexchange", "medium", "other") is None
    assert p.effective("ted", "none", "mine") == {"summary_style": "q_and_a"}
    types = spark.createDataFrame([("mine", "ted", "none"), ("so", "stackexchange", "high"), ("x", "wikipedia", "medium")], "archive string, type string, confidence string")
    got = {r["archive"]: r["preset"] for r in A.effective_preset(types, *p.tables(spark)).collect()}
    assert got == {"mine": "q_and_a", "so": "q_and_a", "x": "default"}


def test_reasons():
    assert paging.reason(" ", 0) == "bad_query" and paging.reason("x", 0) == "0_hits" and paging.reason("x", 0, before_filter=3) == "no_content_type_match"
    assert paging.reason("x", 5, strong=0) == "low_relevance" and paging.reason("x", 5, strong=1) is None and paging.reason("x", 0, known_namespace=False) == "bad_namespace"
    assert paging.reason("x", 3, indexed=False) == "no_xapian_index" and paging.reason(None, 3, n_headings=0) == "no_headings" and paging.reason(None, 3, is_html=False) == "non_html"
    assert paging.reason("x", 3, failed_archives=1) == "archive_unavailable" and paging.reason("x", 3, out_of_time=True) == "search_all_budget_exceeded"
    assert paging.reason(None, 3, sampled=True) == "sample_only" and paging.reason(None, 3, cut_links=True) == "scan_truncated"


def test_excerpts(spark):
    from textquarry.functions import snippets as SN

    text = "# Rhine\n\n* Home\n* Start Here\n\n[](pics/a.png)\n\nOn this page:\n\n## History\n\nOld words here.\n\n## River\n\nThe **Rhine** is a river; see [rhine](x).\n\nIt flows north with $$\\\\phi \\\\leq x$$ force."
    got = SN.excerpted(text, "river")
    assert got == "## **River**\n\nThe **Rhine** is a **river**; see [rhine](x).\n\nIt flows north with φ ≤ x force."
    assert SN.excerpted(text, "zzzz") == "## History\n\nOld words here.\n\n## River\n\nThe **Rhine** is a river; see [rhine](x)."
    assert SN.excerpted("a\n\nphotosynthetic cells", "photosynthesis") == "photosynthetic cells"
    assert SN.excerpted("x " * 100, "x", length=20).endswith("...") and len(SN.excerpted("x " * 100, "yyy", length=20)) <= 20
    assert SN.excerpted(None, "a") is None and SN.excerpted("", "abc") == ""
    assert SN.tex_text(r"\text{set} \Omega \in \foo{x}") == "set Ω ∈ foox" and SN.tex_text(r"\alpha") == "α"
    assert SN.tex_text(r"\lambda \Lambda \varphi \neg x \land \vDash \\{a\\}") == "λ Λ φ ¬ x ∧ ⊨ {a}"
    assert SN.excerpted("# T\n\n* Berlin\n* Hamburg Port\n\nText.", "hamburg").startswith("* Berlin\n* **Hamburg** Port")
    assert SN.excerpted("## Only\n\n## Headings", "zzz") == "## Headings"


def test_promotion_passes(spark):
    titles = spark.createDataFrame(
        [("a", 1, "Big_Rapids", "Big Rapids", None), ("a", 1, "Michigan", "Michigan", None), ("a", 1, "Tourism", "Tourism", None), ("a", 1, "Photosynthesis", "Photosynthesis", None), ("b", 2, "Photosynthesis", "Photosynthesis", None),
         ("a", 1, "Allegory_of_the_cave", "Allegory of the cave", None), ("a", 1, "Allegory_of_the_cave", "Plato's cave", "Plato's_cave"), ("a", 1, "Cave", "Cave", None), ("a", 1, "Russia", "Russia", None), ("a", 1, "Stalin", "Stalin", None), ("a", 1, "Ussr", "USSR", None), ("a", 1, "Detroit", "Detroit", None)],
        "archive string, ord int, path string, title string, pre string",
    )
    topics = ["famous people from big rapids", "big rapids festival", "big rapids tourism", "photosythesis", "plato's cave", "stalin ussr russia", "population of detroit", "nothing here", "Michigan"]
    got = {r["topic"]: (r["pass"], r["path"]) for r in promotion.promote(spark.createDataFrame([(t,) for t in topics], "topic string"), titles).collect()}
    assert got == {
        "famous people from big rapids": (1, "Big_Rapids"), "big rapids festival": (2, "Big_Rapids"), "big rapids tourism": (1, "Tourism"), "photosythesis": (3, "Photosynthesis"), "plato's cave": (0, "Allegory_of_the_cave"),
        "population of detroit": (1, "Detroit"), "Michigan": (0, "Michigan"), "stalin ussr russia": (2, "Stalin"),
    }


def test_synthesis_stages(spark):
    from textquarry.operators import synthesis as SY

    hits = spark.createDataFrame([
        ("wiki", 1, "List_of_rivers", "List of rivers", 9.0, 1), ("wiki", 1, "Rhine", "Rhine", 8.0, 2), ("wiki", 1, "Elbe", "Elbe", 1.0, 3),
        ("film", 2, "Black_Adder", "Black Adder", 7.0, 1), ("film", 2, "Rivers_and_Tides", "Rivers and Tides", 6.0, 2), ("film", 2, "River_Song", "River Song", 5.0, 3), ("film", 2, "Rivers_film", "Rivers film", 5.0, 4),
    ], "archive string, ord int, path string, title string, relevance double, rn int")
    none = spark.createDataFrame([], "archive string, path string, title string")
    found = spark.createDataFrame([("wiki", "Rhine", "Rhine")], none.schema)
    names = lambda df: [r["path"] for r in df.orderBy("rn").collect()]
    one = hits.where("archive = 'wiki'")
    assert names(SY.select_hits(one, none, "rivers of europe", False)) == ["Rhine", "List_of_rivers"]
    assert names(SY.select_hits(one, found, "rhine river", False)) == ["Rhine", "List_of_rivers"]
    assert names(SY.promote(SY.fuse(one, False), found, "the rhine")) == ["Rhine", "List_of_rivers", "Elbe"]
    both = SY.fuse(hits, True, 7)
    assert names(both)[:2] == ["Black_Adder", "List_of_rivers"]
    assert names(SY.leakage_floor(SY.demote(SY.promote(both, none, "rivers")), "rivers")) == ["Black_Adder", "Rivers_and_Tides", "River_Song", "Rivers_film", "List_of_rivers"]
    assert names(SY.leakage_floor(both, "list rivers")) == ["List_of_rivers", "Rhine", "Rivers_and_Tides", "Elbe", "Rivers_film"]
    assert names(SY.leakage_floor(both, "water")) == ["Black_Adder", "List_of_rivers", "Rhine", "Rivers_and_Tides", "River_Song", "Rivers_film"]
    lost = SY.promote(SY.fuse(one.where("rn > 9"), False), found, "rhine")
    assert names(SY.demote(lost)) == ["Rhine"]


def test_snippets(spark):
    from textquarry.functions import snippets as SN

    mark = lambda text, words, *most: SN.marked(text, SN.Terms.of([(w.rstrip("*"), w.endswith("*")) for w in words]), *most)
    assert mark("Gödel met godel and GODELS", ["godel"]) == "**Gödel** met **godel** and GODELS"
    assert mark("a **rome** [rome](x) rome romes", ["rom*"], 1) == "a **rome** [rome](x) **rome** romes"
    assert mark("`Berlin()` _Berlin_ foo_berlin Berlin", ["berlin"]) == "`Berlin()` _Berlin_ foo_berlin **Berlin**"
    assert mark("ﬁne ½", ["fine"]) == "**ﬁne** ½" and mark(None, ["a"]) is None and mark("x", []) == "x"
    assert [SN.slugify(x) for x in ("- Foo Bar -", "ﬁne Title", "A_b  c!", "", "Ж ١")] == ["foo-bar", "fine-title", "a_b-c", "", "ж-١"]
    assert language.snippet_terms("quantum-mechanics C/Berlin title:Rhine AND (diabet* car*) of") == [("quantum", False), ("mechanics", False), ("berlin", False), ("rhine", False), ("diabet", True)]
    assert SN.repaired("see [the li") == "see" and SN.repaired("a **b") == "a b" and SN.repaired(None) is None
    df = spark.createDataFrame([("Été",), (None,)], "t string")
    assert [r["x"] for r in df.select(SN.fold_all("t").alias("x")).collect()] == ["ete", None]


def test_places_are_counted_in_the_page_as_it_is():
    from textquarry.functions.places import span_of

    page = "**A** and **B** are **old** towns.\n\n  The  river\tis **wide** and deep here."
    for passage in ("towns", "old towns.", "**wide** and", "river\tis wide"):
        plain = passage.replace("**", "")
        a, b = span_of(passage, page)
        assert page[a:b].replace("**", "") == plain and page[a] == plain[0], passage
    a, b = span_of("The river is wide  and deep", page)
    assert page[a:].startswith("The  river\tis") and page[a:b].endswith("deep")
    assert span_of("", page) is None and span_of("nowhere to be found", page) is None and span_of("river  is", page) is None


def test_main_page(spark, entries):
    archives = spark.createDataFrame([("one", "C/Rhine.html"), ("two", None), ("none", None)], "archive string, main_path string")
    assert {r["archive"]: (r["path"], r["found_by"]) for r in A.main_page(archives, entries).collect()} == {"one": ("C/Rhine.html", "main"), "two": ("C/List_of_rivers", "first entry"), "none": (None, None)}


def test_snippet_highlight_whole_reads_all_rows_and_lines(spark, tmp_path):
    import re
    import unicodedata

    from textquarry.registry import QUERIES

    texts = [
        "That line\nand that, später für FÜR fur pour that", "no hit", "", None, "first\nthat late", "keep **that** and [that](x) but thatch that",
        "é that * that", "that " * 8, "Pour fu\u0308r with tion", "[[that]] für **pour für** pour",
    ]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    fold = lambda w: "".join(c for c in unicodedata.normalize("NFKD", w) if not unicodedata.combining(c)).lower()

    def brute(text):
        out, hits = [], 0
        for piece in re.split(r"(\*\*[^*\n]+\*\*|\[[^\]\n]*\]\([^)\n]*\))", text):
            for w in re.split(r"((?:\w|[\u0300-\u036f])+)", piece):
                hit = fold(w) in ("that", "with", "tion", "fur", "pour") and hits < 5 and not re.match(r"\*\*|\[[^\]\n]*\]\(", piece)
                hits += hit
                out.append(f"**{w}**" if hit else w)
        return "".join(out)

    got = {r["doc_id"]: r["text"] for r in QUERIES["snippet_highlight_whole"](spark, str(tmp_path)).collect()}
    assert got == {i: None if t is None else brute(t) for i, t in enumerate(texts)}


def test_many_requests_are_not_broadcast(spark, tmp_path):
    """Requests made by an explode are far more than their files tell (F1)."""
    n = 6000
    spark.range(n).select(F.col("id").alias("entry_id"), F.concat(F.lit("C/page_"), "id").alias("path")).write.parquet(f"{tmp_path}/e")
    e = spark.read.parquet(f"{tmp_path}/e")
    forms = F.array(F.col("path"), F.concat(F.lit("/"), "path"), F.concat(F.lit("PAGE-"), "entry_id", F.lit(".html")), F.concat(F.lit("../"), "path"))
    asked = e.select("entry_id", F.posexplode(forms).alias("i", "path")).select((F.col("entry_id") * 4 + F.col("i")).alias("idx"), "path")
    many = A.fetch_ladder(asked, e)
    assert {(r.found_by, r.i): r.n for r in many.groupBy("found_by", (F.col("idx") % 4).alias("i")).agg(F.count("*").alias("n")).collect()} == {("path", 0): n, ("path", 1): n, ("search", 2): n, ("refused", 3): n}
    assert many.where("found_by <> 'refused' AND entry_id <> idx div 4").count() == 0
    # The hints say how the joins with entries are done.
    hints = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=merge" in hints(many) and "strategy=broadcast" not in hints(many)
    some = A.fetch_ladder(asked.where("idx < 40"), e)
    assert "strategy=broadcast" in hints(some) and some.where("entry_id = idx div 4").count() == 30
