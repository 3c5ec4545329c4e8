import pytest
from pyspark.sql import functions as F

from textquarry.functions import snippets as SN
from textquarry.functions import text as T
from textquarry.functions import urls as U


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first()
    return row["x"]


@pytest.mark.parametrize(("href", "base", "want"), [
    ("b", "h/a/page", "h/a/b"), ("../b", "h/a/page", "h/b"), ("/c/d/", "h/a", "c/d/"), ("./x/./y#f", "h/a", "h/x/y"), ("#f", "h/a", None),
    ("http://e.org/x", "h/a", None), ("?q=1", "h/a", None), ("..", "h/a/b/c", "h/a"), ("../../../../z", "h/a", "z"), ("mailto:a@b", "h/a", None), ("//e.org/x", "h/a", None),
])
def test_resolved(spark, href, base, want):
    assert one(spark, U.resolved(F.col("h"), F.col("b")), h=href, b=base) == want


@pytest.mark.parametrize(("path", "mime", "want"), [("a/b.PNG?x=1", None, True), ("a/b.html", None, False), ("a/b.htm", "image/png", True), ("a/b.png", "text/html", True), ("a/b", "text/css; charset=utf-8", True), ("a/b", " Application/PDF", True), ("a/b.xml", None, False), ("a/b.flac", None, False), ("a/b.mjs#x", None, True), ("c", "", False)])
def test_asset(spark, path, mime, want):
    assert one(spark, U.is_asset(F.col("p"), F.col("m").cast("string")), p=path, m=mime) is want


@pytest.mark.parametrize(("path", "want"), [("A/x", "A"), ("", "Unknown"), ("Cx", "C"), ("-/s", "-"), ("M/Counter", "M")])
def test_namespace(spark, path, want):
    assert one(spark, U.namespace(F.col("p")), p=path) == want


@pytest.mark.parametrize(("name", "want"), [("content", "C"), ("Well-Known", "W"), ("index", "X"), ("m", "M"), ("other", "other")])
def test_canonical_namespace(spark, name, want):
    assert one(spark, U.canonical_namespace(F.col("n")), n=name) == want


def test_counter(spark):
    got = one(spark, U.parse_counter(F.col("c")), c="text/html=12;image/svg+xml; charset=utf-8=5;application/javascript=3")
    assert got == {"text/html": 12, "image/svg+xml; charset=utf-8": 5, "application/javascript": 3}


@pytest.mark.parametrize(("q", "t", "want"), [
    ("wigdet", "widget", True), ("gera", "gear", True), ("rng", "ring", False), ("gear", "gears", False), ("gears", "gear", True), ("bolts", "bolt", True),
    ("widget", "widget", False), ("windget", "widget", True), ("abcd", "dcba", False), ("Wigdet", "WIDGET", True),
])
def test_one_typo(spark, q, t, want):
    assert one(spark, T.one_typo(F.col("q"), F.col("t")), q=q, t=t) is want


@pytest.mark.parametrize(("topic", "title", "want"), [
    ("berlin", "Berlin", True), ("berlin", "Berlin wall history", True), ("berlin wall", "Berlin", True), ("berlin wall fall", "Berlin", False),
    ("ada lovelace", "Lovelace, Ada", True), ("berlin", "Berlin | Site", True), ("be", "be", False), ("rome", "Berlin", False),
])
def test_strong_title(spark, topic, title, want):
    assert one(spark, T.strong_title(F.col("a"), F.col("b")), a=topic, b=title) is want


def test_small_functions(spark):
    assert one(spark, T.without_links(F.col("x")), x="a [b](c) d") == "a b d"
    assert one(spark, T.without_votes(F.col("x")), x="\n-3\n\ntext") == "text"
    assert one(spark, SN.slug(F.col("x")), x="  The Great War! (1914) ") == "the-great-war-1914"
    assert one(spark, T.fold(F.col("x")), x="Gödel É") == "godel e"
    assert one(spark, T.size_text(F.col("x")), x=1536) == "1.5 KB"
    for path in ("A/List_of_rivers", "Lists_of_x", "listed_buildings_in_York", "Foo_discography", "C/Foo_awards_and_honors", "Foo_honours_and_awards"):
        assert one(spark, T.is_list_article(F.col("x")), x=path), path
    for path in ("Listing", "Academy_Awards", "Discography", "List of rivers", "wiki/List_of_rivers"):
        assert not one(spark, T.is_list_article(F.col("x")), x=path), path
    assert one(spark, T.is_disambiguation(F.col("x")), x="Mercury_(disambiguation)")
    assert one(spark, T.is_pseudo_entry(F.col("p"), F.col("t")), p="X/a", t="b") and not one(spark, T.is_pseudo_entry(F.col("p"), F.col("t")), p="A/a", t="b")
    assert one(spark, T.starts_with_word(F.col("x"), F.lit("new")), x="new york") and not one(spark, T.starts_with_word(F.col("x"), F.lit("new")), x="newer")


def test_paths(spark):
    assert one(spark, U.normal_path(F.col("p")), p=" //A//b/c ") == "A/b/c"
    assert [one(spark, U.climbs(F.col("p")), p=p) for p in ("a/../b", "a/..b", "%2e%2e/x", "C:/x", "a/b")] == [True, False, True, True, False]
    assert one(spark, U.search_terms(F.col("p")), p="A/The_Great-War.html?x=1") == "The Great War"
    assert one(spark, U.same_path(F.col("a"), F.col("b")), a="C/The_Rhine", b="the-rhine.html") and not one(spark, U.same_path(F.col("a"), F.col("b")), a="C/Rhine", b="C/Rhone")
