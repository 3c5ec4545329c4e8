"""Engines over archives that share paths, and calls that outlive a broken or slow archive."""

import time

import pytest
from pyspark.sql import functions as F

from textquarry.engine import Engine
from textquarry.library import Library, apart
from textquarry.operators import rerank as RR

SCHEMA = "archive string, entry_id long, path string, title string, mimetype string, redirect_to string, html string"


def page(archive, i, path, html, to=None, mime="text/html"):
    return (archive, i, path, path[2:].replace("_", " "), mime, to, html)


@pytest.fixture(scope="module")
def entries(spark):
    rows = [
        page("a", 0, "C/Berlin", "<h1>Berlin</h1><p>A city with a wall. <a href='Big'>big</a></p>".replace("'", '"')),
        page("b", 0, "C/Berlin", '<h1>Berlin</h1><p>An airship, a zeppelin, lands. <a href="Big">big</a> <a href="Cat.png">pic</a></p>'),
        page("a", 1, "C/Big", "<h1>Big</h1><p>A page of its own.</p>"), page("b", 1, "C/Big", None, "C/Berlin"),
        page("a", 2, "C/Hamburg", '<h1>Hamburg</h1><p>Port. <a href="Berlin">capital</a></p>'), page("b", 2, "C/Hamburg", "<h1>Hamburg</h1><p>Ships and a zeppelin hall.</p>"),
        page("a", 3, "M/Title", "First", mime="text/plain"), page("b", 3, "M/Title", "Second", mime="text/plain"), page("b", 4, "C/Cat.png", "png bytes", mime="image/png"),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def engine(entries):
    return Engine(entries)


def test_hits_belong_to_the_archive_that_holds_the_word(engine):
    hits = engine.search("zeppelin").results
    assert [(r["archive"], r["path"]) for r in hits] == [("b", "C/Hamburg"), ("b", "C/Berlin")] and "**zeppelin**" in hits[0]["snippet"]
    assert {(r["archive"], r["path"]) for r in engine.search("city airship").results} == {("a", "C/Berlin"), ("b", "C/Berlin")}
    assert engine.search("zeppelin", archive="a").total == 0 and engine.ranked("zeppelin").count() == 2


def test_get_gives_one_row_a_path(engine):
    rows = engine.get(["C/Berlin", "C/Big", "M/Title", "none"]).collect()
    assert [(r["archive"], r["canonical"]) for r in rows[:2]] == [("a", "C/Berlin"), ("a", "C/Big")] and len(rows) == 4 and "wall" in rows[0]["content"]
    assert rows[2]["content"] == "First" and not rows[3]["success"]
    rows = engine.get(["C/Berlin", "C/Big", "M/Title"], archive="b").collect()
    assert [r["canonical"] for r in rows[:2]] == ["C/Berlin", "C/Berlin"] and all("zeppelin" in r["content"] for r in rows[:2]) and rows[2]["content"] == "Second"
    raw = engine.get(["C/Cat.png"], "binary").first()
    assert (raw["content"], raw["size"], raw["truncated"], raw["mimetype"]) == ("cG5nIGJ5dGVz", 9, False, "image/png")
    assert engine.get(["C/Cat.png"], "binary", max_chars=4).first()["truncated"]


def test_redirects_and_links_stay_in_their_archive(engine):
    assert {(r["archive"], r["canonical"], r["state"]) for r in engine.redirects.where("path = 'C/Big'").collect()} == {("a", "C/Big", "ok"), ("b", "C/Berlin", "ok")}
    assert [(r["target"], r["target_title"]) for r in engine.links("C/Berlin", archive="a").results] == [("C/Big", "Big")]
    assert [(r["target"], r["target_title"]) for r in engine.links("C/Berlin", archive="b").results] == [("C/Berlin", "Berlin"), ("C/Cat.png", "Cat.png")]
    assert [r["path"] for r in engine.links("C/Berlin", "inbound").results] == ["C/Hamburg"] and engine.links("C/Berlin", "inbound", archive="b").results == []
    assert engine.section("C/Berlin", "berlin", archive="b").first()["text"].count("zeppelin") == 1 and engine.section("C/Berlin", "berlin").count() == 1


def test_synthesis_cites_the_archive_of_the_text(engine):
    passages, answer = engine.synthesize("zeppelin hall")
    rows = passages.collect()
    assert {r["cite_id"] for r in rows} == {"b/C/Hamburg#hamburg", "b/C/Berlin#berlin"} and all("zeppelin" in r["passage"] for r in rows)
    assert answer.first()["answer"].count("[cite: b/") == 2
    assert engine.considered_sections(passages).count() == 0


def test_a_scorer_reranks_the_passages(entries, engine):
    query = "where did a zeppelin land near ships"
    before = {r["cite_id"]: len(r["passage"]) for r in engine.synthesize(query)[0].collect()}
    engine.scorer = lambda: lambda q, t: [float(-len(x)) for x in t]
    try:
        after = [r["cite_id"] for r in engine.synthesize(query)[0].collect()]
    finally:
        engine.scorer = None
    assert after == sorted(before, key=before.get)


def test_a_broken_scorer_changes_nothing(spark):
    hits = spark.createDataFrame([("x", "p", 1, 0.9, "aa"), ("y", "q", 2, 0.8, None)], "archive string, path string, rn int, score double, text string")

    def broken():
        raise OSError("no model")

    for scorer in (broken, lambda: lambda q, t: [float("nan")] * len(t), lambda: lambda q, t: []):
        got = RR.rerank(hits, "one two three four", "text", scorer, ["archive", "path"])
        assert [tuple(r)[:4] for r in got.select("archive", "path", "rn", "score").orderBy("rn").collect()] == [("x", "p", 1, 0.9), ("y", "q", 2, 0.8)]


def test_reranked_hits_go_back_to_their_archives(spark):
    rows = [("x", "p", 1, 0.9, "aa"), ("x", "q", 2, 0.8, "a"), ("y", "p", 3, 0.7, "aaa"), ("y", "r", 4, 0.6, "")]
    hits = spark.createDataFrame(rows, "archive string, path string, rn int, score double, text string")
    got = RR.redistributed(RR.rerank(hits, "one two three four", "text", lambda: lambda q, t: [len(x) for x in t], ["archive", "path"]))
    assert [(r["archive"], r["path"], r["rn"], r["score"], r["archive_rn"]) for r in got.orderBy("rn").collect()] == [("y", "p", 1, 3.0, 1), ("x", "p", 2, 2.0, 1), ("x", "q", 3, 1.0, 2), ("y", "r", 4, 0.0, 2)]
    assert RR.rerank(hits, "too short", "text", None, ["archive", "path"]) is hits


def test_a_stored_index_of_other_entries_is_refused(spark, entries, tmp_path):
    folder = f"file://{tmp_path}/index"
    assert Engine(entries, folder).search("zeppelin").total == 2 and Engine(entries, folder).search("zeppelin").total == 2
    with pytest.raises(ValueError, match="other entries"):
        Engine(entries.where("archive = 'a'"), folder).search("zeppelin")


def test_structure_view(engine):
    import json

    got = json.loads(engine.get(["C/Hamburg"], "structure").first()["content"])
    assert got["headings"] == [{"level": 1, "text": "Hamburg", "id": "hamburg", "id_source": "slug"}] and got["sections"][0]["content_preview"].startswith("Port.") and got["sections"][0]["word_count"] > 0


def test_failing_and_slow_archives_leave_the_others(spark, entries):
    def slow(batches):
        for b in batches:
            time.sleep(60)
            yield b

    b = entries.where("archive = 'b'")
    library = Library(spark, {"b": b, "broken": lambda: entries.where(F.raise_error(F.lit("damaged")).isNull()), "gone": lambda: 1 / 0, "slow": lambda: b.coalesce(1).mapInArrow(slow, b.schema)})
    library.engine("b").search("zeppelin")  # built beforehand
    began = time.monotonic()
    got = library.search_all("zeppelin", budget=12)
    assert time.monotonic() - began < 30
    rows = {r["archive"]: r for r in got["results"]}
    assert rows["b"]["has_hits"] and len(rows["b"]["result"].results) == 2 and rows["broken"]["error"] and "damaged" in rows["broken"]["error_message"] and "ZeroDivisionError" in rows["gone"]["error_message"]
    assert got["files_late"] == ["slow"] and got["meta"]["reasons"] == ["search_all_budget_exceeded", "archive_unavailable"] and not got["done"]
    assert (got["files_available"], got["files_searched"], got["files_failed"], got["files_with_hits"]) == (4, 3, 2, 1)
    with pytest.raises(ValueError):
        library.search_all("?!")
    library.close()


def test_jobs_apart_without_a_limit(spark):
    got = apart(spark, {"one": lambda: spark.range(3).count(), "two": lambda: {}["x"]}, 0)
    assert [(o.name, o.value, o.late, bool(o.error)) for o in got] == [("one", 3, False, False), ("two", None, False, True)]
    assert apart(spark, {}) == []
