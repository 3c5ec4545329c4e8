"""Folder streams, the streamed link graph, respelt requests and subject sections."""

import os
import shutil

from pyspark.sql import functions as F

from textquarry.operators import graph_store as GS
from textquarry.operators import respell, subjects
from textquarry.streaming import folder, graph, watch


def test_a_folder_as_a_stream(spark, tmp_path):
    home, seen = tmp_path / "zims", []
    home.mkdir()

    def scan():
        rows = folder.folder_stream(spark, str(home), str(tmp_path / "scans")).select(F.regexp_extract("path", "[^/]*$", 0).alias("name"), "*")
        rows = rows.select(F.when(F.col("path").isNotNull(), F.col("name")).alias("path"), "mtime", "size", "complete")
        watch.watch(rows, lambda df, n: seen.append({tuple(r) for r in df.collect()}), str(tmp_path / "state"), str(tmp_path / "check"), available_now=True).awaitTermination()

    (home / "a.zim").write_bytes(b"one")
    (home / "b.zim").write_bytes(b"two")
    (home / "notes.txt").write_bytes(b"not listed")
    scan()
    (home / "sub").mkdir()
    (home / "sub" / "c.zim").write_bytes(b"three")
    (home / "a.zim").write_bytes(b"one more")
    os.utime(home / "a.zim", (5, 5))
    os.remove(home / "b.zim")
    scan()
    scan()  # nothing new: no batch
    os.remove(home / "a.zim")
    os.remove(home / "sub" / "c.zim")
    scan()
    assert seen == [{("a.zim", "added"), ("b.zim", "added")}, {("a.zim", "changed"), ("b.zim", "removed"), ("c.zim", "added")}, {("a.zim", "removed"), ("c.zim", "removed")}]


def test_an_incomplete_scan_removes_nothing(spark, tmp_path):
    seen = []
    schema = "path string, mtime double, size long, complete boolean"
    for i, rows in enumerate(([("a", 1.0, 1, True), ("b", 1.0, 1, True)], [(None, None, None, False), ("a", 2.0, 1, False)], [(None, None, None, True), ("b", 1.0, 1, True)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in" / "*"))
        watch.watch(stream, lambda df, n: seen.append({tuple(r) for r in df.collect()}), str(tmp_path / "state"), str(tmp_path / "check")).awaitTermination()
    assert seen == [{("a", "added"), ("b", "added")}, {("a", "changed")}, {("a", "removed")}]


def test_listing_tells_what_it_could_not_read(tmp_path, monkeypatch):
    (tmp_path / "x.zim").write_bytes(b"1")
    files, complete = folder.listing(str(tmp_path), ".zim")
    assert complete and [(f[0].rsplit("/", 1)[1], f[2]) for f in files] == [("x.zim", 1)]
    assert folder.listing(str(tmp_path / "missing"), ".zim") == ([], False)
    reader = folder.FolderReader({"path": str(tmp_path), "state": str(tmp_path / "state"), "suffix": ".zim"})
    assert reader.initialOffset() == {"scan": 0} and reader.latestOffset() == reader.latestOffset() == {"scan": 1}
    assert reader.partitions({"scan": 1}, {"scan": 1}) == [] and len(list(reader.read(reader.partitions({"scan": 0}, {"scan": 1})[0]))) == 2
    (tmp_path / "y.zim").write_bytes(b"22")
    assert reader.latestOffset() == {"scan": 2} and len(list(reader.read(folder._Scan(1)))) == 2  # an earlier scan reads the same again


def test_a_streamed_graph_is_that_of_a_rebuild(spark, tmp_path):
    schema = "path string, target string, anchor string"
    links = lambda b: b.where("target is not null").select(F.col("path").alias("source"), "target", "anchor")
    batches = [
        [("A", "T", "t"), ("A", "B", "b"), ("B", "T", "t"), ("C", "A", "a"), ("C", "A", "again"), ("C", "C", "self")],
        [("A", "B", "b"), ("D", "T", "t")],  # A again, without its link to T
        [("C", None, None), ("B", "A", "a"), ("B", "T", "t")],  # C lost all links, B gained one
    ]
    root, latest = str(tmp_path / "graph"), {}
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in" / "*"))
        graph.build(stream, links, root, str(tmp_path / "check")).awaitTermination()
        if i == 1:  # the batch dies before it is marked as done and is run again
            for name in ("commits", "commits/.1.crc"):
                for f in (tmp_path / "check" / "commits").glob("*1*"):
                    os.remove(f)
        for path in {r[0] for r in rows}:
            latest[path] = {r[1] for r in rows if r[0] == path and r[1] and r[1] != path}
    want = sorted((p, t) for p, ts in latest.items() for t in ts)
    assert sorted((r["source"], r["target"]) for r in graph.edges_of(spark, root).collect()) == want
    degrees = {}
    for _, t in want:
        degrees[t] = degrees.get(t, 0) + 1
    assert {r["path"]: r["inbound_degree"] for r in graph.degrees_of(spark, root).collect()} == degrees
    mark = graph.merge(spark, root, str(tmp_path / "stored"), "uuid")
    rebuilt = spark.createDataFrame([(s, t, "") for s, t in want], "source string, target string, anchor string")
    assert mark == graph.fingerprint(rebuilt)
    edges, nodes = GS.open_graph(spark, str(tmp_path / "stored"), "uuid")
    assert edges.count() == len(want) and {r["path"]: r["inbound_degree"] for r in nodes.collect() if r["inbound_degree"]} == degrees
    shutil.rmtree(tmp_path / "graph")
    assert graph.edges_of(spark, root).count() == 0 == graph.degrees_of(spark, root).count()


def test_requests_are_respelt_in_one_plan(spark):
    asked = spark.createDataFrame([(1, " (Recieve)  the\tgoverment's seperate "), (2, "Teh Beatles"), (3, None), (4, ""), (5, "recieved 'teh' teh,"), (1, "teh")], "id long, query string")
    wrong = spark.createDataFrame([("recieve", "receive"), ("Goverment", "government"), ("seperate", "separate"), ("teh", "the")], "word string, spelling string")
    titles = spark.createDataFrame([("Seperate",), (None,)], "title string")
    got = sorted(((r["id"], r["query"], r["respelt"]) for r in respell.respelt(asked, wrong, titles).collect()), key=str)
    assert got == sorted([(1, " (Recieve)  the\tgoverment's seperate ", " (receive)  the\tgovernment's seperate "), (2, "Teh Beatles", "the Beatles"), (3, None, None), (4, "", ""), (5, "recieved 'teh' teh,", "recieved 'the' the,"), (1, "teh", "the")], key=str)
    kept = respell.respelt(asked.where("id = 2"), wrong, exclusions=spark.createDataFrame([("TEH",)], "word string"))
    assert kept.first()["respelt"] == "Teh Beatles"


def test_subject_sections(spark):
    asked = spark.createDataFrame([("p", "famous musicians from big rapids", "Big Rapids, Michigan"), ("p", "famous big rapids", "Big Rapids"), ("p", "music", "Music"), ("q", "actors of x", "X"), ("p", "sports people", "")], "page string, topic string, title string")
    heads = spark.createDataFrame([("p", 0, 2, "Notable people"), ("p", 1, 2, "Microfilm"), ("p", 2, 3, "Musicians"), ("p", 3, 2, " Music and dance "), ("q", 0, 2, "Content"), ("q", 1, 2, "Films"), ("q", 2, 1, "Film")], "page string, pos int, level int, title string")
    got = {(r["topic"], r["subject"], r["pos"], r["section"]) for r in subjects.subject_sections(asked, heads, "page").collect()}
    assert got == {("famous musicians from big rapids", "musicians", 3, "Music and dance")}
