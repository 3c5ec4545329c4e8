import corpus_pipeline
from textquarry.catalog import table

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = table(spark, FOLDER, "documents")
    columns, ids = docs.columns, {r["doc_id"] for r in docs.select("doc_id").collect()}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, FOLDER)
        assert i == 4 or out.columns == columns, name
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        now = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert now <= ids and (name != "mixing" or now == ids)
        ids = now
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "mixing", "sharding"]
    ran = corpus_pipeline.run(spark, FOLDER)
    assert sorted(map(tuple, ran.select("doc_id", "shard").collect())) == sorted(map(tuple, docs.select("doc_id", "shard").collect()))


def test_stages_take_odd_and_empty_tables(spark, frame, odd):
    for rows in (odd, []):
        docs = frame(rows)
        for name, stage in corpus_pipeline.STAGES:
            assert stage(spark, docs, FOLDER).count() <= 2 * len(rows), name
