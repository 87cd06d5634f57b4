import os
import sys

sys.path.insert(0, os.path.dirname(__file__))
import corpus  # noqa: E402


def test_stages(spark, tmp_path):
    import corpus_pipeline

    corpus.frame(spark).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept, str(tmp_path))
        assert out.columns == docs.columns, name
        out.write.parquet(f"{tmp_path}/{name}")
        kept = spark.read.parquet(f"{tmp_path}/{name}")
    ids = {r["doc_id"] for r in spark.read.parquet(f"{tmp_path}/jaccard_join").collect()}
    assert {6, 8} <= ids and not {4, 5, 9, 10, 30, 31, 32, 33} & ids
    assert set(range(13, 30)) <= ids
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.filter("not lossless").count() == 0
    assert {r["doc_id"] for r in got.select("doc_id").distinct().collect()} == {r["doc_id"] for r in kept.collect()}


def test_empty_tables(spark, tmp_path):
    import corpus_pipeline

    corpus.empty(spark).write.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, corpus.empty(spark), str(tmp_path))
        assert out.columns == corpus.COLUMNS and out.count() == 0, name
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_queries_are_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
    assert set(entry.oracle_sql()) <= set(names)
