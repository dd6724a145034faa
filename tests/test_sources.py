"""Round trips through files, the source registry and the stream."""

import pytest
from pyspark.sql import functions as F

from pairloom.operators import sentences
from pairloom.sources import cases, files
from pairloom.sources.registry import Sources
from pairloom.streaming import curation


def test_json_lines(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"corrupted": "a", "clean": "b", "difficulty_score": 0}\n\n{"corrupted": "c"\n{"corrupted": "d", "clean": "e f", "num_errors": 2}\n')
    rows = files.with_defaults(files.read_permissive(spark, str(p))).orderBy("corrupted").collect()
    assert [(r.corrupted, r.domain, r.num_errors, r.word_count, r.difficulty_score) for r in rows] == [("a", "unknown", 0, 1, None), ("d", "unknown", 2, 2, None)]
    assert files.bad_lines(spark, str(p)).count() == 1
    with pytest.raises(Exception):
        files.read_strict(spark, str(p)).collect()


def test_pool_document(spark, tmp_path):
    pool = spark.createDataFrame([("a", "One."), ("a", "Two."), ("b", "Three.")], "domain string, sentence string")
    (tmp_path / "pool.json").write_text(files.pool_document(pool).first().value)
    back = files.read_pool(spark, str(tmp_path / "pool.json"))
    assert sorted((r.domain, r.sentence) for r in back.collect()) == [("a", "One."), ("a", "Two."), ("b", "Three.")]
    files.write_pool(pool, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out/sentences")).count() == 3
    assert spark.read.json(str(tmp_path / "out/metadata")).first().total_sentences == 3


def test_any_and_guess(spark, tmp_path):
    (tmp_path / "x.csv").write_text('noisy,clean\n"a ""q""\nb",c\n')
    df = files.read_any(spark, str(tmp_path / "x.csv"))
    assert files.guess_columns(df) == ("noisy", "clean") and df.first().noisy == 'a "q"\nb'
    (tmp_path / "x.jsonl").write_text('{"n": 1, "p": "a", "q": "b"}\n')
    assert files.guess_columns(files.read_any(spark, str(tmp_path / "x.jsonl"))) == ("p", "q")
    with pytest.raises(ValueError):
        files.guess_columns(df.select("noisy"))


def test_cache(spark, tmp_path):
    df = spark.createDataFrame([([1, 2],)], "input_ids array<int>")
    files.write_cache(df, str(tmp_path / "c"), model="m", max_length="8")
    assert files.read_cache(spark, str(tmp_path / "c"), model="m").first().input_ids == [1, 2]
    with pytest.raises(ValueError):
        files.read_cache(spark, str(tmp_path / "c"), model="other")
    with pytest.raises(Exception):
        files.read_cache(spark, str(tmp_path / "none"), model="m")


def test_checkpoints_in_order(spark):
    got = files.checkpoints(spark, ["r/checkpoint-1000", "r/checkpoint-500", "r/last/"]).orderBy("step").collect()
    assert [(r.checkpoint, r.step) for r in got] == [("last", 0), ("checkpoint-500", 500), ("checkpoint-1000", 1000)]


def test_report(spark):
    import json

    got = json.loads(files.report(a=spark.range(2), b=spark.range(1)).first().value)
    assert got == {"a": [{"id": 0}, {"id": 1}], "b": [{"id": 0}]}


def test_registry(spark, sf):
    s = Sources("docs").table("docs", f"{sf}/documents.parquet").table("gone", "/nowhere.parquet").table("bench", f"{sf}/benchmark.parquet", key="item_id")
    assert s.load(spark, "unknown", 5).count() == 5 and s.load(spark, "gone").count() == len(cases.SAMPLES)
    assert s.blend(spark, {"docs": 0.6, "bench": 0.2}, 50).groupBy("source").count().count() == 2
    assert files.texts(spark, ["a", "b"]).count() == 2


def test_stream_matches_batch(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("doc_id") % 60))
    docs.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = curation.curated(spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("curated").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("curated").count() == sentences.pool(docs).count()
    assert curation.domain_counts(spark.table("curated")).count() > 0
