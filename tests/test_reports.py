"""Reports that come with the write, pool documents, and profiles by several columns at once."""

import json
from collections import Counter
from itertools import combinations

from pyspark.sql import functions as F

from pairloom.operators import profiling
from pairloom.sources import files


def test_pool_report_is_what_was_written(spark, tmp_path):
    rows = [("general", f"s{i % 7}") for i in range(50)] + [("creative", "ä")] * 3
    pool = spark.createDataFrame(rows, "domain string, sentence string").repartition(4)
    path = f"file://{tmp_path}/pool"
    meta = files.write_pool(pool, path)
    read = spark.read.schema("sentence string, domain string").json(f"{path}/sentences")
    assert Counter((r.domain, r.sentence) for r in read.collect()) == Counter(rows)
    assert meta["domain_counts"] == {"creative": 3, "general": 50} and meta["total_sentences"] == 53 and meta["total_chars"] == 103
    assert spark.read.json(f"{path}/metadata").first().total_sentences == 53
    assert files.write_pool(pool.limit(0), f"{path}-empty")["total_sentences"] == 0


def test_pool_documents(spark, tmp_path):
    pool = spark.createDataFrame([(1, "a", "x"), (1, "a", "y"), (1, "b", "z"), (2, "a", "x")], "doc_id long, domain string, sentence string")
    found = [json.loads(r.value) for r in files.pool_documents(pool, "doc_id").collect()]
    assert sorted(d["metadata"]["total_sentences"] for d in found) == [1, 3]
    path = f"file://{tmp_path}/documents"
    files.pool_documents(pool, "doc_id").write.text(path)
    assert sorted((r.domain, r.sentence) for r in files.read_pool(spark, path, lines=True).collect()) == [("a", "x"), ("a", "x"), ("a", "y"), ("b", "z")]


def test_observed_write(spark, tmp_path):
    df = spark.range(1000).repartition(7)
    got = files.write_observed(df, f"file://{tmp_path}/x", n=F.count("*"), least=F.min("id"), most=F.max("id"))
    assert got == {"n": 1000, "least": 0, "most": 999} and spark.read.parquet(f"file://{tmp_path}/x").count() == 1000


def test_cube(spark):
    rows = [("a", None, 1), ("a", "x", 2), (None, "x", 3), ("b", "y", 4), ("b", None, 5)]
    got = Counter(tuple(r) for r in profiling.cube(spark.createDataFrame(rows, "p string, q string, v int"), ["p", "q"], 2, n=F.count("*"), total=F.sum("v")).collect())
    want = Counter()
    for k in range(3):
        for chosen in combinations((0, 1), k):
            level = sum(2 - i for i in (0, 1) if i not in chosen)
            groups = {}
            for r in rows:
                groups.setdefault(tuple(r[i] if i in chosen else None for i in (0, 1)), []).append(r[2])
            want.update((level, *g, len(v), sum(v)) for g, v in groups.items())
    assert got == want
