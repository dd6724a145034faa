"""The stored fingerprints across runs and sessions."""

import pytest
from pyspark.sql import functions as F

from pairloom.sources import seen as store


@pytest.fixture
def path(tmp_path):
    return f"file://{tmp_path}/seen"


def _rows(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id long, t string")


def _run(spark, at, texts, run, path):
    return sorted((r.id, r.t) for r in store.first_seen(at, _rows(spark, texts), F.lower("t"), ["id"], run, f"{path}-{run}").collect())


def test_runs(spark, path, monkeypatch):
    monkeypatch.setattr(store, "WORDS", 1 << 10)
    at = store.Seen(spark, path, 4)
    assert _run(spark, at, ["a", "B", "b", None, None, "c"], "one", path) == sorted([(0, "a"), (1, "B"), (5, "c"), (3, None), (4, None)], key=lambda x: x[0])
    assert _run(spark, at, ["C", "d", "A", "e", None], "two", path) == [(1, "d"), (3, "e"), (4, None)]
    assert _run(spark, at, ["C", "d", "A", "f"], "two", path) == [(1, "d"), (3, "f")]  # a repeated run replaces its entries
    assert _run(spark, at, ["e", "f", "g"], "three", path) == [(0, "e"), (2, "g")]
    assert _run(spark, at, [], "four", path) == []
    spark.sql(f"DROP TABLE {at.name}")  # another session knows nothing of the table
    again = store.Seen(spark, path)
    assert again.buckets == 4 and again.fingerprints().distinct().count() == 7
    assert _run(spark, again, ["g", "h"], "five", path) == [(1, "h")]
    with pytest.raises(ValueError):
        store.first_seen(again, _rows(spark, []), F.col("t"), ["id"], "a/b", path)


def test_full_filter_gives_the_same(spark, path, monkeypatch):
    monkeypatch.setattr(store, "WORDS", 1)
    at = store.Seen(spark, path, 2)
    texts = [f"t{i}" for i in range(300)]
    assert len(_run(spark, at, texts, "one", path)) == 300
    assert _run(spark, at, [*texts[50:], "new"], "two", path) == [(250, "new")]


def test_stored_side_stays_where_it_is(spark, path, monkeypatch):
    monkeypatch.setattr(store, "WORDS", 1 << 10)
    at = store.Seen(spark, path, 4)
    _run(spark, at, [f"t{i}" for i in range(50)], "one", path)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = _rows(spark, ["t1", "x"]).select(F.md5("t").alias("fp"), "id")
        plan = at.new(rows, "two")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    join = plan[plan.index("SortMergeJoin") :]
    stored = join[join.index("PartitionFilters: [isnotnull(run") - 400 :]
    assert "Bucketed: true" in stored and plan.count("Exchange hashpartitioning(fp") == 1
