"""Links and near-duplicates with small tables sent to every task, with shuffled ones, and how many tasks they take."""

import random

import pytest

from pairloom.llm import components, minhash, shared
from tests.llm.test_minhash import _edited, _same, _table


def _tasks(spark, f):
    """How many tasks run during f where every shuffle has 50 partitions."""
    held = {"spark.sql.shuffle.partitions": "50", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    tracker, before = spark.sparkContext.statusTracker(), {k: spark.conf.get(k) for k in held}
    spark.sparkContext.setJobGroup("few-tasks", "")

    def last():
        spark.sparkContext.parallelize([1], 1).count()
        return max(s for j in tracker.getJobIdsForGroup("few-tasks") for s in tracker.getJobInfo(j).stageIds)

    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        first = last()
        f()
        return sum(i.numCompletedTasks for i in map(tracker.getStageInfo, range(first + 1, last())) if i)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


@pytest.fixture
def shuffled(monkeypatch):
    """No side of a join counts as small."""
    for module in (shared, minhash, components):
        monkeypatch.setattr(module, "BROADCAST_ROWS", 0)


def _crowd():
    r = random.Random(12)
    base = [f"w{k}" for k in range(160)]
    return [(k, _edited(r, base, 5)) for k in range(90)]


def test_a_crowd_takes_few_tasks(spark):
    docs = _table(spark, _crowd()).cache()
    docs.count()
    assert _tasks(spark, lambda: minhash.minhash_query(docs).count()) < 1100


def test_a_crowd_by_shuffles(spark, shuffled):
    _same(spark, _crowd())


def test_a_shared_pivot_by_shuffles(spark, shuffled, monkeypatch):
    monkeypatch.setattr(minhash, "HEAVY", 10)
    r = random.Random(2)
    base = [f"w{k}" for k in range(100)]
    _same(spark, [(k, _edited(r, base, 1)) for k in range(60)])


def _roots(links):
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        if a is not None and b is not None and a != b:
            a, b = sorted((top(a), top(b)))
            up[b] = a
    return {x: top(x) for x in up}


def _links():
    r = random.Random(4)
    chain = [(k, k + 1) for k in range(40)]
    r.shuffle(chain)
    hub = [(500, k) for k in range(501, 560)] + [(560, 500), (500, 560), (500, 560)]
    return chain + hub + [(r.randrange(1000, 1100), r.randrange(1000, 1100)) for _ in range(70)] + [(None, 1), (2, None), (7, 7), (2000, 2000)]


def _got(spark, links):
    rows = components.components(spark.createDataFrame(links, "a long, b long")).collect()
    got = {r.node: r.root for r in rows}
    assert len(got) == len(rows)
    return got


def test_components(spark):
    assert _got(spark, _links()) == _roots(_links())
    assert _got(spark, [(None, 1), (3, 3)]) == {}


def test_components_by_shuffles(spark, shuffled):
    assert _got(spark, _links()) == _roots(_links())


def test_stars_take_no_round(spark):
    stars = spark.createDataFrame([(k, k % 7) for k in range(7, 300)] + [(3, 45)], "a long, b long").cache()
    stars.count()
    assert _tasks(spark, lambda: components.components(stars).count()) < 300
