"""The entry module: names, oracles, and every query against its oracle on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
OWN = {k: v for k, v in entry.queries().items() if not (k.startswith("op") or k == "pipeline")}


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def _cell(x):
    return round(x, 6) if isinstance(x, float) else x


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(OWN) > 60


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(OWN))
def test_query(spark, duck, sf, name):
    df = OWN[name](spark, sf)
    cols = sorted(df.columns)
    rows = sorted(str([_cell(r[c]) for c in cols]) for r in df.collect())
    if name in entry.oracle_sql():
        rel = duck.execute(entry.oracle_sql()[name])
        names = [d[0] for d in rel.description]
        assert sorted(names) == cols
        want = sorted(str([_cell(r[names.index(c)]) for c in cols]) for r in rel.fetchall())
        assert rows == want
    else:
        assert rows
