"""Columns of documents may have any name: no operator or stage mistakes one for its own."""

import pytest
from pyspark.sql import functions as F

from pairloom.llm import decontam, html_main, lines, media, mixing, quality, sharding, simhash, substring, toxicity

#: Names that operators give to columns of their own, results and inner ones.
NAMES = (
    "rk rk_ a b k d d_ x y n nn id ka kb row row_ key key_ own all blank stay lines_ blank_ copy_ score size size_ taken copies target source_size u v p base even digits cell v_cut key_cut spans kept kept_sha256 n_words "
    "n_removed n_lines n_near first line pos norm h g fp root lead rows component_id label w s m items shard slot law group_hash offset rank main_text n_blocks n_content p_toxic is_toxic n_telling html url"
).split()
OWN = {"mix": mixing.OWN, "substring": substring.OWN, "lines": lines.OWN, "quality": ("score",), "toxicity": toxicity.OWN, "html": html_main.OWN}


@pytest.fixture(scope="module")
def docs(spark):
    texts = [None, "", "one", "A line.\nA line.\nA lime.", " ".join(f"w{k}" for k in range(80)), " ".join(f"w{k}" for k in range(80)), "x " * 300, "moron idiot clown"]
    rows = spark.createDataFrame([(i if i != 5 else None, t, "en", f"s{i % 2}", None) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    return rows.select("*", *[F.concat(F.lit(f"{c} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias(c) for c in NAMES])


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, int(i == 7)) for i in range(9)], "doc_id long, quality int, toxic int")


def _kept(out, docs, own):
    cols = [c for c in docs.columns if c not in own]
    assert set(cols) <= set(out.columns)
    assert sorted(map(str, out.select(*cols).collect())) == sorted(map(str, docs.select(*cols).collect()))


@pytest.mark.parametrize("name", OWN)
def test_operators_keep_columns(docs, labels, name):
    out = {
        "mix": lambda: mixing.mix(docs), "substring": lambda: substring.dedup(docs), "lines": lambda: lines.dedup(docs), "quality": lambda: quality.score(docs, quality.fit(docs, labels)),
        "toxicity": lambda: toxicity.score(docs, toxicity.fit(docs, labels)), "html": lambda: html_main.extract(docs),
    }[name]()
    _kept(out, docs, OWN[name])


@pytest.mark.parametrize("name", ["quality", "simhash", "decontam", "mix"])
def test_stages_return_rows_as_they_were(spark, docs, labels, name):
    items = spark.createDataFrame([(1, "x x x x x x"), (2, None)], "item_id long, text string")
    out = {"quality": lambda: quality.good_docs(docs, labels), "simhash": lambda: simhash.one_per_group(docs), "decontam": lambda: decontam.clean_docs(docs, items), "mix": lambda: mixing.mixed_docs(docs)}[name]()
    assert out.columns == docs.columns
    assert set(map(str, out.collect())) <= set(map(str, docs.collect()))


def test_queries_do_not_mind(docs, labels):
    assert sharding.sharded_query(docs).count() == media.media_query(docs).count() == docs.count()
    plain = docs.select("doc_id", "text", "source")
    for query in (sharding.sharded_query, simhash.simhash_query, mixing.mixed_query, lines.lines_query, substring.substring_query):
        assert sorted(map(str, query(docs).collect())) == sorted(map(str, query(plain).collect()))
