"""Whole texts: what comes after the tenth piece of a document, and after a sentence's first word, counts."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from pairloom.operators import sentences

NAMES = ("Anna", "Boris", "Clara", "David", "Emma", "Frank", "Greta", "Henry", "Irene", "James", "Karen", "Louis", "Maria", "Nolan", "Olga")


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """One document of 15 unlike good sentences, and a benchmark item that repeats its last one after 12 others."""
    path = str(tmp_path_factory.mktemp("whole"))
    text = " ".join(f"{n} would definitely jump home quickly then." for n in NAMES)
    spark.createDataFrame([(1, text)], "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    earlier = " ".join(f"Sentence {n} is about another thing." for n in NAMES[:12]) + " " + text.split(". ")[-1]
    spark.createDataFrame([(1, earlier)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


@pytest.mark.parametrize("name,n", [("quality_filter", 15), ("fingerprint", 15), ("fingerprint_dedup", 15), ("domain_classify", 15), ("dedup_across_runs", 14), ("pair_edit", 15)])
def test_all_pieces(spark, tables, name, n):
    assert entry.queries()[name](spark, tables).count() == n


def test_pool_is_whole(spark, tables):
    assert sentences.pool(spark.read.parquet(f"{tables}/documents.parquet")).count() == 15
    assert entry.queries()["corrupt_sentences"](spark, tables).count() == 15


@pytest.mark.parametrize("name", ["pair_keyboard", "pair_character", "pair_phonetic", "pair_contraction", "pair_compound", "pair_double_letter", "corrupt_words"])
def test_every_word(spark, tables, name):
    rows = entry.queries()[name](spark, tables)
    assert rows.count() == 15 * 7 and rows.select("pos", "nth").distinct().count() == 15 * 7
    assert rows.where(F.col("word") == "definitely").count() == 15


def test_then_in_sentences(spark, tables):
    rows = entry.queries()["contextual_then_than"](spark, tables)
    assert rows.count() == 15 and rows.where("made like '%definitely jump home quickly then.'").count() == 15
