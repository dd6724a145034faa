"""Long texts, many prompts and whole batches: what a query costs grows with its texts, not with their square."""

import time
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from pairloom.functions import rng, text
from pairloom.operators import corruption, evaluation, tokens


def test_case_of_a_long_text_takes_linear_time(spark):
    """the places of capitals were found again for each character of the other text."""
    rows = spark.createDataFrame([("Ab c" * 5_000, "xY" * 11_000)], "a string, b string")
    began = time.time()
    got = rows.select(text.preserve_case(F.col("a"), F.col("b")).alias("kept")).first().kept
    assert time.time() - began < 20
    assert got == "".join(c.upper() if i < 20_000 and i % 4 == 0 else c.lower() for i, c in enumerate("xY" * 11_000))


def test_cases_come_without_a_shuffle(spark, sf):
    """a case and all that prompts make of it stand in one row."""
    for name in ("case_preserve", "prompt_sweep_best"):
        plan = entry.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Join" not in plan, name


@pytest.mark.parametrize("step", ["a", "hit"])
def test_draws_with_a_head_are_the_same(spark, step):
    rows = spark.range(300).select(F.when(F.col("id") % 7 != 0, F.col("id")).alias("k"), (F.col("id") % 3).alias("i"))
    a, b = corruption.Draws("k", "i"), corruption.Draws(head=rng.continued(rng.head("k"), F.col("i")))
    for r in rows.select(a(step).alias("x"), b(step).alias("y"), b.at(F.lit(4))(step).alias("u"), a.at(F.lit(4))(step).alias("v"), *[c for p in (0, 0.3, 1) for c in (a.hit(step, p), rng.chance(a(step), p))]).collect():
        assert r.x == r.y and r.u == r.v and r[4] == r[5] and r[6] == r[7] and r[8] == r[9]


def test_best_of_is_best_prompt(spark):
    said = [("p", "the cat sat"), ("q", "The cat, sat down."), ("r", "the cat sat"), ("s", "sat down the cat")]
    one = spark.createDataFrame([(7, "The cat sat down.", *[p for _, p in said])], "case_id int, expected string, p string, q string, r string, s string")
    got = one.select("case_id", evaluation.best_of("expected", [(n, F.col(n)) for n, _ in said]).alias("b")).select("case_id", "b.*").first()
    many = spark.createDataFrame([(7, n, i, "The cat sat down.", p) for i, (n, p) in enumerate(said)], "case_id int, prompt string, prompt_order int, expected string, predicted string")
    want = evaluation.best_prompt(many).first()
    assert got == want and got.prompt == "q"


def test_a_tokenizer_gets_little_at_a_time(monkeypatch):
    """a batch of ten thousand texts was encoded at once, whose results take some hundred times its memory."""
    pd = pytest.importorskip("pandas")
    most = []

    class Fake:
        def encode_batch(self, texts, add_special_tokens):
            most.append(sum(map(len, texts)) if len(texts) > 1 else 0)
            return [SimpleNamespace(ids=[ord(c) for c in t]) for t in texts]

        def decode_batch(self, ids, skip_special_tokens):
            most.append(sum(map(len, ids)) if len(ids) > 1 else 0)
            return ["".join(map(chr, x)) for x in ids]

    monkeypatch.setattr(tokens, "_tokenizer", lambda path: Fake())
    texts = ["ab" * n for n in range(1500)] + [None, "x" * 1_000_000, ""]
    ids = list(tokens.subword_ids("", None).func(iter([pd.Series(texts)])))
    back = list(tokens.subword_text("").func(iter(ids)))
    assert max(most) <= tokens.PIECE
    assert [t for s in back for t in s] == [t or "" for t in texts]


def test_known_words_need_not_travel(spark):
    """every word of every sentence was moved with its neighbours, also those that the caller knows to be in the vocabulary."""
    from pairloom.operators import spelling

    rows = spark.createDataFrame([(1, ["the", "cxt", "sat"], [False, True, False]), (2, ["--", "cat"], [True, False])], "id int, words array<string>, odd array<boolean>")
    assert [(r.id, r.nth, r.before, r.q, r.after) for r in spelling.tokens(rows, ["id"], doubtful="odd").collect()] == [(1, 1, "the", "cxt", "sat")]
    known = spark.createDataFrame([("the", 2), ("cat", 1), ("cut", 1), ("sat", 1)], "word string, n long")
    follow = spark.createDataFrame([("cut", "sat", 3)], "a string, b string, n long")
    got = spelling.changes(rows, known, follow, ["id"], doubtful="odd").collect()
    assert [(r.id, r.changes_) for r in got] == [(1, {1: "cut"})]


def test_noisy_rows_are_stored_small(spark, sf):
    """the words were stored three times over; now once, with the changed ones."""
    from pairloom.plans import lookups

    stored = lookups._stored(spark, sf)
    assert stored.columns == ["doc_id", "pos", "line", "made"]
    rows = lookups._words(stored)
    assert rows.where("size(clean) <> size(words) OR size(words) <> size(doubtful)").count() == 0
    assert rows.where("exists(arrays_zip(clean, words, doubtful), x -> (x.clean = x.words) = x.doubtful)").count() == 0
