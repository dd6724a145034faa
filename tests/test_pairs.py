"""Scoring, validation, sampling and corruption."""

import random

import pytest
from pyspark.sql import functions as F

from pairloom.functions import lexicons, rng, text
from pairloom.operators import chat, corruption, evaluation, metrics, profiling, sampling, scoring, tokens, validation


def one(spark, f, *values):
    df = spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(f(*[F.col(f"c{i}") for i in range(len(values))]).alias("x")).first().x


@pytest.mark.parametrize("a,b,want", [("a b c", "a x c", 1), ("a b c d", "x y c z", 2), ("a b", "a b c", 2), ("", "", 0), ("a b", "a b", 0)])
def test_longest_run(spark, a, b, want):
    assert one(spark, scoring.longest_run, a, b) == want


def _types(clean, corrupted):
    found = set()
    a, b = clean.split(), corrupted.split()
    for x, y in zip(a, b):
        if x != y:
            diff = [(p, q) for p, q in zip(x.lower(), y.lower()) if p != q]
            if len(x) == len(y) and len(diff) == 1 and diff[0][1] in lexicons.KEYBOARD.get(diff[0][0], ""):
                found.add("keyboard")
            if any((p in x.lower() and q in y.lower()) or (q in x.lower() and p in y.lower()) for p, q in lexicons.PHONETIC_PAIRS):
                found.add("phonetic")
            if "'" in x or "'" in y:
                found.add("punctuation")
            found = found or {"spelling"}
    if len(a) == len(b):
        found |= {"grammar" for x, y in zip(a, b) if x != y and (x.lower(), y.lower()) in lexicons.GRAMMAR_PAIRS}
    return sorted(found or {"spelling"})


def test_error_types(spark):
    cases = [
        ("The cat sat", "The cst sat"), ("your dog ran", "you're dog ran"), ("then we go", "than we go"), ("a phone rang", "a fone rang"), ("same text", "same text"), ("go home now", "go hme npw"), ("big tree", "bgi teee"),
        ("one two", "one twoo three"), ("their red house", "there red housw"),
    ]
    for a, b in cases:
        assert one(spark, scoring.error_types, a, b) == _types(a, b), (a, b)


@pytest.mark.parametrize("words,errors,types,want", [(10, 2, ["keyboard"], "simple"), (11, 2, ["keyboard"], "medium"), (18, 1, ["spelling"], "complex"), (5, 1, ["phonetic"], "complex"), (9, 4, ["spelling"], "complex"), (12, 3, ["keyboard", "spelling", "punctuation"], "complex"), (10, 3, [], "medium")])
def test_complexity(spark, words, errors, types, want):
    df = spark.createDataFrame([(words, errors, types)], "n int, e int, t array<string>")
    assert df.select(scoring.complexity(F.col("n"), F.col("e"), F.col("t")).alias("x")).first().x == want


def test_difficulty(spark):
    df = spark.createDataFrame([("one two three four", "one twp three four", ["keyboard"], 1), ("", "x", [], 0)], "a string, b string, t array<string>, n int")
    got = [r.x for r in df.select(scoring.difficulty("a", "b", F.col("t"), F.col("n")).alias("x")).collect()]
    assert got[0] == pytest.approx(0.25 * 40 + 9 + 2 + 20 / 18) and got[1] == pytest.approx(0.5)


def test_row_issues(spark):
    def kinds(a, b):
        return {(r.level, r.category) for r in validation.issues(spark.createDataFrame([(1, a, b)], "id int, clean string, corrupted string"), "id").collect()}

    assert kinds("", "x") == {("FAIL", "structure")} == kinds(None, "x") == kinds("x", None)
    assert kinds("The little house stands alone there", "The littel house stands alone there") == set()
    assert ("FAIL", "word_count") in kinds("too few words", "too fw words") and ("FAIL", "char_count") in kinds("a b c d", "a b c e")
    assert ("FAIL", "insufficient_change") in kinds("The little house stands alone there", "The little house stands alone there")
    assert ("FAIL", "excessive_change") in kinds("The little house stands alone there", "aThe little house stands alone there")
    assert ("WARNING", "problematic_pattern") in kinds("The little house 12345 stands", "The littel house 12345 stands")
    assert ("FAIL", "meaningless") in kinds("We go to it as he is in", "We og to it as he is in")


def test_summary_and_dataset(spark):
    rows = [("The little house stands alone there", "The littel house stands alone there", "simple", ["spelling"], "d", "s")] * 3 + [("x", "", "complex", ["keyboard"], "e", "t")]
    df = spark.createDataFrame(rows, "clean string, corrupted string, complexity string, error_types array<string>, domain string, source string")
    assert tuple(validation.summary(df).first()) == (4, 1, 0, 3, 0.75)
    got = {(r.category, r.subject, r.direction) for r in validation.dataset_issues(df).collect()}
    assert ("complexity_distribution", "simple", "high") in got and ("source_diversity", "source", "low") in got and ("domain_imbalance", "d", "high") in got and ("error_type_distribution", "phonetic", "low") in got
    assert {r.category for r in validation.dataset_issues(df.where("false")).collect()} == {"dataset_empty"}
    assert validation.recommendations(validation.issues(df.limit(0), "domain")).first().recommendation == "No major issues"


def test_statistics_of_one_row(spark):
    r = profiling.statistics(spark.createDataFrame([(3.0,)], "x double"), x=F.col("x")).first()
    assert (r.n, r["mean"], r["std"], r.p95) == (1, 3.0, 0.0, 3.0)
    assert profiling.balance(spark.createDataFrame([("c", "a", 5)], "column string, value string, n long")).first().balance == 0.0
    assert spark.range(1).select(profiling.error_bin(F.lit(0)).alias("x")).first().x == "3-4 errors"


def test_numbering_is_gapless_and_stable(spark):
    df = spark.range(5000).withColumn("g", F.col("id") % 3)
    a = {r.id: (r.g, r["index"]) for r in sampling.shuffled(df, ["g"], "t", "id").collect()}
    b = {r.id: (r.g, r["index"]) for r in sampling.shuffled(df.repartition(7), ["g"], "t", "id").collect()}
    assert a == b
    for g in range(3):
        assert sorted(i for k, i in a.values() if k == g) == list(range(len([1 for k, _ in a.values() if k == g])))


def test_quota_and_split(spark):
    df = spark.range(100).withColumn("domain", F.when(F.col("id") < 90, "a").otherwise("b"))
    got = {(r.domain, r["count"]) for r in sampling.quota(df, 60, {"a": 0.5, "b": 0.5}, "id").groupBy("domain").count().collect()}
    assert got == {("a", 30), ("b", 30)}
    assert {r.split: r["count"] for r in sampling.split_eval(df, 0.1, "id").groupBy("split").count().collect()} == {"train": 90, "eval": 10}
    assert sampling.halves(df, "h", "id").where("second_half").count() == 50


def test_draw_matches_md5(spark):
    import hashlib

    got = spark.range(1).select(rng.draw("s", F.lit(7)).alias("x")).first().x
    assert got == int(hashlib.md5(b"42|7|s").hexdigest()[:8], 16)


WORDS = ["their", "definitely", "beautiful", "don't", "everyone", "accommodate", "letter", "a", "it", "Then", "PHONE", "x1y2", "naïve", "Government"]


@pytest.mark.parametrize("f", [corruption.keyboard_error, corruption.character_error, corruption.phonetic_error, corruption.contraction_error, corruption.compound_error, corruption.double_letter_error, lambda w, d: corruption.corrupt_word(w, d, 0.9)])
def test_word_corruptions_change_little_and_repeat(spark, f):
    df = spark.createDataFrame([(i, w) for i in range(20) for w in WORDS], "i int, w string")
    q = df.select("i", "w", f(F.col("w"), corruption.Draws("i", "w")).alias("x"))
    a = sorted(map(tuple, q.collect()))
    assert a == sorted(map(tuple, df.repartition(5).select("i", "w", f(F.col("w"), corruption.Draws("i", "w")).alias("x")).collect()))
    assert any(w != x for _, w, x in a) and all(x for *_, x in a) and all(abs(len(w) - len(x)) <= 4 for _, w, x in a)


def test_generated_examples(spark):
    r = random.Random(1)
    vocabulary = [*WORDS[:7], "house", "tree", "then", "better", "quick", "running", "because", "different"]
    rows = [(i, 0, " ".join(r.choice(vocabulary) for _ in range(r.randint(5, 14))) + ".", r.choice(list(lexicons.DOMAINS))) for i in range(120)]
    pool = spark.createDataFrame(rows, "doc_id long, pos int, sentence string, domain string")
    a = corruption.generate(pool, 60).collect()
    b = corruption.generate(pool.repartition(6), 60).collect()
    assert sorted(map(str, a)) == sorted(map(str, b))
    for name, (_, share) in lexicons.METHODS.items():
        assert 0 < sum(x.method == name for x in a) <= int(60 * share)
    for x in a:
        assert x.corrupted != x.clean and x.num_errors >= 1 and x.error_types == sorted(set(x.error_types))
        assert x.method != "multi_error_sentences" or x.num_errors >= 2
        assert x.method != "contextual_phonetic" or ("grammar" in x.error_types and x.complexity == "complex")
        assert x.method != "simple_single" or x.complexity == "simple"


def test_early_corruption(spark):
    df = spark.createDataFrame([(i, "we go to the old house then it is too late 42 !") for i in range(60)], "i int, s string")
    got = [r.x for r in df.select(corruption.early_corrupt("s", corruption.Draws("i"), 0.5).alias("x")).collect()]
    assert len(set(got)) > 10 and all("42" in x and "!" in x for x in got)
    d = df.select(corruption.scramble_small(text.words("s"), corruption.Draws("i")).alias("x")).collect()
    assert all(sorted(r.x) == sorted("we go to the old house then it is too late 42 !".split()) for r in d) and len({tuple(r.x) for r in d}) > 1


def test_balance_punctuation(spark):
    rows = [(i, f"It is number {i} now.", f"It is nubmer {i} now.", "s") for i in range(10)] + [(99, "Is it?", "Si it?", "s")]
    got = chat.balance_punctuation(spark.createDataFrame(rows, "id int, clean string, corrupted string, source string"), "id").collect()
    assert sum(r.punctuation_removed for r in got) == 5 and all(r.source == "s_no_punct" and not r.clean.endswith(".") for r in got if r.punctuation_removed)


def test_verdicts(spark):
    for e, p, want in [("It is so.", "it is so", "exact"), ("It is", "it is now", "complete"), ("a b c d e", "a b c d x", "partial"), ("a b", "c d", "wrong")]:
        assert one(spark, evaluation.verdict, e, p) == want
    assert one(spark, evaluation.word_accuracy, "a b c", "a x y", "a x c") == 0.5 and one(spark, evaluation.word_accuracy, "a", "a", "z") == 1.0


def test_corpus_metrics(spark):
    df = spark.createDataFrame([("the cat sat on the mat", "the cat sat on the mat"), ("a b c d", "a b c d")], "predicted string, expected string")
    r = metrics.corpus_metrics(df).first()
    assert (r.n, r.exact_match, r.bleu, r.chrf) == (2, 100.0, 100.0, 100.0)
    half = metrics.corpus_metrics(spark.createDataFrame([("the cat", "the cat sat on the mat"), ("x", "y")], "predicted string, expected string")).first()
    assert 0 < half.bleu < 60 and 0 < half.chrf < 60
    assert metrics.corpus_metrics(df.where("false")).first().n == 0


def test_bytes(spark):
    assert one(spark, lambda c: tokens.byte_ids(c, 8), "aé") == [100, 198, 172, 1]
    assert one(spark, lambda c: tokens.byte_ids(c, 3), "abc") == [100, 101, 1] and one(spark, tokens.byte_ids, "") == [1]


def test_corrector_falls_back(spark):
    def make():
        def run(texts):
            raise RuntimeError

        return run

    df = spark.createDataFrame([("a b",), ("",), (None,)], "corrupted string")
    assert [r.predicted for r in tokens.corrected(df, "corrupted", make).collect()] == ["a b", "", None]


def test_quantiles_sought_cell_by_cell(spark, monkeypatch):
    """Beyond the bound, ranks are found without ordering a group: the same values, with ties, one-row groups and wide ranges."""
    import random

    r = random.Random(5)
    rows = [("a", r.gauss(0, 1e6)) for _ in range(500)] + [("b", float(r.randrange(4))) for _ in range(301)] + [("c", 7.5), ("d", -1.0), ("d", 1e12), ("d", None)]
    df = spark.createDataFrame(rows, "g string, x double")
    probs = (0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 0.999, 1.0)
    once = {x.g: list(x.q) for x in profiling.quantiles(df, "g", "x", *probs).collect()}
    monkeypatch.setattr(profiling, "MOST_DISTINCT", 0)
    monkeypatch.setattr(profiling, "CELLS", 7)
    again = {x.g: list(x.q) for x in profiling.quantiles(df, "g", "x", *probs).collect()}
    assert set(again) == set("abcd") and all(again[g] == pytest.approx(once[g]) for g in once)


def test_subwords(spark):
    from tokenizers import Tokenizer

    path = "/opt/tokenizers/byte_bpe_50k.json"
    known = Tokenizer.from_file(path)
    texts = ["I beleive it.", "", None, "ä <|endoftext|> é" * 3]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(F.coalesce("t", F.lit("")).alias("t"), tokens.subword_ids(path)(F.col("t")).alias("ids"))
    rows = df.select("t", "ids", tokens.subword_text(path)(F.col("ids")).alias("back"), *[c.alias(n) for c, n in zip(tokens.padded(F.col("ids"), 6, 9), ("own", "mask"))]).collect()
    for r in rows:
        assert r.back == r.t and r.own == (r.ids + [9] * 6)[:6] and r.mask == ([1] * len(r.ids) + [0] * 6)[:6]
    assert next(r.ids for r in rows if r.t == texts[0]) == known.encode(texts[0], add_special_tokens=False).ids
