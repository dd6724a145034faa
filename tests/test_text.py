"""Text columns and sentence operators on edge cases."""

import re

import pytest
from pyspark.sql import functions as F

from pairloom.functions import text
from pairloom.operators import chat, sentences


def one(spark, f, *values):
    df = spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(f(*[F.col(f"c{i}") for i in range(len(values))]).alias("x")).first().x


def test_words_and_counts(spark):
    assert one(spark, text.words, "") == [] and one(spark, text.words, "  a \n b ") == ["a", "b"]
    assert one(spark, F.length, "a😀b") == 3
    assert one(spark, text.chars, "") == [] and one(spark, text.chars, "aé") == ["a", "é"]


def test_pieces(spark):
    df = spark.createDataFrame([(1, " First one here! Second... third one is the last? yes "), (2, "short")], "doc_id long, text string")
    got = [(r.pos, r.sentence) for r in sentences.split(df).orderBy("pos").collect()]
    assert got == [(0, "First one here."), (1, "Second."), (2, "third one is the last."), (3, "yes.")]
    many = spark.createDataFrame([(1, "abcdef ghi. " * 15)], "doc_id long, text string")
    assert sentences.split(many, most=10).count() == 10 and sentences.split(many).count() == 15


@pytest.mark.parametrize("a,b", [("The cat, sat!", "sat the CAT"), ("b a a", "A b"), ("", " ?! ")])
def test_fingerprint_ignores_order_case_punctuation(spark, a, b):
    assert one(spark, text.fingerprint, a) == one(spark, text.fingerprint, b)


@pytest.mark.parametrize("original,new,want", [("THERE", "their", "THEIR"), ("There", "their", "Their"), ("to", "too", "too"), ("TO", "too", "TOo"), ("It", "it's", "It's")])
def test_preserve_case(spark, original, new, want):
    assert one(spark, text.preserve_case, original, new) == want


@pytest.mark.parametrize("original,new,want", [("THEN", "than", "THAN"), ("Then", "than", "Than"), ("then", "than", "than")])
def test_whole_case(spark, original, new, want):
    assert one(spark, text.whole_case, original, new) == want


def test_normal_forms(spark):
    assert one(spark, text.normalize, " A  b.. ") == "a b."
    assert one(spark, text.normalize_a, "A, b. c") == "a b c" and one(spark, text.normalize_b, " A,  b. ") == "a  b" and one(spark, text.normalize_c, "A. b,") == "a b,"
    assert one(spark, text.strip_periods, "etc...") == "etc" and one(spark, text.strip_one_period, "etc..") == "etc."
    assert one(spark, text.strip_prompt, "Correct the typos in this text: teh") == "teh"


def _quality(s):
    """The sentence filter in plain Python."""
    w = s.split()
    bad = [r"^[A-Z\s]+$", r"\d{4,}", r"http|www|@", r"===|---|\*\*\*", r"[<>{}\[\]\\]", r"\([^)]{30,}\)", r'"[^"]{50,}"', r"\.{3,}|!{2,}|\?{2,}", r"\b[A-Z]{3,}\b.*\b[A-Z]{3,}\b"]
    return (
        20 <= len(s) <= 200 and 4 <= len(w) <= 30 and s.rstrip().endswith((".", "!", "?")) and len(set(s.lower())) >= len(s) * 0.3 and not any(re.search(p, s) for p in bad)
        and len({x.lower().strip(".,!?;:") for x in w}) >= len(w) * 0.7 and sum(c.isalpha() for c in s) >= len(s) * 0.6
    )


def test_quality_filter(spark):
    cases = [
        "The quick brown fox jumps over it.", "Too short.", "A sentence with the number 12345 in it.", "THE WHOLE THING IS IN CAPITALS NOW.", "See www.example.com for much more.", "the the the the same word again.",
        "NASA and then ESA went up there.", "Wait, what is this??", "Wait... what is it now then?", "It has (a very long remark in parentheses here) in it.", "Äpfel und Öl sind gut für dich.", "1 2 3 4 5 6 7 8 9 10 11 12 ab.",
        "No end of the sentence here", "Some [markup] in a short line.", "Quick wizards vex jumpy dogs!", "aaaaaaaaaa bbbbbbbbbb cccc dddd.",
    ]
    df = spark.createDataFrame([(c,) for c in cases], "s string")
    got = {r.s: r.q for r in df.select("s", sentences.is_high_quality("s").alias("q")).collect()}
    assert got == {c: _quality(c) for c in cases} and any(got.values())


def test_domains(spark):
    for s, want in [("I think we should probably go there, maybe.", "conversational"), ("The project team has a meeting with the client.", "professional"), ("ok.", "general"), ("First open it, then make sure the next step is done.", "instructional")]:
        assert one(spark, sentences.classify, s) == want


def test_first_of_keeps_the_first(spark):
    df = spark.createDataFrame([(2, 0, "B a"), (1, 5, "a b!"), (1, 2, "A, b")], "doc_id long, pos int, sentence string")
    assert [tuple(r) for r in sentences.first_of(df, text.fingerprint("sentence"), "doc_id", "pos").collect()] == [(1, 2, "A, b")]


@pytest.mark.parametrize("s,want", [("See Dr.", True), ("What?", True), ("a.b.", True), ("Plain end.", False), ("Plan A.", False), ("etc.", True)])
def test_keeps_period(spark, s, want):
    assert one(spark, chat.keeps_period, s) is want
    assert one(spark, lambda c: chat.keeps_period(c, True), "Plan A.") is True


def test_cleaning(spark):
    assert one(spark, text.clean_chat, "\nassistant\nGood.\nassistant\nMore") in ("Good.", "")
    assert one(spark, text.last_sentence, "One. Two! rest") == "One. Two!" and one(spark, text.last_sentence, "none") == "none"
    assert one(spark, text.clean_few_shot, "a  b. c") == "a b." and one(spark, text.clean_cautious, "Corrected: x y. z") == "x y."


def test_variations(spark):
    df = spark.createDataFrame([("d", 1, 0, "You should go."), ("d", 1, 1, "Is it so?"), ("e", 2, 0, "It is red.")], "domain string, doc_id long, pos int, sentence string")
    got = sorted((r.kind, r.variation) for r in sentences.variations(df).collect())
    assert got == [("no_period", "It is red"), ("no_period", "You should go"), ("question", "You should go?")]
