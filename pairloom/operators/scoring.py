"""Comparing a clean and a corrupted text: error types, complexity, difficulty, change ratios."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairloom.functions import lexicons, text


def paired(a: Column, b: Column) -> Column:
    """Elements of two arrays at equal places, as far as the shorter goes."""
    return text.let(F.struct(a.alias("a"), b.alias("b")), lambda s: _paired(s["a"], s["b"]))


def _paired(a: Column, b: Column) -> Column:
    n = F.least(F.size(a), F.size(b))
    return F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: F.struct(x.alias("a"), y.alias("b")))


def differing(a: Column, b: Column) -> Column:
    """The pairs of unlike elements at equal places."""
    return F.filter(paired(a, b), lambda p: p["a"] != p["b"])


def char_changes(clean: Column | str, corrupted: Column | str) -> Column:
    return F.size(differing(text.chars(clean), text.chars(corrupted)))


def word_changes(clean: Column | str, corrupted: Column | str) -> Column:
    return F.size(differing(text.words(clean), text.words(corrupted)))


def change_ratio(clean: Column | str, corrupted: Column | str) -> Column:
    return char_changes(clean, corrupted) / F.greatest(F.length(text.col(clean)), F.lit(1))


def word_change_ratio(clean: Column | str, corrupted: Column | str) -> Column:
    return word_changes(clean, corrupted) / F.greatest(text.n_words(clean), F.lit(1))


def keyboard_like(a: Column, b: Column, layout: dict[str, str] = lexicons.KEYBOARD) -> Column:
    """Words of equal length that differ in one character, by a neighbouring key."""
    known = text.table(layout)

    def near(diff: Column) -> Column:
        return (F.size(diff) == 1) & F.coalesce(F.contains(F.try_element_at(known, F.get(diff, 0)["a"]), F.get(diff, 0)["b"]), F.lit(False))

    return (F.length(a) == F.length(b)) & text.let(differing(text.chars(F.lower(a)), text.chars(F.lower(b))), near)


def phonetic_like(a: Column, b: Column, pairs: list[tuple[str, str]] = lexicons.PHONETIC_PAIRS, both_ways: bool = True) -> Column:
    """Words of which one holds a pattern and the other what it sounds like."""
    a, b = F.lower(a), F.lower(b)
    found = []
    for x, y in pairs:
        found.append(F.contains(a, F.lit(x)) & F.contains(b, F.lit(y)))
        if both_ways:
            found.append(F.contains(a, F.lit(y)) & F.contains(b, F.lit(x)))
    return reduce(lambda x, y: x | y, found)


def error_types(clean: Column | str, corrupted: Column | str) -> Column:
    """Sorted error types. Spelling: no differing pair, or the first one is of no other kind."""
    cw, kw = text.words(clean), text.words(corrupted)
    return text.let(differing(cw, kw), lambda diff: _types(diff, F.size(cw) == F.size(kw)))


def _types(diff: Column, same_count: Column) -> Column:
    quote = F.lit("'")

    def punctuated(p: Column) -> Column:
        return F.contains(p["a"], quote) | F.contains(p["b"], quote)

    def other(p: Column) -> Column:
        return keyboard_like(p["a"], p["b"]) | phonetic_like(p["a"], p["b"]) | punctuated(p)

    confused = F.array(*[F.lit(f"{a}|{b}") for a, b in lexicons.GRAMMAR_PAIRS])
    grammar = same_count & F.exists(diff, lambda p: F.array_contains(confused, F.concat_ws("|", F.lower(p["a"]), F.lower(p["b"]))))
    spelling = (F.size(diff) == 0) | ~F.coalesce(other(F.get(diff, 0)), F.lit(False))
    kinds = [
        F.when(grammar, F.lit("grammar")),
        F.when(F.exists(diff, lambda p: keyboard_like(p["a"], p["b"])), F.lit("keyboard")),
        F.when(F.exists(diff, lambda p: phonetic_like(p["a"], p["b"])), F.lit("phonetic")),
        F.when(F.exists(diff, punctuated), F.lit("punctuation")),
        # a set that holds only grammar is not replaced; one that is empty is
        F.when(spelling, F.lit("spelling")),
    ]
    return F.array_compact(F.array(*kinds))


def profile_kind(a: Column, b: Column) -> Column:
    """The profiler's first match for a word pair."""
    return (
        F.when(keyboard_like(a, b, lexicons.KEYBOARD_PROFILE), "keyboard")
        .when(phonetic_like(a, b, lexicons.PHONETIC_PROFILE, False), "phonetic")
        .when(F.abs(F.length(a) - F.length(b)) <= 2, "character")
        .otherwise("other")
    )


def complexity(n_words: Column, n_errors: Column, types: Column) -> Column:
    basic = F.forall(types, lambda t: t.isin("keyboard", "spelling", "spacing"))
    hard = F.exists(types, lambda t: t.isin("phonetic", "grammar"))
    simple = (n_errors <= 2) & (n_words <= 10) & basic
    complex_ = (n_errors >= 4) | (n_words >= 18) | hard | (F.size(F.array_distinct(types)) >= 3)
    return F.when(simple, "simple").when(complex_, "complex").otherwise("medium")


def difficulty(clean: Column | str, corrupted: Column | str, types: Column, n_errors: Column) -> Column:
    """0 to 100: errors for each word, kinds of errors, length, changed characters. A clean text without words counts as one word."""
    n = F.greatest(text.n_words(clean), F.lit(1)).cast("double")
    weights = text.table(lexicons.DIFFICULTY)
    kinds = F.aggregate(types, F.lit(0.0), lambda acc, t: acc + F.coalesce(F.try_element_at(weights, t), F.lit(0.8)) * F.lit(15.0))
    score = F.least(n_errors / n, F.lit(0.5)) * F.lit(40.0) + kinds + F.least(n / F.lit(20.0), F.lit(1.0)) * F.lit(10.0) + change_ratio(clean, corrupted) * F.lit(20.0)
    return F.least(score, F.lit(100.0))


def longest_run(clean: Column | str, corrupted: Column | str) -> Column:
    """The most unlike words in a row; all words of the clean text if the counts differ."""
    a, b = text.words(clean), text.words(corrupted)
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(s: Column, p: Column) -> Column:
        now = F.when(p["a"] != p["b"], s["now"] + 1).otherwise(F.lit(0))
        return F.struct(now.alias("now"), F.greatest(s["most"], now).alias("most"))

    return F.when(F.size(a) != F.size(b), F.size(a)).otherwise(F.aggregate(paired(a, b), start, step, lambda s: s["most"]))
