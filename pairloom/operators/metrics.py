"""Corpus metrics from sufficient statistics: exact match, length, BLEU, chrF.

Each row yields counts of matching n-grams; the counts are summed and the score is
a closed form of the sums, so the corpus is one aggregate. Tokens are words;
parameters are the usual defaults (BLEU 4 with exponential smoothing, chrF 6, beta 2).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.functions import text


def ngrams(tokens: Column, n: int) -> Column:
    """All n-grams as strings."""
    last = F.size(tokens) - n
    return F.when(last < 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.array_join(F.slice(tokens, i + 1, n), "\x01")))


def matches(a: Column, b: Column) -> Column:
    """The size of the multiset intersection of two arrays: both sorted, then walked once."""

    def walked(x: Column, y: Column) -> Column:
        def step(st: Column, _: Column) -> Column:
            one, two = F.get(x, st["i"]), F.get(y, st["j"])
            ended = one.isNull() | two.isNull()
            i, j = F.when(~ended & (one <= two), 1).otherwise(0), F.when(~ended & (two <= one), 1).otherwise(0)
            return F.struct((st["i"] + i).alias("i"), (st["j"] + j).alias("j"), (st["m"] + i * j).alias("m"))

        start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("m"))
        return F.aggregate(F.sequence(F.lit(0), F.size(x) + F.size(y)), start, step)["m"]

    both = F.struct(F.array_sort(a).alias("x"), F.array_sort(b).alias("y"))
    return text.let(both, lambda s: walked(s["x"], s["y"]))


def corpus_metrics(rows: DataFrame, predicted: str = "predicted", expected: str = "expected") -> DataFrame:
    """One row: n, exact_match, mean_length, bleu, chrf."""
    p, e = text.words(predicted), text.words(expected)
    pc, ec = (text.chars(F.regexp_replace(c, r"\s+", "")) for c in (F.col(predicted), F.col(expected)))
    cols = [(text.strip(predicted) == text.strip(expected)).alias("same"), F.size(p).alias("np"), F.size(e).alias("ne")]
    for n in range(1, 5):
        cols += [matches(ngrams(p, n), ngrams(e, n)).alias(f"m{n}"), F.greatest(F.size(p) - (n - 1), F.lit(0)).alias(f"t{n}")]
    for n in range(1, 7):
        cols += [matches(ngrams(pc, n), ngrams(ec, n)).alias(f"cm{n}"), F.greatest(F.size(pc) - (n - 1), F.lit(0)).alias(f"cp{n}"), F.greatest(F.size(ec) - (n - 1), F.lit(0)).alias(f"ce{n}")]
    per = rows.select(*cols)
    sums = per.agg(F.count("*").alias("n"), F.avg(F.col("same").cast("double")).alias("same"), F.avg("np").alias("length"), *[F.sum(c).cast("double").alias(c) for c in per.columns if c != "same"])

    def precision(n: int) -> Column:
        # where nothing matches at an order, halve for each such order so far
        zeros = sum((F.when(F.col(f"m{k}") == 0, 1).otherwise(0) for k in range(1, n + 1)), F.lit(0))
        return F.when(F.col(f"m{n}") > 0, F.col(f"m{n}")).otherwise(F.lit(1.0) / F.pow(F.lit(2.0), zeros)) / F.greatest(F.col(f"t{n}"), F.lit(1.0))

    brevity = F.when(F.col("np") >= F.col("ne"), F.lit(1.0)).otherwise(F.exp(F.lit(1.0) - F.col("ne") / F.greatest(F.col("np"), F.lit(1e-9))))
    bleu = brevity * F.exp(sum((F.log(precision(n)) for n in range(1, 5)), F.lit(0.0)) / 4) * 100
    beta = 4.0

    def f(n: int) -> Column:
        pr, rc = F.col(f"cm{n}") / F.greatest(F.col(f"cp{n}"), F.lit(1.0)), F.col(f"cm{n}") / F.greatest(F.col(f"ce{n}"), F.lit(1.0))
        return F.when(pr + rc > 0, (1 + beta) * pr * rc / F.greatest(beta * pr + rc, F.lit(1e-12))).otherwise(F.lit(0.0))

    orders = sum((F.when(F.col(f"cp{n}") + F.col(f"ce{n}") > 0, 1).otherwise(0) for n in range(1, 7)), F.lit(0))
    chrf = sum((f(n) for n in range(1, 7)), F.lit(0.0)) / F.greatest(orders, F.lit(1)) * 100
    return sums.select("n", F.round(F.col("same") * 100, 2).alias("exact_match"), F.round("length", 2).alias("mean_length"), F.round(bleu, 2).alias("bleu"), F.round(chrf, 2).alias("chrf"))


def perplexity(loss: float) -> float:
    """e to a mean cross-entropy; training itself is out of scope."""
    return math.exp(loss)
