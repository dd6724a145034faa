"""Profiles of training rows: counts, statistics, bins, balance, corruption pairs."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from pairloom.functions import text
from pairloom.operators import sampling, scoring


def counts(df: DataFrame, *columns: str) -> DataFrame:
    """column, value, n for several categorical columns in one pass."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c).cast("string"), F.lit("unknown")).alias("value")) for c in columns])
    return df.select(F.explode(pairs).alias("p")).groupBy("p.column", "p.value").agg(F.count("*").alias("n"))


def label_counts(df: DataFrame, labels: str) -> DataFrame:
    """value, n of the elements of an array column."""
    return df.select(F.explode(labels).alias("value")).groupBy("value").agg(F.count("*").alias("n"))


#: Distinct values up to which quantiles are taken in one aggregate; beyond it the ranks are sought cell by cell.
MOST_DISTINCT = 200_000
#: Cells of one step of that search.
CELLS = 4096


def _wanted(values: DataFrame, by: str, probs: tuple[float, ...]) -> DataFrame:
    """by, p (the number of the probability), part (between the two values), upper, rank (from 0)."""
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("p"), F.lit(float(q)).alias("q")) for i, q in enumerate(probs)])).alias("e")
    at = values.groupBy(by).agg(F.sum("n").alias("all_")).select(by, (F.col("all_") - 1).alias("last"), each).select(by, "e.p", (F.col("last") * F.col("e.q")).alias("at"))
    sides = F.explode(F.array(F.struct(F.lit(False).alias("upper"), F.floor("at").alias("rank")), F.struct(F.lit(True).alias("upper"), F.ceil("at").alias("rank")))).alias("s")
    return at.select(by, "p", (F.col("at") - F.floor("at")).alias("part"), sides).select(by, "p", "part", "s.*")


def _sought(values: DataFrame, by: str, probs: tuple[float, ...]) -> DataFrame:
    """by, q: quantiles of values (by, x, n) without ordering a group in one task: the cell that holds a rank, a cell of that, and only its values in order."""
    ranks, group = _wanted(values, by, probs), [by]
    for cell in ("cell1", "cell2"):
        ends = values.groupBy(*group).agg(F.min("x").alias("low"), F.max("x").alias("high"))
        share = (F.col("x") - F.col("low")) / F.when(F.col("high") > F.col("low"), F.col("high") - F.col("low")).otherwise(F.lit(1.0))
        values = values.join(ends, group).withColumn(cell, F.least(F.floor(share * CELLS), F.lit(CELLS - 1)).cast("int")).drop("low", "high")
        upto = W.Window.partitionBy(*group).orderBy(cell).rowsBetween(W.Window.unboundedPreceding, -1)
        cells = values.groupBy(*group, cell).agg(F.sum("n").alias("own")).withColumn("before", F.coalesce(F.sum("own").over(upto), F.lit(0)))
        ranks = ranks.join(cells, group).where((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("own")))
        ranks = sampling.stored(ranks.withColumn("rank", F.col("rank") - F.col("before")).drop("before", "own"))
        group = [*group, cell]
        values = values.join(ranks.select(*group).distinct(), group)
    upto = W.Window.partitionBy(*group).orderBy("x").rowsBetween(W.Window.unboundedPreceding, -1)
    values = values.withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0)))
    found = ranks.join(values, group).where((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("n")))
    two = found.groupBy(by, "p", "part").agg(F.max(F.when(~F.col("upper"), F.col("x"))).alias("a"), F.max(F.when(F.col("upper"), F.col("x"))).alias("b"))
    q = F.transform(F.sort_array(F.collect_list(F.struct("p", (F.col("a") + (F.col("b") - F.col("a")) * F.col("part")).alias("q")))), lambda s: s["q"])
    return two.groupBy(by).agg(q.alias("q"))


def quantiles(rows: DataFrame, by: str, x: str, *probs: float) -> DataFrame:
    """by, q: exact quantiles (interpolated) of a column in each group; equal values count once, with their number."""
    values = sampling.stored(rows.select(by, F.col(x).cast("double").alias("x")).where("x is not null").groupBy(by, "x").agg(F.count("*").alias("n")))
    if values.count() > MOST_DISTINCT:
        return _sought(values, by, probs)
    return values.groupBy(by).agg(F.percentile("x", F.array(*[F.lit(float(p)) for p in probs]), F.col("n")).alias("q"))


def described(rows: DataFrame, by: str, x: str) -> DataFrame:
    """by, n, mean, median, std (sample; 0 for one row), least, most, p25, p75, p90, p95 of a column in each group."""

    def r(c: Column) -> Column:
        return F.round(c, 6)

    rows = rows.where(F.col(x).isNotNull())
    out = rows.groupBy(by).agg(F.count("*").alias("n"), r(F.avg(x)).alias("mean"), r(F.coalesce(F.stddev_samp(x), F.lit(0.0))).alias("std"), F.min(x).alias("least"), F.max(x).alias("most"))
    out = out.join(quantiles(rows, by, x, 0.5, 0.25, 0.75, 0.9, 0.95), by)
    return out.select(by, "n", "mean", r(F.col("q")[0]).alias("median"), "std", "least", "most", *[r(F.col("q")[i]).alias(n) for i, n in enumerate(("p25", "p75", "p90", "p95"), 1)])


def statistics(df: DataFrame, **columns: Column) -> DataFrame:
    """name, n, mean, median, std, least, most, p25, p75, p90, p95 of several columns."""
    values = F.array(*[F.struct(F.lit(k).alias("name"), v.cast("double").alias("x")) for k, v in columns.items()])
    return described(sampling.stored(df.select(F.explode(values).alias("v")).select("v.*")), "name", "x")


def word_bin(n: Column) -> Column:
    return F.when(n <= 5, "1-5 words").when(n <= 10, "6-10 words").when(n <= 15, "11-15 words").when(n <= 20, "16-20 words").otherwise("20+ words")


def error_bin(n: Column) -> Column:
    """No errors count with 3-4: only 1 and 2 have bins of their own."""
    return F.when(n == 1, "1 error").when(n == 2, "2 errors").when(n <= 4, "3-4 errors").when(n <= 6, "5-6 errors").otherwise("6+ errors")


def histogram(df: DataFrame, value: Column, name: str = "value") -> DataFrame:
    return df.groupBy(value.alias(name)).agg(F.count("*").alias("n"))


def equal_width(df: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """bin, n: what a histogram plot draws."""
    at = F.width_bucket(F.col(value).cast("double"), F.lit(float(low)), F.lit(float(high)), F.lit(bins))
    return df.where(F.col(value).isNotNull()).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))


def balance(table: DataFrame) -> DataFrame:
    """From (column, value, n): column, diversity, balance = entropy / log2(values), 0 for one value."""
    w = W.Window.partitionBy("column")
    p = F.col("n") / F.sum("n").over(w)
    parts = table.select("column", (-p * F.log2(p)).alias("h"))
    k = F.count("*")
    score = F.when(k > 1, F.sum("h") / F.log2(k.cast("double"))).otherwise(F.lit(0.0))
    return parts.groupBy("column").agg(k.alias("diversity"), F.round(score, 6).alias("balance"))


def top(table: DataFrame, k: int, *ties: str) -> DataFrame:
    """The k most frequent, ties by name."""
    return table.orderBy(F.desc("n"), *ties).limit(k)


def last_characters(df: DataFrame, *columns: str) -> DataFrame:
    """side, last, n, periods: what the stripped texts of several columns end with."""
    sides = F.array(*[F.struct(F.lit(c).alias("side"), F.right(text.strip(c), F.lit(1)).alias("last")) for c in columns])
    return df.select(F.explode(sides).alias("s")).select("s.*").where("last != ''").groupBy("side", "last").agg(F.count("*").alias("n"))


def corruption_pairs(pairs: DataFrame) -> DataFrame:
    """clean_word, corrupted_word, kind, n of unlike words, in rows with equal word counts."""
    same = pairs.where(text.n_words("clean") == text.n_words("corrupted"))
    words = same.select(F.explode(scoring.differing(text.words("clean"), text.words("corrupted"))).alias("p")).select(F.col("p.a").alias("clean_word"), F.col("p.b").alias("corrupted_word"))
    n = words.groupBy("clean_word", "corrupted_word").agg(F.count("*").alias("n"))
    return n.withColumn("kind", scoring.profile_kind(F.col("clean_word"), F.col("corrupted_word")))


def change_statistics(pairs: DataFrame) -> DataFrame:
    """Mean, median and deviation of the word and character change ratios."""
    found = statistics(pairs, word_ratio=scoring.word_change_ratio("clean", "corrupted"), char_ratio=scoring.change_ratio("clean", "corrupted"))
    return found.select("name", "n", "mean", "median", "std")


def cube(rows: DataFrame, columns: list[str], most: int, **measures: Column) -> DataFrame:
    """level (bits of the columns that are summed over), the columns and the measures, for every set of up to `most` columns: one scan, one aggregation."""
    sets = [[F.col(c) for c in chosen] for k in range(most + 1) for chosen in combinations(columns, k)]
    found = rows.groupingSets(sets, *columns).agg(F.grouping_id().cast("int").alias("level"), *[c.alias(k) for k, c in measures.items()])
    return found.select("level", *columns, *measures)
