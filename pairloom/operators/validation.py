"""Checks of rows and datasets: an issues table, verdicts, roll-ups, recommendations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.functions import lexicons, text
from pairloom.operators import scoring

_CONSONANTS = "bcdfghjklmnpqrstvwxz"


def readability(c: Column | str) -> Column:
    """1 less penalties for short words, consonant runs and repeated characters; 0 without words."""
    c = text.col(c)
    w = text.words(c)
    short = F.size(F.filter(w, lambda x: x.rlike(r"^\p{L}{1,2}$"))) / F.greatest(F.size(w), F.lit(1))
    runs = F.regexp_count(F.lower(c), F.lit(f"[{_CONSONANTS}]{{3,}}"))
    repeats = F.regexp_count(c, F.lit(r"(.)\1{2,}"))
    score = F.lit(1.0) - short * F.lit(0.3) - F.least(runs * F.lit(0.1), F.lit(0.5)) - F.least(repeats * F.lit(0.1), F.lit(0.3))
    return F.when(F.size(w) == 0, F.lit(0.0)).otherwise(F.greatest(score, F.lit(0.0)))


def nonsense_share(c: Column | str) -> Column:
    """Share of words without sense; a word of one or two characters counts. 1 without words."""
    w = text.words(c)

    def odd(x: Column) -> Column:
        bare = F.regexp_replace(F.lower(x), text.NON_WORD, "")
        return bare.rlike(f"^[{_CONSONANTS}]{{4,}}$") | bare.rlike("^[aeiou]{4,}$") | bare.rlike(r"^(.)\1{3,}$") | bare.rlike(r"^[\p{L}\p{N}_]{1,2}$")

    return F.when(F.size(w) == 0, F.lit(1.0)).otherwise(F.size(F.filter(w, odd)) / F.size(w))


def _issue(when: Column, level: str, category: str, message: Column) -> Column:
    return F.when(when, F.struct(F.lit(level).alias("level"), F.lit(category).alias("category"), message.alias("message")))


def row_issues(clean: Column | str, corrupted: Column | str) -> Column:
    """The array of a row's issues. A missing text hides all others."""
    k, c = text.col(clean), text.col(corrupted)
    lim = lexicons.LIMITS
    n, chars = text.n_words(k), F.length(k)
    change, words = scoring.change_ratio(k, c), scoring.word_change_ratio(k, c)
    read, run = readability(c), scoring.longest_run(k, c)
    missing = F.coalesce(k, F.lit("")).eqNullSafe("") | F.coalesce(c, F.lit("")).eqNullSafe("")

    def number(f: str, x: Column) -> Column:
        return F.format_string(f, x)

    found = [
        _issue(n < lim["min_words"], "FAIL", "word_count", number("Too few words: %d", n)),
        _issue(n > lim["max_words"], "WARNING", "word_count", number("Too many words: %d", n)),
        _issue(chars < lim["min_chars"], "FAIL", "char_count", number("Too few characters: %d", chars)),
        _issue(change < lim["min_change"], "FAIL", "insufficient_change", F.lit("Too little changed")),
        _issue(change > lim["max_change"], "FAIL", "excessive_change", F.lit("Too much changed")),
        _issue(words < lim["min_word_change"], "WARNING", "low_word_changes", F.lit("Few words changed")),
        *[_issue(c.rlike(p) | k.rlike(p), "WARNING", "problematic_pattern", F.lit(f"Pattern {i}")) for i, p in enumerate(lexicons.SUSPECT)],
        _issue(read < lim["min_readability"], "WARNING", "low_readability", F.lit("Hard to read")),
        _issue(run > lim["max_run"], "WARNING", "consecutive_errors", number("Errors in a row: %d", run)),
        _issue(nonsense_share(c) > lim["max_nonsense"], "FAIL", "meaningless", F.lit("Without sense")),
    ]
    alone = F.array(_issue(F.lit(True), "FAIL", "structure", F.lit("Missing text")))
    return F.when(missing, alone).otherwise(F.array_compact(F.array(*found)))


def issues(pairs: DataFrame, *key: str) -> DataFrame:
    """key, level, category, message: one row for each issue of the pairs (clean, corrupted)."""
    return pairs.select(*key, F.explode(row_issues("clean", "corrupted")).alias("i")).select(*key, "i.*")


def verdict(found: Column) -> Column:
    """FAIL over WARNING over PASS."""
    return F.when(F.exists(found, lambda i: i["level"] == "FAIL"), "FAIL").when(F.size(found) > 0, "WARNING").otherwise("PASS")


def summary(pairs: DataFrame) -> DataFrame:
    """One row: rows, failed, warned, clean, quality score."""
    v = pairs.select(verdict(row_issues("clean", "corrupted")).alias("v"))
    n = F.count("*")
    failed, warned = F.count_if(F.col("v") == "FAIL"), F.count_if(F.col("v") == "WARNING")
    score = F.round(1 - failed / F.greatest(n, F.lit(1)), 6)
    return v.agg(n.alias("n_rows"), failed.alias("failed"), warned.alias("warned"), (n - failed - warned).alias("clean"), score.alias("quality_score"))


def _share(when: Column, n: Column) -> Column:
    return F.count_if(when) / F.greatest(n, F.lit(1))


def dataset_issues(rows: DataFrame) -> DataFrame:
    """level, category, subject, direction: what a dataset (complexity, error_types, domain, source) lacks or has too much of."""
    n = F.count("*")
    shares = [_share(F.col("complexity") == c, n).alias(f"c_{c}") for c in lexicons.COMPLEXITY_RANGES]
    shares += [_share(F.array_contains("error_types", t), n).alias(f"t_{t}") for t in lexicons.ERROR_TYPE_LEAST]
    one = rows.agg(n.alias("n"), F.count_distinct(F.coalesce("source", F.lit("unknown"))).alias("n_sources"), *shares)

    def issue(when: Column, category: str, subject: str, direction: str, level: str = "WARNING") -> Column:
        return F.when(when, F.struct(F.lit(level).alias("level"), F.lit(category).alias("category"), F.lit(subject).alias("subject"), F.lit(direction).alias("direction")))

    some = F.col("n") > 0
    found = [issue(~some, "dataset_empty", "dataset", "empty", "FAIL"), issue(some & (F.col("n_sources") < 3), "source_diversity", "source", "low")]
    for c, (low, high) in lexicons.COMPLEXITY_RANGES.items():
        found += [issue(some & (F.col(f"c_{c}") < low), "complexity_distribution", c, "low"), issue(some & (F.col(f"c_{c}") > high), "complexity_distribution", c, "high")]
    for t, low in lexicons.ERROR_TYPE_LEAST.items():
        found.append(issue(some & (F.col(f"t_{t}") < low), "error_type_distribution", t, "low"))
    flat = one.select(F.explode(F.array_compact(F.array(*found))).alias("i")).select("i.*")
    # domains: shares of a small table
    by = rows.groupBy(F.coalesce("domain", F.lit("unknown")).alias("subject")).agg(n.alias("k"))
    by = by.crossJoin(one.select("n")).withColumn("share", F.col("k") / F.col("n"))
    side = F.when(F.col("share") > 0.60, "high").when((F.col("share") < 0.05) & (F.col("n") > 100), "low")
    domains = by.withColumn("direction", side).where("direction is not null").select(F.lit("WARNING").alias("level"), F.lit("domain_imbalance").alias("category"), "subject", "direction")
    return flat.union(domains)


def recommendations(found: DataFrame) -> DataFrame:
    """recommendation: what the issues (level, category) of rows and dataset suggest; one line if nothing does."""
    fail = F.col("level") == "FAIL"

    def n(category: str, extra: Column | None = None) -> Column:
        when = F.col("category") == category
        return F.count_if(when & extra if extra is not None else when)

    counts = found.agg(
        F.count("*").alias("n"), n("insufficient_change", fail).alias("little"), n("excessive_change", fail).alias("much"), n("consecutive_errors").alias("runs"),
        n("low_readability").alias("read"), n("complexity_distribution").alias("complexity"), n("error_type_distribution").alias("types"),
    )
    lines = F.array_compact(
        F.array(
            F.when(F.col("little") > 0, F.lit("Corrupt more strongly, so that rows change")),
            F.when(F.col("much") > 0, F.lit("Corrupt less, so that texts stay readable")),
            F.when(F.col("runs") > 10, F.lit("Spread errors over the sentence")),
            F.when(F.col("read") > F.col("n") * F.lit(0.1), F.lit("Choose errors that keep texts readable")),
            F.when(F.col("complexity") > 0, F.lit("Balance the levels of complexity")),
            F.when(F.col("types") > 0, F.lit("Make more of the rare error types")),
        )
    )
    none = F.array(F.lit("No major issues"))
    return counts.select(F.explode(F.when(F.size(lines) > 0, lines).otherwise(none)).alias("recommendation"))


def profile_flags(rows: DataFrame) -> DataFrame:
    """One row: the profiler's shares of rows hard to read and without sense, the mean of errors, and its flags."""
    c = F.col("corrupted")
    w = text.words(c)
    hard = F.lower(c).rlike(f"[{_CONSONANTS}]{{4,}}") | c.rlike(r"(.)\1{3,}")
    short = F.size(F.filter(w, lambda x: (F.length(F.regexp_replace(x, text.NON_WORD, "")) <= 2) & x.rlike(r"^\p{L}+$")))
    senseless = (F.size(w) == 0) | (short > F.size(w) * F.lit(0.4))
    one = rows.agg(F.round(F.avg(hard.cast("int")), 6).alias("hard_to_read"), F.round(F.avg(senseless.cast("int")), 6).alias("without_sense"), F.round(F.avg("num_errors"), 6).alias("mean_errors"))
    flags = [F.when(F.col("hard_to_read") > 0.05, "hard_to_read"), F.when(F.col("without_sense") > 0.02, "without_sense"), F.when(F.col("mean_errors") < 1.5, "few_errors"), F.when(F.col("mean_errors") > 5, "many_errors")]
    return one.withColumn("flags", F.array_join(F.array_compact(F.array(*flags)), ","))
