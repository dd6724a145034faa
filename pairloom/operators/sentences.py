"""From documents to a pool of clean, distinct, classified sentences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from pairloom.functions import lexicons, text

#: Documents shorter than this are left out; so many pieces of each are looked at where a caller caps texts.
MIN_CHARS, MOST_PIECES = 30, 10


def prefilter(docs: DataFrame, least: int = MIN_CHARS) -> DataFrame:
    """Documents whose stripped text has at least so many characters."""
    return docs.where(F.length(text.strip("text")) >= least)


def split(docs: DataFrame, least: int = MIN_CHARS, most: int | None = None, also: str = "", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, pos, sentence, and the columns to keep: each document's pieces, ended by a period where nothing ends them."""
    # made inside the array, so that a later filter reads a column instead of making the sentence again for each condition
    made = F.transform(text.sentence_pieces("text", most), lambda raw: text.let(text.strip(raw), lambda p: F.when(p == "", p).otherwise(text.reterminate(p, also))))
    return prefilter(docs, least).select("doc_id", *keep, F.posexplode(made).alias("pos", "sentence")).where("sentence != ''")


def is_high_quality(s: Column | str, domain: str | None = None) -> Column:
    """The sentence filter; cheap conditions come first."""
    s = text.col(s)
    n = F.length(s)
    w = text.words(s)
    bare = F.array_distinct(F.transform(w, lambda x: F.regexp_replace(F.lower(x), r"^[.,!?;:]+|[.,!?;:]+$", "")))
    bad = lexicons.BAD_SENTENCE + (lexicons.DOMAINS[domain]["avoid"] if domain else [])
    ok = n.between(20, 200) & F.size(w).between(4, 30) & text.ends_sentence(text.strip(s))
    ok = ok & (F.size(F.array_distinct(text.chars(F.lower(s)))) >= n * F.lit(0.3))
    for p in bad:
        ok = ok & ~s.rlike(p)
    ok = ok & (F.size(bare) >= F.size(w) * F.lit(0.7))
    return ok & (F.length(F.regexp_replace(s, r"[^\p{L}]", "")) >= n * F.lit(0.6))


def is_good(s: Column | str) -> Column:
    """The earlier generator's filter."""
    s = text.col(s)
    n = F.length(s)
    upper = (F.upper(s) == s) & (F.lower(s) != s)
    ok = n.between(10, 150) & text.n_words(s).between(3, 25) & s.rlike("[a-zA-Z]")
    ok = ok & (F.length(F.regexp_replace(s, r"[^\p{L}]", "")) >= n * F.lit(0.6))
    ok = ok & (F.length(F.regexp_replace(s, r"[\p{L}\p{N}_\s'\-.,?!():]", "")) <= 3)
    ok = ok & ~s.rlike(r"^[=#*\-•]") & ~(upper & (n > 10)) & ~s.rlike(r"http|@|www\.|```|[{}]")
    return ok & text.ends_sentence(s, ";") & F.substring(s, 1, 1).rlike(r"^\p{Lu}$")


def first_of(df: DataFrame, key: Column, *order: str) -> DataFrame:
    """The first row of each key in the given order: an aggregate of each key with its own partial step, no global sort."""
    rest = [c for c in df.columns if c not in order]
    first = df.groupBy(key.alias("key_")).agg(F.min(F.struct(*order, *rest)).alias("r"))
    return first.select("r.*").select(*df.columns)


def domain_score(s: Column | str, domain: str) -> Column:
    """How well a sentence fits a domain, at least 0."""
    s, lower = text.col(s), F.lower(text.col(s))
    config = lexicons.DOMAINS[domain]

    def add(points: int, when: Column) -> Column:
        return F.when(when, F.lit(points)).otherwise(F.lit(0))

    def any_of(found: list[Column]) -> Column:
        return reduce(lambda a, b: a | b, found)

    parts = [add(10, text.n_words(s).between(*config["words"]))]
    parts += [add(5, F.contains(lower, F.lit(k))) for k in config["keywords"]]
    parts += [add(-20, s.rlike(p)) for p in config["avoid"]]
    if domain in lexicons.BONUS_PHRASES:
        points, phrases = lexicons.BONUS_PHRASES[domain]
        parts.append(add(points, any_of([F.contains(lower, F.lit(p)) for p in phrases])))
    if domain in lexicons.BONUS_WORDS:
        parts.append(add(3, lower.rlike(rf"(^|{text.NON_WORD})({'|'.join(lexicons.BONUS_WORDS[domain])})({text.NON_WORD}|$)")))
    if domain in lexicons.BONUS_STARTS:
        parts.append(add(3, any_of([F.startswith(lower, F.lit(p)) for p in lexicons.BONUS_STARTS[domain]])))
    if domain == "conversational":
        parts.append(add(2, F.contains(s, F.lit("'"))))
    if domain == "creative":
        parts.append(add(2, F.size(F.filter(text.words(s), lambda w: F.length(w) > 6)) >= 2))
    return F.greatest(F.lit(0), reduce(lambda a, b: a + b, parts))


def classify(s: Column | str) -> Column:
    """The domain with the highest score, the first of equals; general at 5 or less."""
    ranked = F.array(*[F.struct(domain_score(s, d).alias("score"), F.lit(-i).alias("order"), F.lit(d).alias("domain")) for i, d in enumerate(lexicons.DOMAINS)])
    best = F.array_max(ranked)
    return F.when(best["score"] > 5, best["domain"]).otherwise(F.lit("general"))


def pool(docs: DataFrame, most: int | None = None) -> DataFrame:
    """doc_id, pos, sentence, domain: good sentences of whole texts (or of their first `most` pieces), of near duplicates the first."""
    good = split(docs, most=most).where(is_high_quality("sentence"))
    return first_of(good, text.fingerprint("sentence"), "doc_id", "pos").withColumn("domain", classify("sentence"))


def new_against(sentences: DataFrame, seen: DataFrame) -> DataFrame:
    """Sentences whose fingerprint an earlier run (column fp) has not seen."""
    return sentences.withColumn("fp", text.fingerprint("sentence")).join(seen.select("fp").distinct(), "fp", "left_anti").drop("fp")


def early_complexity(s: Column | str) -> Column:
    """simple, medium or complex by words, commas and conjunctions."""
    s = text.col(s)
    n, comma = text.n_words(s), F.contains(s, F.lit(","))
    joined = F.exists(text.words(s), lambda w: F.lower(w).isin("and", "but", "however", "although", "because"))
    nested = (F.length(s) - F.length(F.replace(s, F.lit(","), F.lit(""))) >= 2) | F.contains(s, F.lit(" which ")) | F.contains(s, F.lit(" that "))
    return F.when((n <= 8) & ~comma, "simple").when((n <= 15) & (joined | comma) & ~nested, "medium").otherwise("complex")


def early_pool(docs: DataFrame) -> DataFrame:
    """The earlier generator's sentences: its own filter, distinct in lower case, with its complexity."""
    good = split(docs, 20, None, ";").where(is_good("sentence"))
    return first_of(good, F.lower("sentence"), "doc_id", "pos").withColumn("complexity", early_complexity("sentence"))


def variations(pool: DataFrame, most: int = 10) -> DataFrame:
    """The first sentences of each domain, once without their period and once as a question where a verb allows it."""
    rank = F.row_number().over(W.Window.partitionBy("domain").orderBy("doc_id", "pos"))
    first = pool.withColumn("r", rank).where(F.col("r") <= most)
    s = F.col("sentence")
    bare = F.when(F.endswith(s, F.lit(".")), F.struct(F.lit("no_period").alias("kind"), F.expr("left(sentence, length(sentence) - 1)").alias("variation")))
    verb = s.contains("should") | s.contains("will") | s.contains("can") | s.contains("do")
    asked = F.when(F.endswith(s, F.lit(".")) & verb, F.struct(F.lit("question").alias("kind"), F.concat(F.expr("left(sentence, length(sentence) - 1)"), F.lit("?")).alias("variation")))
    return first.select("domain", "doc_id", "pos", F.explode(F.array_compact(F.array(bare, asked))).alias("v")).select("domain", "doc_id", "pos", "v.*")
