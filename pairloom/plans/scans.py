"""Queries that scan, write and read again: every source and sink over a whole table, against what the table holds."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.functions import lexicons, text
from pairloom.functions.text import quoted, words_sql
from pairloom.operators import corruption, patterns, profiling, scoring, tokens
from pairloom.plans import oracle
from pairloom.plans.curate import docs, pool
from pairloom.plans.pairs import pairs
from pairloom.plans.registry import query
from pairloom.sources import cases, files, places
from pairloom.sources.registry import Sources

_LINE = "doc_id long, text string, lang string, source string, n_chars long"
_DIGEST = "doc_id, md5(text) AS text_md5, lang, source, n_chars"


def _digest(df: DataFrame) -> DataFrame:
    return df.select("doc_id", F.md5("text").alias("text_md5"), "lang", "source", "n_chars")


def _sources(sf: str) -> Sources:
    return Sources("docs").table("docs", f"{sf}/documents.parquet").table("items", f"{sf}/benchmark.parquet", key="item_id").table("gone", f"{sf}/no_such_table.parquet")


@query("source_scan", "SELECT 'docs' AS asked, doc_id, md5(text) AS text_md5 FROM documents UNION ALL SELECT 'unheard_of', doc_id, md5(text) FROM documents UNION ALL SELECT 'items', item_id, md5(text) FROM benchmark")
def source_scan(spark, sf):
    """Sources by name; an unknown name is the default's."""
    found = [_sources(sf).load(spark, name).select(F.lit(name).alias("asked"), "doc_id", F.md5("text").alias("text_md5")) for name in ("docs", "unheard_of", "items")]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query("source_fallback", f"WITH {oracle.values(list(enumerate(cases.SAMPLES)), 'doc_id, text', 's')} SELECT 'gone' AS asked, doc_id, md5(text) AS text_md5 FROM s UNION ALL SELECT 'docs', doc_id, md5(text) FROM documents")
def source_fallback(spark, sf):
    """A source that cannot be read gives the built-in sentences, one that can its rows."""
    found = [_sources(sf).load(spark, name).select(F.lit(name).alias("asked"), "doc_id", F.md5("text").alias("text_md5")) for name in ("gone", "docs")]
    return found[0].unionByName(found[1])


@query("source_union", "SELECT 'documents' AS source, doc_id, md5(text) AS text_md5 FROM documents UNION ALL SELECT 'benchmark', item_id, md5(text) FROM benchmark")
def source_union(spark, sf):
    one = docs(spark, sf).select(F.lit("documents").alias("source"), "doc_id", "text")
    two = spark.read.parquet(f"{sf}/benchmark.parquet").select(F.lit("benchmark").alias("source"), F.col("item_id").alias("doc_id"), "text")
    return one.unionByName(two).select("source", "doc_id", F.md5("text").alias("text_md5"))


@query("jsonl_strict", f"SELECT {_DIGEST} FROM documents")
def jsonl_strict(spark, sf):
    """Documents written as JSON Lines and read strictly."""
    path = places.scratch(spark, "lines")
    files.write_lines(docs(spark, sf), path)
    return _digest(files.read_strict(spark, path, _LINE))


def _damaged(spark: SparkSession, sf: str) -> str:
    """JSON Lines of which those of German documents are cut short."""
    path = places.scratch(spark, "damaged")
    line = F.to_json(F.struct("*"))
    rows = docs(spark, sf).select(F.when(F.coalesce(F.col("lang") == "de", F.lit(False)), F.substring(line, F.lit(1), F.length(line) - 1)).otherwise(line).alias("value"))
    rows.write.text(path)
    return path


@query("jsonl_permissive", f"SELECT {_DIGEST} FROM documents WHERE lang IS DISTINCT FROM 'de'")
def jsonl_permissive(spark, sf):
    return _digest(files.read_permissive(spark, _damaged(spark, sf), _LINE))


@query("jsonl_bad_lines", "SELECT doc_id FROM documents WHERE lang = 'de'")
def jsonl_bad_lines(spark, sf):
    bad = files.bad_lines(spark, _damaged(spark, sf), _LINE)
    return bad.select(F.regexp_extract("line", r'"doc_id":(\d+)', 1).cast("long").alias("doc_id"))


@query("files_by_extension", "SELECT kind, c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer, (VALUES ('csv'), ('json'), ('jsonl'), ('orc'), ('parquet')) k(kind)")
def files_by_extension(spark, sf):
    """A table written in five formats, each read by its extension."""
    table, out = spark.read.parquet(f"{sf}/customer.parquet"), None
    for kind in ("csv", "json", "jsonl", "orc", "parquet"):
        path = f"{places.scratch(spark, 'any')}.{kind}"
        writer = table.write.option("header", True) if kind == "csv" else table.write
        writer.format({"jsonl": "json"}.get(kind, kind)).save(path)
        read = files.read_any(spark, path).select(F.lit(kind).alias("kind"), *[F.col(f.name).cast(f.dataType) for f in table.schema.fields])
        out = read if out is None else out.unionByName(read)
    return out


_GUESSED = [("documents", "text", "lang"), ("pages", "url", "html"), ("conversations", "role", "text"), ("customer", "c_name", "c_mktsegment")]


@query("column_guess", " UNION ALL ".join(f"SELECT '{t}' AS name, '{a}' AS source_column, '{b}' AS target, count(*) AS n, count({a}) AS n_source, count({b}) AS n_target FROM {t}" for t, a, b in _GUESSED))
def column_guess(spark, sf):
    """The text columns guessed for each table that has two, and how many of their values are there."""
    out = None
    for name, _, _ in _GUESSED:
        table = spark.read.parquet(f"{sf}/{name}.parquet")
        a, b = files.guess_columns(table)
        row = table.agg(F.lit(name).alias("name"), F.lit(a).alias("source_column"), F.lit(b).alias("target"), F.count("*").alias("n"), F.count(a).alias("n_source"), F.count(b).alias("n_target"))
        out = row if out is None else out.unionByName(row)
    return out


@query("pool_sink", f"WITH {oracle.pool()} SELECT domain, sentence FROM pool")
def pool_sink(spark, sf):
    """The pool of all sentences, written by domain and read again."""
    path = places.scratch(spark, "pool")
    files.write_pool(pool(spark, sf), path)
    return spark.read.schema("sentence string, domain string").json(f"{path}/sentences").select("domain", "sentence")


@query("pool_metadata", f"WITH {oracle.pool()} SELECT count(*) AS total_sentences, count(DISTINCT domain) AS domains, 'documents' AS collection_method, true AS quality_filtered FROM pool")
def pool_metadata(spark, sf):
    path = places.scratch(spark, "pool")
    files.write_pool(pool(spark, sf), path)
    return spark.read.json(f"{path}/metadata").select("total_sentences", "domains", "collection_method", "quality_filtered")


@query("pool_report", f"WITH {oracle.pool()}, p AS (SELECT domain AS value, count(*) AS n, sum(length(sentence)) AS chars FROM pool GROUP BY domain) SELECT value, n FROM p UNION ALL SELECT 'total_sentences', sum(n)::BIGINT FROM p UNION ALL SELECT 'total_chars', sum(chars)::BIGINT FROM p UNION ALL SELECT 'domains', count(*) FROM p")
def pool_report(spark, sf):
    """The report that the write of the pool returns, without another pass."""
    meta = files.write_pool(pool(spark, sf), places.scratch(spark, "pool"))
    return spark.createDataFrame([*meta["domain_counts"].items(), *[(k, meta[k]) for k in ("total_sentences", "total_chars", "domains")]], "value string, n long")


_DOMAIN_SAMPLES = [(d, i, f"{a} {b}") for d, (starts, ends) in cases.DOMAIN_PARTS.items() for i, (a, b) in enumerate((a, b) for b in ends for a in starts)]


@query("domain_samples", f"WITH {oracle.pool()}, {oracle.values(_DOMAIN_SAMPLES, 'domain, pos, sentence', 's')}, n AS (SELECT domain, count(*) AS n FROM pool GROUP BY domain) SELECT domain, sentence, false AS built_in FROM pool UNION ALL SELECT domain, sentence, true FROM s WHERE domain NOT IN (SELECT domain FROM n WHERE n >= 200)")
def domain_samples(spark, sf):
    """The documents' sentences of each domain, and the built-in ones where a domain has fewer than 200."""
    own = pool(spark, sf).select("domain", "sentence")
    enough = own.groupBy("domain").agg(F.count("*").alias("n")).where("n >= 200").select("domain")
    samples = cases.domain_samples(spark).select("domain", "sentence").join(enough, "domain", "left_anti")
    return own.withColumn("built_in", F.lit(False)).unionByName(samples.withColumn("built_in", F.lit(True)))


@query("pool_scan", f"WITH {oracle.pool()} SELECT domain, sentence FROM pool")
def pool_scan(spark, sf):
    """The pool as JSON pool documents, one for each document of the table, written and read."""
    path = places.scratch(spark, "documents")
    files.pool_documents(pool(spark, sf), "doc_id").write.text(path)
    return files.read_pool(spark, path, lines=True).select("domain", "sentence")


@query("checkpoint_folder", "SELECT 'checkpoint-' || n AS checkpoint, n AS step, max(n / 100.0::DOUBLE) AS epoch FROM (SELECT count(*) AS n FROM documents GROUP BY lang) GROUP BY n")
def checkpoint_folder(spark, sf):
    """A folder for each language, named after its documents, listed with the epochs their states name; other folders are passed over."""
    path = places.scratch(spark, "run")
    counts = docs(spark, sf).groupBy("lang").agg(F.count("*").alias("n"))
    for (n,) in {r[1:] for r in counts.collect()}:  # one folder for each language
        spark.createDataFrame([(n / 100.0, n)], "epoch double, global_step long").coalesce(1).write.json(f"{path}/checkpoint-{n}/trainer_state.json")
    counts.write.json(f"{path}/runs")
    return files.checkpoint_folder(spark, path).select("checkpoint", F.col("step").cast("long").alias("step"), "epoch")


@query("token_cache", f"SELECT doc_id, array_to_string(list_transform({words_sql('text')}, lambda w: length(w)), ' ') AS ids FROM documents")
def token_cache(spark, sf):
    """A token column (here the lengths of words) cached with its settings and read again."""
    path = places.scratch(spark, "cache")
    files.write_cache(docs(spark, sf).select("doc_id", F.transform(text.words("text"), lambda w: F.length(w)).alias("input_ids")), path, model="lengths", max_length="none")
    read = files.read_cache(spark, path, model="lengths", max_length="none")
    return read.select("doc_id", F.array_join(F.transform("input_ids", lambda x: x.cast("string")), " ").alias("ids"))


_GIVEN = ["the", "ung", "\n", "no such text"]


@query("given_texts", f"WITH {oracle.values(list(enumerate(_GIVEN)), 'id, text', 't').replace(quoted(_GIVEN[2]), 'chr(10)')} SELECT t.id, t.text, count(d.doc_id) AS n_docs FROM t LEFT JOIN documents d ON contains(d.text, t.text) GROUP BY ALL")
def given_texts(spark, sf):
    """Texts given by hand, and in how many documents each stands."""
    given = files.texts(spark, _GIVEN)
    hits = patterns.pattern_hits(docs(spark, sf), given.withColumnRenamed("text", "pattern"), ["doc_id"])
    return given.join(hits.groupBy("id").agg(F.count("*").alias("n_docs")), "id", "left").select("id", "text", F.coalesce("n_docs", F.lit(0)).cast("long").alias("n_docs"))


@query("report_sink", "SELECT 'lang' AS part, coalesce(lang, 'null') AS value, count(*) AS n FROM documents GROUP BY ALL UNION ALL SELECT 'source', coalesce(source, 'null'), count(*) FROM documents GROUP BY ALL")
def report_sink(spark, sf):
    """A JSON report of counts, written and read."""
    path = places.scratch(spark, "report")
    counts = {c: docs(spark, sf).groupBy(F.coalesce(c, F.lit("null")).alias("value")).agg(F.count("*").alias("n")) for c in ("lang", "source")}
    files.report(**counts).coalesce(1).write.text(path)
    part = "array<struct<value: string, n: long>>"
    row = spark.read.text(path).select(F.from_json("value", f"lang {part}, source {part}").alias("r"))
    each = [row.select(F.lit(c).alias("part"), F.explode(f"r.{c}").alias("x")).select("part", "x.*") for c in counts]
    return each[0].unionByName(each[1])


#: A public byte-level vocabulary; the query is there where the file is.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"


def subword_round_trip(spark, sf):
    """Whole texts as subword ids and back, which a byte-level vocabulary does without loss."""
    ids = docs(spark, sf).select("doc_id", tokens.subword_ids(TOKENIZER, None)(F.col("text")).alias("ids"))
    return ids.select("doc_id", (F.size("ids") > 0).alias("any_ids"), F.md5(tokens.subword_text(TOKENIZER)(F.col("ids"))).alias("text_md5"))


if os.path.exists(TOKENIZER):
    query("subword_round_trip", "SELECT doc_id, coalesce(text, '') <> '' AS any_ids, md5(coalesce(text, '')) AS text_md5 FROM documents")(subword_round_trip)


# ---- small operators without a query of their own ----

_WORD_LIST = f"WITH {oracle.pieces()}, w AS (SELECT doc_id, pos, generate_subscripts({words_sql('sentence')}, 1) - 1 AS nth, unnest({words_sql('sentence')}) AS word FROM sentences)"


@query(
    "whole_case",
    f"{_WORD_LIST} SELECT doc_id, pos, nth, CASE WHEN upper(word) = word AND lower(word) <> word THEN 'NEW-word' ELSE 'other' END AS kind, "
    r"CASE WHEN upper(word) = word AND lower(word) <> word THEN upper('neW-word') WHEN regexp_matches(substr(word, 1, 1), '^\p{Lu}$') THEN 'New-word' ELSE 'neW-word' END AS made FROM w",
)
def whole_case(spark, sf):
    from pairloom.operators import sentences

    words = sentences.split(docs(spark, sf)).select("doc_id", "pos", F.posexplode(text.words("sentence")).alias("nth", "word"))
    upper = (text.upper("word") == F.col("word")) & (text.lower("word") != F.col("word"))
    return words.select("doc_id", "pos", "nth", F.when(upper, "NEW-word").otherwise("other").alias("kind"), text.whole_case(F.col("word"), F.lit("neW-word")).alias("made"))


@query("strip_forms", f"SELECT doc_id, md5(regexp_replace(text, '\\.$', '')) AS one_period, md5(replace({quoted(lexicons.CHAT_PROMPT)} || text, {quoted(lexicons.CHAT_PROMPT)}, '')) AS bare FROM documents")
def strip_forms(spark, sf):
    prompted = F.concat(F.lit(lexicons.CHAT_PROMPT), F.col("text"))
    return docs(spark, sf).select("doc_id", F.md5(text.strip_one_period("text")).alias("one_period"), F.md5(text.strip_prompt(prompted)).alias("bare"))


@query("word_pair_kinds", f"WITH {oracle.scored_pairs()} SELECT kind, count(*) AS n FROM (SELECT {oracle.pair_kind()} AS kind FROM chars_s WHERE same_n) GROUP BY kind")
def word_pair_kinds(spark, sf):
    """The profiler's kinds of unlike words."""
    found = profiling.corruption_pairs(pairs(spark, sf))
    return found.groupBy("kind").agg(F.sum("n").alias("n"))


_LEAST = {"multi_error_sentences": (6, 2), "contextual_phonetic": (4, 1), "advanced_typography": (3, 1), "keyboard_patterns": (3, 1), "simple_single": (3, 1)}


@query(
    "least_words_and_errors",
    f"WITH {oracle.scored_pairs()}, m(method, words, errors) AS (VALUES {', '.join(f'({quoted(k)}, {w}, {e})' for k, (w, e) in _LEAST.items())}) SELECT method, count(*) FILTER (word_count >= words) AS enough_words, count(*) FILTER (word_count >= words AND num_errors >= errors) AS kept FROM scored, m GROUP BY method",
)
def least_words_and_errors(spark, sf):
    """How many pairs pass each method's least words and least real errors."""
    rows = pairs(spark, sf).select(text.n_words("clean").alias("w"), scoring.word_changes("clean", "corrupted").alias("e"))
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("method"), F.lit(w).alias("words"), F.lit(e).alias("errors")) for k, (w, e) in corruption.LEAST.items()]))
    enough = F.col("w") >= F.col("m.words")
    return rows.select("w", "e", each.alias("m")).groupBy("m.method").agg(F.count(F.when(enough, 1)).alias("enough_words"), F.count(F.when(enough & (F.col("e") >= F.col("m.errors")), 1)).alias("kept"))
