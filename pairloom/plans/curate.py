"""Queries over sentences: splitting, filtering, de-duplication, classification, balancing."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.functions import lexicons, text
from pairloom.functions.rng import draw_sql
from pairloom.functions.text import collapse_sql, fingerprint_sql, strip_sql, words_sql
from pairloom.operators import chat, profiling, sampling, sentences
from pairloom.plans import oracle
from pairloom.plans.registry import query




def docs(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


def pool(spark: SparkSession, sf: str) -> DataFrame:
    return sentences.pool(docs(spark, sf))


@query("doc_prefilter", f"SELECT doc_id, length({strip_sql('text')}) AS n_chars FROM documents WHERE length({strip_sql('text')}) >= 30")
def doc_prefilter(spark, sf):
    return sentences.prefilter(docs(spark, sf)).select("doc_id", F.length(text.strip("text")).alias("n_chars"))


@query("sentence_split", f"WITH {oracle.pieces()} SELECT doc_id, pos, sentence FROM sentences")
def sentence_split(spark, sf):
    return sentences.split(docs(spark, sf)).select("doc_id", "pos", "sentence")


@query("sentence_cap", f"WITH {oracle.pieces(most=sentences.MOST_PIECES)} SELECT doc_id, count(*) AS n, max(pos) AS last_pos FROM sentences GROUP BY doc_id")
def sentence_cap(spark, sf):
    return sentences.split(docs(spark, sf), most=sentences.MOST_PIECES).groupBy("doc_id").agg(F.count("*").alias("n"), F.max("pos").alias("last_pos"))


@query("reterminate", f"WITH {oracle.pieces(20, None, ';')} SELECT doc_id, pos, right(sentence, 1) AS terminator, length(sentence) AS n_chars FROM sentences")
def reterminate(spark, sf):
    return sentences.split(docs(spark, sf), 20, None, ";").select("doc_id", "pos", F.right("sentence", F.lit(1)).alias("terminator"), F.length("sentence").alias("n_chars"))


@query("word_char_counts", f"SELECT doc_id, len({words_sql('text')}) AS n_words, length(text) AS n_chars FROM documents")
def word_char_counts(spark, sf):
    return docs(spark, sf).select("doc_id", text.n_words("text").alias("n_words"), F.length("text").alias("n_chars"))


@query("fingerprint", f"WITH {oracle.pieces()} SELECT doc_id, pos, {fingerprint_sql('sentence')} AS fp FROM sentences")
def fingerprint(spark, sf):
    return sentences.split(docs(spark, sf)).select("doc_id", "pos", text.fingerprint("sentence").alias("fp"))


@query("quality_filter", f"WITH {oracle.pieces()} SELECT doc_id, pos, sentence FROM sentences WHERE {oracle.high_quality('sentence')}")
def quality_filter(spark, sf):
    return sentences.split(docs(spark, sf)).where(sentences.is_high_quality("sentence"))


@query("quality_filter_domain", f"WITH {oracle.pieces()} SELECT doc_id, pos, sentence FROM sentences WHERE {oracle.high_quality('sentence')} AND " + " AND ".join(f"NOT {text.has_sql('sentence', p)}" for p in lexicons.DOMAINS["professional"]["avoid"]))
def quality_filter_domain(spark, sf):
    return sentences.split(docs(spark, sf)).where(sentences.is_high_quality("sentence", "professional"))


@query("good_sentence_filter", f"WITH {oracle.pieces(20, None, ';')} SELECT doc_id, pos, sentence FROM sentences WHERE {oracle.good('sentence')}")
def good_sentence_filter(spark, sf):
    return sentences.split(docs(spark, sf), 20, None, ";").where(sentences.is_good("sentence"))


@query("fingerprint_dedup", f"WITH {oracle.pool()} SELECT doc_id, pos, sentence FROM pool")
def fingerprint_dedup(spark, sf):
    return pool(spark, sf).select("doc_id", "pos", "sentence")


@query(
    "dedup_across_runs",
    f"WITH {oracle.pieces()}, {oracle.pieces(name='earlier').replace('SELECT doc_id, ', 'SELECT item_id AS doc_id, ', 1).replace('FROM documents', 'FROM benchmark')}, good AS (SELECT *, {fingerprint_sql('sentence')} AS fp FROM sentences WHERE {oracle.high_quality('sentence')}), seen AS (SELECT DISTINCT {fingerprint_sql('sentence')} AS fp FROM earlier) SELECT doc_id, pos, sentence FROM good WHERE fp NOT IN (SELECT fp FROM seen)",
)
def dedup_across_runs(spark, sf):
    """Sentences of the documents that an earlier run, over the benchmark, has not seen."""
    good = sentences.split(docs(spark, sf)).where(sentences.is_high_quality("sentence"))
    earlier = sentences.split(spark.read.parquet(f"{sf}/benchmark.parquet").withColumnRenamed("item_id", "doc_id"))
    return sentences.new_against(good, earlier.select(text.fingerprint("sentence").alias("fp"))).select("doc_id", "pos", "sentence")


@query("domain_classify", f"WITH {oracle.pieces()}, {oracle.classified('sentences', 'classified')} SELECT doc_id, pos, domain FROM classified")
def domain_classify(spark, sf):
    return sentences.split(docs(spark, sf)).select("doc_id", "pos", sentences.classify("sentence").alias("domain"))


@query("domain_counts", f"WITH {oracle.pool()} SELECT domain, count(*) AS n, sum(length(sentence)) AS n_chars FROM pool GROUP BY domain")
def domain_counts(spark, sf):
    return pool(spark, sf).groupBy("domain").agg(F.count("*").alias("n"), F.sum(F.length("sentence")).alias("n_chars"))


_EARLY = f"{oracle.pieces(20, None, ';')}, early AS (SELECT doc_id, pos, sentence FROM sentences WHERE {oracle.good('sentence')} QUALIFY row_number() OVER (PARTITION BY lower(sentence) ORDER BY doc_id, pos) = 1)"
_LEVEL = f"""CASE WHEN len({words_sql("sentence")}) <= 8 AND NOT contains(sentence, ',') THEN 'simple'
WHEN len({words_sql("sentence")}) <= 15 AND (contains(sentence, ',') OR list_has_any(list_transform({words_sql("sentence")}, lambda x: lower(x)), ['and', 'but', 'however', 'although', 'because']))
AND NOT (length(sentence) - length(replace(sentence, ',', '')) >= 2 OR contains(sentence, ' which ') OR contains(sentence, ' that ')) THEN 'medium' ELSE 'complex' END"""


@query("complexity_legacy", f"WITH {_EARLY} SELECT doc_id, pos, {_LEVEL} AS complexity FROM early")
def complexity_legacy(spark, sf):
    return sentences.early_pool(docs(spark, sf)).select("doc_id", "pos", "complexity")


@query(
    "sentence_variations",
    f"""WITH {oracle.pool()}, r AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY doc_id, pos) AS r FROM pool), first AS (SELECT * FROM r WHERE r <= 10 AND right(sentence, 1) = '.')
SELECT domain, doc_id, pos, 'no_period' AS kind, left(sentence, length(sentence) - 1) AS variation FROM first
UNION ALL SELECT domain, doc_id, pos, 'question', left(sentence, length(sentence) - 1) || '?' FROM first WHERE contains(sentence, 'should') OR contains(sentence, 'will') OR contains(sentence, 'can') OR contains(sentence, 'do')""",
)
def sentence_variations(spark, sf):
    return sentences.variations(pool(spark, sf))


def _wanted(total: int) -> str:
    return "MAP {" + ", ".join(f"'{d}': {int(total * c['share'])}" for d, c in lexicons.DOMAINS.items()) + "}"


@query(
    "domain_quota",
    f"""WITH {oracle.pool()}, shuffled AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY {draw_sql("quota", "doc_id", "pos")}, doc_id, pos) - 1 AS i, count(*) OVER (PARTITION BY domain) AS have, {_wanted(1000)}[domain] AS want FROM pool),
once AS (SELECT domain, doc_id, pos, sentence, 0 AS copy FROM shuffled WHERE i < want),
short AS (SELECT DISTINCT domain, have, want FROM shuffled WHERE want > have),
again AS (SELECT domain, unnest(range(1, want - have + 1)) AS copy, have FROM short),
drawn AS (SELECT domain, copy, {draw_sql("again", "domain", "copy")} % have AS i FROM again)
SELECT domain, doc_id, pos, sentence, copy FROM once UNION ALL SELECT s.domain, s.doc_id, s.pos, s.sentence, d.copy FROM drawn d JOIN shuffled s ON s.domain = d.domain AND s.i = d.i""",
)
def domain_quota(spark, sf):
    """The quota of 1000 sentences is the operator's own argument."""
    shares = {d: c["share"] for d, c in lexicons.DOMAINS.items()}
    return sampling.quota(pool(spark, sf), 1000, shares, "doc_id", "pos").select("domain", "doc_id", "pos", "sentence", "copy")


_SENTENCE_STATS = f"WITH {oracle.pool()}, v AS (SELECT 'chars' AS name, length(sentence)::DOUBLE AS x FROM pool UNION ALL SELECT 'words', len({words_sql('sentence')})::DOUBLE FROM pool)"


@query(
    "value_stats",
    f"{_SENTENCE_STATS} SELECT name, count(*) AS n, round(avg(x), 6) AS mean, round(median(x), 6) AS median, round(coalesce(stddev_samp(x), 0), 6) AS std, min(x) AS least, max(x) AS most FROM v GROUP BY name",
)
def value_stats(spark, sf):
    found = profiling.statistics(pool(spark, sf), chars=F.length("sentence"), words=text.n_words("sentence"))
    return found.select("name", "n", "mean", "median", "std", "least", "most")


@query("percentiles", f"{_SENTENCE_STATS} SELECT name, round(quantile_cont(x, 0.25), 6) AS p25, round(quantile_cont(x, 0.75), 6) AS p75, round(quantile_cont(x, 0.9), 6) AS p90, round(quantile_cont(x, 0.95), 6) AS p95 FROM v GROUP BY name")
def percentiles(spark, sf):
    return profiling.statistics(pool(spark, sf), chars=F.length("sentence"), words=text.n_words("sentence")).select("name", "p25", "p75", "p90", "p95")


@query(
    "event_value_stats",
    "SELECT event_type AS name, count(*) AS n, round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(coalesce(stddev_samp(value), 0), 6) AS std, min(value) AS least, max(value) AS most FROM events WHERE value IS NOT NULL GROUP BY 1",
)
def event_value_stats(spark, sf):
    rows = spark.read.parquet(f"{sf}/events.parquet").select(F.col("event_type").alias("name"), F.col("value").alias("x"))
    return profiling.described(rows, "name", "x").select("name", "n", "mean", "median", "std", "least", "most")


@query(
    "word_bins",
    f"WITH {oracle.pool()}, w AS (SELECT len({words_sql('sentence')}) AS n FROM pool) SELECT CASE WHEN n <= 5 THEN '1-5 words' WHEN n <= 10 THEN '6-10 words' WHEN n <= 15 THEN '11-15 words' WHEN n <= 20 THEN '16-20 words' ELSE '20+ words' END AS value, count(*) AS n FROM w GROUP BY 1",
)
def word_bins(spark, sf):
    return profiling.histogram(pool(spark, sf), profiling.word_bin(text.n_words("sentence")))


@query("plot_histogram", f"WITH {oracle.pool()}, w AS (SELECT length(sentence) AS x FROM pool) SELECT CASE WHEN x < 0 THEN 0 WHEN x >= 200 THEN 21 ELSE floor(x / 10)::INT + 1 END AS bin, count(*) AS n FROM w GROUP BY 1")
def plot_histogram(spark, sf):
    return profiling.equal_width(pool(spark, sf).withColumn("x", F.length("sentence")), "x", 0, 200, 20)


@query(
    "categorical_counts",
    "SELECT 'lang' AS \"column\", coalesce(lang, 'unknown') AS value, count(*) AS n FROM documents GROUP BY ALL UNION ALL SELECT 'source', coalesce(source, 'unknown'), count(*) FROM documents GROUP BY ALL",
)
def categorical_counts(spark, sf):
    return profiling.counts(docs(spark, sf), "lang", "source")


@query(
    "entropy_balance",
    """WITH c AS (SELECT 'lang' AS "column", lang AS value, count(*) AS n FROM documents GROUP BY ALL UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY ALL),
p AS (SELECT "column", n / sum(n) OVER (PARTITION BY "column") AS p FROM c)
SELECT "column", count(*) AS diversity, round(CASE WHEN count(*) > 1 THEN -sum(p * log2(p)) / log2(count(*)::DOUBLE) ELSE 0 END, 6) AS balance FROM p GROUP BY 1""",
)
def entropy_balance(spark, sf):
    return profiling.balance(profiling.counts(docs(spark, sf), "lang", "source"))


@query("ending_chars", f"WITH d AS (SELECT 'text' AS side, right({strip_sql('text')}, 1) AS last FROM documents WHERE {strip_sql('text')} <> '') SELECT side, last, count(*) AS n FROM d GROUP BY ALL")
def ending_chars(spark, sf):
    return profiling.last_characters(docs(spark, sf), "text")


@query("topk_frequency", f"WITH {oracle.pieces()}, w AS (SELECT unnest({words_sql('lower(sentence)')}) AS value FROM sentences) SELECT value, count(*) AS n FROM w GROUP BY 1 ORDER BY n DESC, value LIMIT 10")
def topk_frequency(spark, sf):
    words = sentences.split(docs(spark, sf)).select(text.words(F.lower("sentence")).alias("w"))
    return profiling.top(profiling.label_counts(words, "w"), 10, "value")


@query("rate_by_label", "SELECT lang, count(*) AS n, count(*) FILTER (quality = 1) AS good, round(avg(CASE WHEN quality = 1 THEN 1.0 ELSE 0.0 END), 6) AS rate FROM documents JOIN labels USING (doc_id) GROUP BY lang")
def rate_by_label(spark, sf):
    rows = docs(spark, sf).select("doc_id", "lang").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    return rows.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 1).alias("good"), F.round(F.avg(F.when(F.col("quality") == 1, 1.0).otherwise(0.0)), 6).alias("rate"))


@query("distinct_sources", "SELECT lang, count(DISTINCT source) AS n_sources, count(DISTINCT source) < 3 AS too_few FROM documents GROUP BY lang")
def distinct_sources(spark, sf):
    n = F.count_distinct("source")
    return docs(spark, sf).groupBy("lang").agg(n.alias("n_sources"), (n < 3).alias("too_few"))


@query(
    "normalize_text",
    rf"""SELECT doc_id, md5(regexp_replace({collapse_sql("lower(text)")}, '\.$', '')) AS plain, md5({collapse_sql("translate(lower(text), '.,', '')")}) AS a, md5(translate({strip_sql("lower(text)")}, '.,', '')) AS b, md5({collapse_sql("translate(lower(text), '.', '')")}) AS c, md5({strip_sql("lower(text)")}) AS exact, md5(regexp_replace(text, '\.+$', '')) AS no_periods FROM documents""",
)
def normalize_text(spark, sf):
    forms = {"plain": text.normalize("text"), "a": text.normalize_a("text"), "b": text.normalize_b("text"), "c": text.normalize_c("text"), "exact": text.exact_form("text"), "no_periods": text.strip_periods("text")}
    return docs(spark, sf).select("doc_id", *[F.md5(c).alias(k) for k, c in forms.items()])


@query(
    "punctuation_rule",
    rf"""WITH {oracle.pool()} SELECT doc_id, pos, (regexp_matches(sentence, '(etc|Mr|Ms|Dr|Inc|Ltd)\.$') OR contains(sentence, '?') OR contains(sentence, '!') OR length(sentence) - length(replace(sentence, '.', '')) > 1) AS keeps,
(regexp_matches(sentence, '\.$') AND NOT regexp_matches(sentence, '(etc|Mr|Dr)\.$') AND NOT regexp_matches(sentence, '(^|[^\p{{L}}\p{{N}}_])[A-Z]\.$')) AS candidate FROM pool""",
)
def punctuation_rule(spark, sf):
    return pool(spark, sf).select("doc_id", "pos", chat.keeps_period("sentence").alias("keeps"), chat.no_period_candidate("sentence").alias("candidate"))


@query(
    "train_eval_split",
    f"WITH s AS (SELECT doc_id, row_number() OVER (ORDER BY {draw_sql('split', 'doc_id')}, doc_id) - 1 AS i, count(*) OVER () AS n FROM documents) SELECT doc_id, CASE WHEN i < floor(n * 0.1::DOUBLE) THEN 'eval' ELSE 'train' END AS split FROM s",
)
def train_eval_split(spark, sf):
    return sampling.split_eval(docs(spark, sf).select("doc_id"), 0.1, "doc_id")


@query("stratified_sample", f"SELECT lang, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY {draw_sql('stratified', 'doc_id')}, doc_id) <= 10")
def stratified_sample(spark, sf):
    return sampling.stratified(docs(spark, sf).select("lang", "doc_id"), "lang", 10, "doc_id")


@query("random_sample", f"SELECT doc_id FROM documents ORDER BY {draw_sql('sample', 'doc_id')}, doc_id LIMIT 50")
def random_sample(spark, sf):
    return sampling.sample(docs(spark, sf).select("doc_id"), 50, "doc_id")


@query("last_rows", "SELECT doc_id FROM documents ORDER BY doc_id DESC LIMIT 100")
def last_rows(spark, sf):
    return sampling.last(docs(spark, sf).select("doc_id"), 100, "doc_id")


@query("conversation_chatml", "SELECT conv_id, turn, '<|im_start|>user' || chr(10) || text || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) || next_text || '<|im_end|>' AS text FROM (SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND next_role = 'assistant'")
def conversation_chatml(spark, sf):
    turns = chat.adjacent_turns(spark.read.parquet(f"{sf}/conversations.parquet"))
    return chat.chatml_text(turns, "conv_id", "turn")


@query("conversation_prompt", "SELECT conv_id, string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>', chr(10) ORDER BY turn) || chr(10) || '<|im_start|>assistant' || chr(10) AS text FROM conversations GROUP BY conv_id")
def conversation_prompt(spark, sf):
    turn = F.struct("turn", F.col("role"), F.col("text").alias("content"))
    rows = spark.read.parquet(f"{sf}/conversations.parquet").groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("m"))
    return rows.select("conv_id", text.chatml(F.col("m"), generation=True).alias("text"))


@query(
    "conversation_template",
    """WITH c AS (SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n, lag(role) OVER w AS before, lead(role) OVER w AS after FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
q AS (SELECT conv_id, coalesce(max(CASE WHEN role = 'user' AND NOT (starts_with(text, '<tool_response>') AND ends_with(text, '</tool_response>')) THEN i END), max(n) - 1) AS question FROM c GROUP BY conv_id),
t AS (SELECT c.*, CASE WHEN role = 'system' AND i = 0 THEN '<|im_start|>system' || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10) WHEN role IN ('user', 'system') THEN '<|im_start|>' || role || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10)
WHEN role = 'assistant' THEN '<|im_start|>assistant' || chr(10) || CASE WHEN i > question AND i = n - 1 THEN '<think>' || chr(10) || chr(10) || '</think>' || chr(10) || chr(10) || ltrim(coalesce(text, ''), chr(10)) ELSE coalesce(text, '') END || '<|im_end|>' || chr(10)
WHEN role = 'tool' THEN CASE WHEN before IS DISTINCT FROM 'tool' THEN '<|im_start|>user' ELSE '' END || chr(10) || '<tool_response>' || chr(10) || coalesce(text, '') || chr(10) || '</tool_response>' || CASE WHEN after IS DISTINCT FROM 'tool' THEN '<|im_end|>' || chr(10) ELSE '' END ELSE '' END AS said FROM c JOIN q USING (conv_id))
SELECT conv_id, string_agg(said, '' ORDER BY turn) || '<|im_start|>assistant' || chr(10) AS text FROM t GROUP BY conv_id""",
)
def conversation_template(spark, sf):
    """Whole conversations by the full chat template; the table has no calls and no reasoning of their own."""
    turn = F.struct("turn", F.col("role"), F.col("text").alias("content"), F.lit(None).cast("string").alias("reasoning"), F.lit(None).cast("array<struct<name: string, arguments: string>>").alias("calls"))
    rows = spark.read.parquet(f"{sf}/conversations.parquet").groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("m"))
    return rows.select("conv_id", text.chat_text(F.col("m"), generation=True).alias("text"))


@query("text_truncate", "SELECT doc_id, substr(text, 1, 80) AS head, upper(lang) AS lang FROM documents")
def text_truncate(spark, sf):
    return docs(spark, sf).select("doc_id", F.substring("text", 1, 80).alias("head"), F.upper("lang").alias("lang"))


@query(
    "profile_cube",
    f"""WITH {oracle.pieces()}, {oracle.classified('sentences', 'classified')}, r AS (SELECT lang, source, domain, sentence FROM classified JOIN documents USING (doc_id))
SELECT GROUPING_ID(lang, source, domain)::INT AS level, lang, source, domain, count(*) AS n, sum(length(sentence))::BIGINT AS n_chars, max(length(sentence)) AS longest FROM r
GROUP BY GROUPING SETS ((), (lang), (source), (domain), (lang, source), (lang, domain), (source, domain))""",
)
def profile_cube(spark, sf):
    """Sentences by language, source and domain, and by each two of them."""
    found = sentences.split(docs(spark, sf)).select("doc_id", F.length("sentence").alias("n"), sentences.classify("sentence").alias("domain"))
    rows = found.join(docs(spark, sf).select("doc_id", "lang", "source"), "doc_id")
    return profiling.cube(rows, ["lang", "source", "domain"], 2, n=F.count("*"), n_chars=F.sum("n"), longest=F.max("n"))
