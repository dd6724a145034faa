"""Queries over clean and corrupted pairs: corruption, scoring, validation, profiles, training records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.functions import lexicons, text
from pairloom.functions.rng import draw_sql
from pairloom.functions.text import quoted, words_sql
from pairloom.operators import chat, corruption, profiling, sampling, scoring, sentences, tokens, validation
from pairloom.plans import oracle
from pairloom.plans.curate import docs, pool
from pairloom.plans.registry import query
from pairloom.sources import files


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    return corruption.edit_pairs(pool(spark, sf))


def examples(spark: SparkSession, sf: str) -> DataFrame:
    return corruption.examples(pairs(spark, sf))


@query("pair_edit", f"WITH {oracle.pairs()} SELECT doc_id, pos, clean, corrupted, source FROM pairs")
def pair_edit(spark, sf):
    return pairs(spark, sf).select("doc_id", "pos", "clean", "corrupted", "source")


_H = lambda step: draw_sql(step, "doc_id", "pos", "nth")
_KB = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in lexicons.KEYBOARD.items()) + "}"


def _every_word(spark, sf, f) -> DataFrame:
    """doc_id, pos, nth, word, made: a word corruption applied to every word of every sentence of the whole texts."""
    words = sentences.split(docs(spark, sf)).select("doc_id", "pos", F.posexplode(text.words("sentence")).alias("nth", "word"))
    return words.select("doc_id", "pos", "nth", "word", f(F.col("word"), corruption.Draws("doc_id", "pos", "nth")).alias("made"))


#: Every word of every sentence, as _every_word has it.
_EVERY = f"WITH {oracle.pieces()}, w AS (SELECT doc_id, pos, {words_sql('sentence')} AS w FROM sentences), f AS (SELECT doc_id, pos, generate_subscripts(w, 1) - 1 AS nth, unnest(w) AS word FROM w)"


@query(
    "pair_keyboard",
    f"""{_EVERY}, k AS (SELECT *, {_H('key-pos')} % length(word) AS p, {_KB}[lower(substr(word, ({_H('key-pos')} % length(word)) + 1, 1))] AS near FROM f),
n AS (SELECT *, substr(near, ({_H('key-pick')} % greatest(length(near), 1)) + 1, 1) AS c FROM k)
SELECT doc_id, pos, nth, word, CASE WHEN length(word) >= 2 AND near IS NOT NULL AND {_H('key-hit')} < {int(0.4 * (1 << 32))} THEN substr(word, 1, p) || CASE WHEN regexp_matches(substr(word, p + 1, 1), '^\\p{{Lu}}$') THEN upper(c) ELSE c END || substr(word, p + 2) ELSE word END AS made FROM n""",
)
def pair_keyboard(spark, sf):
    return _every_word(spark, sf, corruption.keyboard_error)


_SIM = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in lexicons.SIMILAR.items()) + "}"


@query(
    "pair_character",
    f"""{_EVERY}, h AS (SELECT *, length(word) AS n, {_H('op')} % 4 AS op, {_H('ins-pos')} % (length(word) + 1) AS ip, {_H('ins-vowel')} % 5 AS iv, {_H('ins-same')} AS same, {_H('del-pos')} % greatest(length(word) - 2, 1) + 1 AS dp,
{_H('swap-pos')} % greatest(length(word) - 1, 1) AS sp, {_H('sub-pos')} % length(word) AS up, {_H('sub-pick')} AS uc FROM f),
s AS (SELECT *, {_SIM}[lower(substr(word, up + 1, 1))] AS near FROM h)
SELECT doc_id, pos, nth, word, CASE WHEN n < 3 THEN word
WHEN op = 0 THEN CASE WHEN ip = 0 THEN word ELSE substr(word, 1, ip) || CASE WHEN same < {int(0.7 * (1 << 32))} THEN substr(word, ip, 1) ELSE substr('aeiou', iv + 1, 1) END || substr(word, ip + 1) END
WHEN op = 1 THEN substr(word, 1, dp) || substr(word, dp + 2)
WHEN op = 2 THEN substr(word, 1, sp) || substr(word, sp + 2, 1) || substr(word, sp + 1, 1) || substr(word, sp + 3)
WHEN near IS NULL THEN word ELSE substr(word, 1, up) || CASE WHEN regexp_matches(substr(word, up + 1, 1), '^\\p{{Lu}}$') THEN upper(substr(near, (uc % length(near)) + 1, 1)) ELSE substr(near, (uc % length(near)) + 1, 1) END || substr(word, up + 2) END AS made FROM s""",
)
def pair_character(spark, sf):
    return _every_word(spark, sf, corruption.character_error)


def _preserved(word: str, new: str) -> str:
    """preserve_case in SQL, for non-empty texts."""
    return rf"array_to_string([CASE WHEN j <= length({word}) AND regexp_matches(substr({word}, j, 1), '^\p{{Lu}}$') THEN upper(substr({new}, j, 1)) ELSE lower(substr({new}, j, 1)) END for j in range(1, length({new}) + 1)], '')"


def _lists(table: dict) -> str:
    return "MAP {" + ", ".join(f"{quoted(k)}: [{', '.join(map(quoted, v if isinstance(v, list) else [v]))}]" for k, v in table.items()) + "}"


def _rule(i: int, old: str, new: str) -> str:
    at = f"instr(lower(word), '{old}')"
    out = f"(substr(lower(word), 1, {at} - 1) || '{new}' || substr(lower(word), {at} + {len(old)}))"
    return f"WHEN contains(lower(word), '{old}') AND {_H(f'rule{i}')} < {int(0.2 * (1 << 32))} THEN {_preserved('word', out)}"


@query(
    "pair_phonetic",
    f"""{_EVERY}, p AS (SELECT *, {_lists(lexicons.MISSPELLINGS)}[lower(word)] AS miss, {_lists(lexicons.HOMOPHONES)}[lower(word)] AS homo FROM f),
q AS (SELECT *, miss[({_H('miss-pick')} % len(miss)) + 1] AS m, homo[({_H('homo-pick')} % len(homo)) + 1] AS o FROM p)
SELECT doc_id, pos, nth, word, CASE WHEN miss IS NOT NULL AND {_H('miss')} < {int(0.6 * (1 << 32))} THEN {_preserved('word', 'm')} WHEN homo IS NOT NULL AND {_H('homo')} < {int(0.3 * (1 << 32))} THEN {_preserved('word', 'o')}
{' '.join(_rule(i, a, b) for i, (a, b) in enumerate(lexicons.PHONETIC_RULES))} ELSE word END AS made FROM q""",
)
def pair_phonetic(spark, sf):
    return _every_word(spark, sf, corruption.phonetic_error)


@query(
    "pair_contraction",
    f"""{_EVERY}, p AS (SELECT *, {_lists(lexicons.CONTRACTIONS)}[lower(word)] AS o FROM f), q AS (SELECT *, o[({_H('contraction-pick')} % len(o)) + 1] AS m FROM p)
SELECT doc_id, pos, nth, word, CASE WHEN o IS NOT NULL AND {_H('contraction')} < {1 << 31} THEN {_preserved('word', 'm')} ELSE word END AS made FROM q""",
)
def pair_contraction(spark, sf):
    return _every_word(spark, sf, corruption.contraction_error)


@query(
    "pair_compound",
    f"""{_EVERY}, p AS (SELECT *, {_lists(lexicons.COMPOUNDS)}[lower(word)][1] AS m FROM f)
SELECT doc_id, pos, nth, word, CASE WHEN m IS NOT NULL AND {_H('compound')} < {int(0.4 * (1 << 32))} THEN {_preserved('word', 'm')} ELSE word END AS made FROM p""",
)
def pair_compound(spark, sf):
    return _every_word(spark, sf, corruption.compound_error)


_PAIR_HIT = f"{draw_sql('pair', 'doc_id', 'pos', 'nth', 'i')} < {int(0.3 * (1 << 32))}"


@query(
    "pair_double_letter",
    f"""{_EVERY}, p AS (SELECT *, {_lists(lexicons.DOUBLE_LETTERS)}[lower(word)][1] AS m, [i for i in range(0, length(word) - 1) if substr(lower(word), i + 1, 1) = substr(lower(word), i + 2, 1) AND {_PAIR_HIT}] AS c FROM f)
SELECT doc_id, pos, nth, word, CASE WHEN m IS NOT NULL AND {_H('double')} < {int(0.4 * (1 << 32))} THEN {_preserved('word', 'm')} WHEN length(word) > 4 AND len(c) > 0 THEN substr(word, 1, c[1]) || substr(word, c[1] + 2) ELSE word END AS made FROM p""",
)
def pair_double_letter(spark, sf):
    return _every_word(spark, sf, corruption.double_letter_error)


@query(
    "contextual_then_than",
    f"""WITH {oracle.pieces()}, w AS (SELECT doc_id, pos, {words_sql('sentence')} AS w FROM sentences)
SELECT doc_id, pos, array_to_string([CASE WHEN lower(w[i + 1]) = 'then' AND i > 0 AND lower(w[i]) IN ('better', 'more', 'less', 'rather') AND {draw_sql('than', 'doc_id', 'pos', 'i')} < {int(0.4 * (1 << 32))} THEN {_preserved('w[i + 1]', "'than'")}
WHEN lower(w[i + 1]) = 'than' AND i > 0 AND lower(w[i]) NOT IN ('better', 'more', 'less', 'rather') AND {draw_sql('then', 'doc_id', 'pos', 'i')} < {int(0.3 * (1 << 32))} THEN {_preserved('w[i + 1]', "'then'")} ELSE w[i + 1] END for i in range(0, len(w))], ' ') AS made FROM w""",
)
def contextual_then_than(spark, sf):
    rows = sentences.split(docs(spark, sf))
    return rows.select("doc_id", "pos", F.array_join(corruption.contextual(text.words("sentence"), corruption.Draws("doc_id", "pos")), " ").alias("made"))


@query("corrupt_words")
def corrupt_words(spark, sf):
    return _every_word(spark, sf, lambda w, d: corruption.corrupt_word(w, d, 0.8))


@query("corrupt_sentences")
def corrupt_sentences(spark, sf):
    return pool(spark, sf).select("doc_id", "pos", corruption.corrupt_sentence("sentence", corruption.Draws("doc_id", "pos"), "medium").alias("corrupted"))


@query("generate_examples")
def generate_examples(spark, sf):
    """A target of 500 examples is the operator's own argument."""
    return corruption.generate(pool(spark, sf), 500).withColumn("error_types", F.array_join("error_types", ","))


@query("generate_legacy")
def generate_legacy(spark, sf):
    return corruption.early_generate(sentences.early_pool(docs(spark, sf)), 500)


@query("corrupt_legacy")
def corrupt_legacy(spark, sf):
    return sentences.early_pool(docs(spark, sf)).select("doc_id", "pos", corruption.early_corrupt("sentence", corruption.Draws("doc_id", "pos")).alias("corrupted"))


# ---- scoring ----


@query("error_types", f"WITH {oracle.scored_pairs()} SELECT doc_id, pos, array_to_string(error_types, ',') AS error_types, num_errors FROM scored")
def error_types(spark, sf):
    return examples(spark, sf).select("doc_id", "pos", F.array_join("error_types", ",").alias("error_types"), "num_errors")


@query("complexity_level", f"WITH {oracle.examples()} SELECT doc_id, pos, complexity FROM examples")
def complexity_level(spark, sf):
    return examples(spark, sf).select("doc_id", "pos", "complexity")


@query("difficulty_score", f"WITH {oracle.examples()} SELECT doc_id, pos, difficulty_score FROM examples")
def difficulty_score(spark, sf):
    return examples(spark, sf).select("doc_id", "pos", "difficulty_score")


@query(
    "char_change_ratio",
    f"WITH {oracle.scored_pairs()}, v AS (SELECT 'char_ratio' AS name, change_ratio AS x FROM scored UNION ALL SELECT 'word_ratio', word_ratio FROM scored) SELECT name, count(*) AS n, round(avg(x), 6) AS mean, round(median(x), 6) AS median, round(coalesce(stddev_samp(x), 0), 6) AS std FROM v GROUP BY name",
)
def char_change_ratio(spark, sf):
    return profiling.change_statistics(pairs(spark, sf))


_RUN = "list_reduce(list_prepend(0, [CASE WHEN cw[i] <> kw[i] THEN 1 ELSE 0 END for i in range(1, len(cw) + 1)]), lambda a, x: CASE WHEN x = 0 THEN (a // 1000) * 1000 ELSE greatest(a // 1000, a % 1000 + 1) * 1000 + a % 1000 + 1 END)"


@query("max_consecutive_errors", f"WITH {oracle.scored_pairs()} SELECT doc_id, pos, CASE WHEN len(cw) <> len(kw) THEN len(cw) ELSE {_RUN} // 1000 END AS run FROM scored")
def max_consecutive_errors(spark, sf):
    return pairs(spark, sf).select("doc_id", "pos", scoring.longest_run("clean", "corrupted").alias("run"))


_KINDS = oracle.pair_kind()


@query("corruption_pairs", f"WITH {oracle.scored_pairs()} SELECT a AS clean_word, b AS corrupted_word, count(*) AS n, {_KINDS} AS kind FROM chars_s WHERE same_n GROUP BY a, b, a_c, b_c")
def corruption_pairs(spark, sf):
    return profiling.corruption_pairs(pairs(spark, sf)).select("clean_word", "corrupted_word", "n", "kind")


@query("multilabel_count", f"WITH {oracle.scored_pairs()}, t AS (SELECT unnest(error_types) AS value FROM scored) SELECT value, count(*) AS n FROM t GROUP BY value")
def multilabel_count(spark, sf):
    return profiling.label_counts(examples(spark, sf), "error_types")


@query("error_bins", f"WITH {oracle.scored_pairs()} SELECT CASE WHEN num_errors = 1 THEN '1 error' WHEN num_errors = 2 THEN '2 errors' WHEN num_errors <= 4 THEN '3-4 errors' WHEN num_errors <= 6 THEN '5-6 errors' ELSE '6+ errors' END AS value, count(*) AS n FROM scored GROUP BY 1")
def error_bins(spark, sf):
    return profiling.histogram(examples(spark, sf), profiling.error_bin(F.col("num_errors")))


@query("error_histogram", f"WITH {oracle.scored_pairs()} SELECT num_errors AS value, count(*) AS n FROM scored GROUP BY 1")
def error_histogram(spark, sf):
    return profiling.histogram(examples(spark, sf), F.col("num_errors"))


@query("learning_signal", f"WITH {oracle.pairs()} SELECT source, count(*) AS n FROM pairs WHERE corrupted <> clean AND len({words_sql('clean')}) >= 6 GROUP BY source")
def learning_signal(spark, sf):
    return pairs(spark, sf).where((F.col("corrupted") != F.col("clean")) & (text.n_words("clean") >= 6)).groupBy("source").agg(F.count("*").alias("n"))


# ---- validation ----

_CONS = "bcdfghjklmnpqrstvwxz"


def _again(s: str, n: int) -> str:
    """Whether a character follows itself n times, without a backreference."""
    same = " AND ".join(f"substr({s}, i, 1) = substr({s}, i + {k}, 1)" for k in range(1, n + 1))
    return f"(len([i for i in range(1, length({s}) - {n} + 1) if {same} AND substr({s}, i, 1) <> chr(10)]) > 0)"


_BARE = r"regexp_replace(lower(x), '[^\p{L}\p{N}_]', '', 'g')"
_NONSENSE = rf"(len(list_filter(kw, lambda x: regexp_matches({_BARE}, '^[{_CONS}]{{4,}}$') OR regexp_matches({_BARE}, '^[aeiou]{{4,}}$') OR (length({_BARE}) >= 4 AND {_BARE} = repeat(substr({_BARE}, 1, 1), length({_BARE})::INT)) OR regexp_matches({_BARE}, '^[\p{{L}}\p{{N}}_]{{1,2}}$'))) / len(kw)::DOUBLE)"
# runs of one character of three and more, counted from left to right: places where a run of three begins and none ends just before
_REPEATS = "len([i for i in range(1, length(corrupted) - 1) if substr(corrupted, i, 1) = substr(corrupted, i + 1, 1) AND substr(corrupted, i, 1) = substr(corrupted, i + 2, 1) AND (i = 1 OR substr(corrupted, i - 1, 1) <> substr(corrupted, i, 1))])"
_READ = rf"greatest(0.0::DOUBLE, 1.0::DOUBLE - len(list_filter(kw, lambda x: regexp_matches(x, '^\p{{L}}{{1,2}}$'))) / len(kw)::DOUBLE * 0.3::DOUBLE - least(len(regexp_extract_all(lower(corrupted), '[{_CONS}]{{3,}}')) * 0.1::DOUBLE, 0.5::DOUBLE) - least({_REPEATS} * 0.1::DOUBLE, 0.3::DOUBLE))"


def _suspect(i: int, p: str) -> str:
    if "\\1" in p:
        return f"({_again('corrupted', 3)} OR {_again('clean', 3)})"
    return f"({text.has_sql('corrupted', p)} OR {text.has_sql('clean', p)})"


_CHECKS = [
    ("word_count < 4", "FAIL", "word_count", "'Too few words: ' || word_count"),
    ("word_count > 30", "WARNING", "word_count", "'Too many words: ' || word_count"),
    ("char_count < 20", "FAIL", "char_count", "'Too few characters: ' || char_count"),
    ("change_ratio < 0.05::DOUBLE", "FAIL", "insufficient_change", "'Too little changed'"),
    ("change_ratio > 0.5::DOUBLE", "FAIL", "excessive_change", "'Too much changed'"),
    ("word_ratio < 0.1::DOUBLE", "WARNING", "low_word_changes", "'Few words changed'"),
    *[(_suspect(i, p), "WARNING", "problematic_pattern", f"'Pattern {i}'") for i, p in enumerate(lexicons.SUSPECT)],
    (f"{_READ} < 0.3::DOUBLE", "WARNING", "low_readability", "'Hard to read'"),
    (f"CASE WHEN len(cw) <> len(kw) THEN len(cw) ELSE {_RUN} // 1000 END > 3", "WARNING", "consecutive_errors", f"'Errors in a row: ' || CASE WHEN len(cw) <> len(kw) THEN len(cw) ELSE {_RUN} // 1000 END"),
    (f"{_NONSENSE} > 0.3::DOUBLE", "FAIL", "meaningless", "'Without sense'"),
]
_ISSUES = f"{oracle.examples()},\nissues AS MATERIALIZED ({' UNION ALL '.join(f'''SELECT doc_id, pos, '{level}' AS level, '{cat}' AS category, {msg} AS message FROM scored WHERE {cond}''' for cond, level, cat, msg in _CHECKS)})"


@query("validate_issues", f"WITH {_ISSUES} SELECT * FROM issues")
def validate_issues(spark, sf):
    return validation.issues(pairs(spark, sf), "doc_id", "pos")


@query("validate_rollup", f"WITH {_ISSUES} SELECT level, category, count(*) AS n, count(DISTINCT (doc_id, pos)) AS n_rows FROM issues GROUP BY ALL")
def validate_rollup(spark, sf):
    found = validation.issues(pairs(spark, sf), "doc_id", "pos")
    return found.groupBy("level", "category").agg(F.count("*").alias("n"), F.count_distinct("doc_id", "pos").alias("n_rows"))


@query("validate_top_messages", f"WITH {_ISSUES} SELECT category || ': ' || message AS value, count(*) AS n FROM issues GROUP BY 1 ORDER BY n DESC, value LIMIT 10")
def validate_top_messages(spark, sf):
    found = validation.issues(pairs(spark, sf), "doc_id", "pos")
    return profiling.top(profiling.histogram(found, F.concat_ws(": ", "category", "message")), 10, "value")


_VERDICTS = f"WITH {_ISSUES}, v AS (SELECT doc_id, pos, CASE WHEN count(*) FILTER (level = 'FAIL') > 0 THEN 'FAIL' WHEN count(level) > 0 THEN 'WARNING' ELSE 'PASS' END AS verdict FROM scored LEFT JOIN issues USING (doc_id, pos) GROUP BY ALL)"


@query("validate_verdict", f"{_VERDICTS} SELECT * FROM v")
def validate_verdict(spark, sf):
    return pairs(spark, sf).select("doc_id", "pos", validation.verdict(validation.row_issues("clean", "corrupted")).alias("verdict"))


@query("validate_summary", f"{_VERDICTS} SELECT count(*) AS n_rows, count(*) FILTER (verdict = 'FAIL') AS failed, count(*) FILTER (verdict = 'WARNING') AS warned, count(*) FILTER (verdict = 'PASS') AS clean, round(1 - count(*) FILTER (verdict = 'FAIL') / greatest(count(*), 1)::DOUBLE, 6) AS quality_score FROM v")
def validate_summary(spark, sf):
    return validation.summary(pairs(spark, sf))


def _dataset_sql() -> str:
    parts = ["SELECT 'WARNING' AS level, 'source_diversity' AS category, 'source' AS subject, 'low' AS direction FROM examples HAVING count(DISTINCT source) < 3"]
    for c, (lo, hi) in lexicons.COMPLEXITY_RANGES.items():
        share = f"avg(CASE WHEN complexity = '{c}' THEN 1.0::DOUBLE ELSE 0 END)"
        parts += [f"SELECT 'WARNING', 'complexity_distribution', '{c}', 'low' FROM examples HAVING {share} < {lo}::DOUBLE", f"SELECT 'WARNING', 'complexity_distribution', '{c}', 'high' FROM examples HAVING {share} > {hi}::DOUBLE"]
    for t, lo in lexicons.ERROR_TYPE_LEAST.items():
        parts.append(f"SELECT 'WARNING', 'error_type_distribution', '{t}', 'low' FROM examples HAVING avg(CASE WHEN list_contains(error_types, '{t}') THEN 1.0::DOUBLE ELSE 0 END) < {lo}::DOUBLE")
    parts.append("SELECT 'WARNING', 'domain_imbalance', domain, CASE WHEN k > n * 0.6::DOUBLE THEN 'high' ELSE 'low' END FROM (SELECT domain, count(*) AS k, (SELECT count(*) FROM examples) AS n FROM examples GROUP BY domain) WHERE k > n * 0.6::DOUBLE OR (k < n * 0.05::DOUBLE AND n > 100)")
    return " UNION ALL ".join(f"({p})" for p in parts)


@query("dataset_distribution_issues", f"WITH {oracle.examples()} {_dataset_sql()}")
def dataset_distribution_issues(spark, sf):
    return validation.dataset_issues(examples(spark, sf))


@query(
    "recommendations",
    f"""WITH {_ISSUES}, d AS ({_dataset_sql()}), f AS (SELECT level, category FROM issues UNION ALL SELECT level, category FROM d),
c AS (SELECT count(*) AS n, count(*) FILTER (category = 'insufficient_change' AND level = 'FAIL') AS little, count(*) FILTER (category = 'excessive_change' AND level = 'FAIL') AS much, count(*) FILTER (category = 'consecutive_errors') AS runs, count(*) FILTER (category = 'low_readability') AS rd, count(*) FILTER (category = 'complexity_distribution') AS cx, count(*) FILTER (category = 'error_type_distribution') AS ty FROM f),
r AS (SELECT list_filter([CASE WHEN little > 0 THEN 'Corrupt more strongly, so that rows change' END, CASE WHEN much > 0 THEN 'Corrupt less, so that texts stay readable' END, CASE WHEN runs > 10 THEN 'Spread errors over the sentence' END, CASE WHEN rd > n * 0.1::DOUBLE THEN 'Choose errors that keep texts readable' END, CASE WHEN cx > 0 THEN 'Balance the levels of complexity' END, CASE WHEN ty > 0 THEN 'Make more of the rare error types' END], lambda x: x IS NOT NULL) AS l FROM c)
SELECT unnest(CASE WHEN len(l) > 0 THEN l ELSE ['No major issues'] END) AS recommendation FROM r""",
)
def recommendations(spark, sf):
    rows = examples(spark, sf)
    found = validation.issues(rows, "doc_id", "pos").select("level", "category").union(validation.dataset_issues(rows).select("level", "category"))
    return validation.recommendations(found)


@query(
    "profile_flags",
    rf"""WITH {oracle.scored_pairs()}, m AS (SELECT round(avg(CASE WHEN regexp_matches(lower(corrupted), '[{_CONS}]{{4,}}') OR {_again('corrupted', 3)} THEN 1.0::DOUBLE ELSE 0 END), 6) AS hard_to_read,
round(avg(CASE WHEN len(list_filter(kw, lambda x: length(regexp_replace(x, '[^\p{{L}}\p{{N}}_]', '', 'g')) <= 2 AND regexp_matches(x, '^\p{{L}}+$'))) > len(kw) * 0.4::DOUBLE THEN 1.0::DOUBLE ELSE 0 END), 6) AS without_sense, round(avg(num_errors), 6) AS mean_errors FROM scored)
SELECT *, array_to_string(list_filter([CASE WHEN hard_to_read > 0.05 THEN 'hard_to_read' END, CASE WHEN without_sense > 0.02 THEN 'without_sense' END, CASE WHEN mean_errors < 1.5 THEN 'few_errors' END, CASE WHEN mean_errors > 5 THEN 'many_errors' END], lambda x: x IS NOT NULL), ',') AS flags FROM m""",
)
def profile_flags(spark, sf):
    return validation.profile_flags(examples(spark, sf))


# ---- training records ----

_KEEP = r"(regexp_matches(clean, '(etc|Mr|Ms|Dr|Inc|Ltd)\.$') OR contains(clean, '?') OR contains(clean, '!') OR length(clean) - length(replace(clean, '.', '')) > 1)"


@query(
    "punctuation_balance",
    rf"""WITH {oracle.pairs()}, k AS (SELECT *, {_KEEP} AS keep FROM pairs), r AS (SELECT *, row_number() OVER (PARTITION BY keep ORDER BY {draw_sql('punctuation', 'doc_id', 'pos')}, doc_id, pos) - 1 AS i, count(*) OVER (PARTITION BY keep) AS n FROM k),
t AS (SELECT *, NOT keep AND i >= n // 2 AS take FROM r), s AS (SELECT doc_id, pos, take, CASE WHEN take THEN regexp_replace(clean, '\.+$', '') ELSE clean END AS clean, CASE WHEN take THEN regexp_replace(corrupted, '\.+$', '') ELSE corrupted END AS corrupted, source FROM t)
SELECT doc_id, pos, clean, corrupted, CASE WHEN take THEN source || '_no_punct' ELSE source END AS source, take AS punctuation_removed, len({words_sql('clean')}) AS word_count, length(clean) AS char_count FROM s""",
)
def punctuation_balance(spark, sf):
    rows = chat.balance_punctuation(pairs(spark, sf), "doc_id", "pos")
    return rows.select("doc_id", "pos", "clean", "corrupted", "source", "punctuation_removed", "word_count", "char_count")


@query("final_period_rate", f"WITH {oracle.pairs()} SELECT source, count(*) AS n, count(*) FILTER (right(clean, 1) = '.') AS with_period, round(100.0 * avg(CASE WHEN right(clean, 1) = '.' THEN 1.0::DOUBLE ELSE 0 END), 6) AS share FROM pairs GROUP BY source")
def final_period_rate(spark, sf):
    ends = F.endswith(F.col("clean"), F.lit("."))
    return pairs(spark, sf).groupBy("source").agg(F.count("*").alias("n"), F.count_if(ends).alias("with_period"), F.round(F.avg(ends.cast("double")) * 100, 6).alias("share"))


@query("ending_chars_pairs", f"WITH {oracle.pairs()}, e AS (SELECT 'clean' AS side, right(clean, 1) AS last FROM pairs UNION ALL SELECT 'corrupted', right(corrupted, 1) FROM pairs) SELECT side, last, count(*) AS n FROM e GROUP BY ALL")
def ending_chars_pairs(spark, sf):
    return profiling.last_characters(pairs(spark, sf), "clean", "corrupted")


@query("chat_format", f"WITH {oracle.examples()} SELECT doc_id, pos, 2 AS n_messages, 'Correct the typos in this text: ' || corrupted AS user_content, clean AS assistant_content, complexity, array_to_string(error_types, ',') AS error_types, difficulty_score FROM examples")
def chat_format(spark, sf):
    rows = chat.chat_format(examples(spark, sf), "doc_id", "pos")
    m = F.col("messages")
    return rows.select("doc_id", "pos", F.size(m).alias("n_messages"), m[0]["content"].alias("user_content"), m[1]["content"].alias("assistant_content"), "metadata.complexity", F.array_join("metadata.error_types", ",").alias("error_types"), "metadata.difficulty_score")


@query("chatml_text", f"WITH {oracle.pairs()} SELECT doc_id, pos, '<|im_start|>user' || chr(10) || 'Correct the typos in this text: ' || corrupted || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) || clean || '<|im_end|>' AS text FROM pairs")
def chatml_text(spark, sf):
    return chat.chatml_text(chat.chat_format(examples(spark, sf), "doc_id", "pos"), "doc_id", "pos")


@query("seq2seq_format", f"WITH {oracle.pairs()} SELECT doc_id, pos, 'fix typos: ' || corrupted AS source_text, clean AS target_text FROM pairs")
def seq2seq_format(spark, sf):
    return chat.seq2seq(pairs(spark, sf), "fix_typos", "doc_id", "pos")


_BYTES = lambda c, most: f"list_concat([('0x' || substr(hex(encode({c})), 2 * i - 1, 2))::INT + 3 for i in range(1, least(octet_length(encode({c})), {most - 1}) + 1)], [1])"


@query(
    "byte_tokens",
    f"WITH {oracle.pairs()}, t AS (SELECT doc_id, pos, {_BYTES(chr(39) + 'fix typos: ' + chr(39) + ' || corrupted', 64)} AS s, {_BYTES('clean', 64)} AS l FROM pairs) SELECT doc_id, pos, len(s) AS n_tokens, array_to_string(s, ' ') || repeat(' 0', 64 - len(s)::INT) AS input_ids, array_to_string(l, ' ') AS labels FROM t WHERE len(s) > 5 AND len(l) > 2",
)
def byte_tokens(spark, sf):
    rows = tokens.tokenise(chat.seq2seq(pairs(spark, sf), "fix_typos", "doc_id", "pos"), "doc_id", "pos", most=64)
    n = F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x)
    return rows.select("doc_id", "pos", n.alias("n_tokens"), F.array_join("input_ids", " ").alias("input_ids"), F.array_join("labels", " ").alias("labels"))


@query("token_length_filter", f"WITH {oracle.pairs()} SELECT count(*) AS n, sum(least(octet_length(encode(clean)) + 1, 128)) AS target_tokens FROM pairs WHERE octet_length(encode(clean)) + 1 > 2")
def token_length_filter(spark, sf):
    rows = tokens.tokenise(chat.seq2seq(pairs(spark, sf), "fix_typos", "doc_id", "pos"), "doc_id", "pos")
    return rows.agg(F.count("*").alias("n"), F.sum(F.size("labels")).alias("target_tokens"))


_STATS = ", ".join(f"'{name}': {sql}" for name, sql in (
    ("n", "count(*)"), ("mean", "round(avg(x), 6)"), ("median", "round(median(x), 6)"), ("std", "round(coalesce(stddev_samp(x), 0), 6)"), ("least", "min(x)"), ("most", "max(x)"),
    *[(f"p{int(q * 100)}", f"round(quantile_cont(x, {q}), 6)") for q in (0.25, 0.75, 0.9, 0.95)],
))
_REPORT = f"""WITH {oracle.examples()}, c AS (SELECT 'complexity' AS "column", coalesce(complexity, 'unknown') AS value, count(*) AS n FROM examples GROUP BY 2 UNION ALL SELECT 'domain', coalesce(domain, 'unknown'), count(*) FROM examples GROUP BY 2 UNION ALL SELECT 'source', coalesce(source, 'unknown'), count(*) FROM examples GROUP BY 2),
t AS (SELECT value, count(*) AS n FROM (SELECT unnest(error_types) AS value FROM examples) GROUP BY value), v AS (SELECT 'words' AS name, word_count::DOUBLE AS x FROM examples UNION ALL SELECT 'difficulty', difficulty_score FROM examples),
s AS (SELECT name, {{'name': name, {_STATS}}} AS r FROM v GROUP BY name)
SELECT CAST(to_json({{'counts': (SELECT list({{'column': "column", 'value': value, 'n': n}} ORDER BY "column", value, n) FROM c), 'types': (SELECT list({{'value': value, 'n': n}} ORDER BY value, n) FROM t), 'statistics': (SELECT list(r ORDER BY name) FROM s)}}) AS VARCHAR) AS value"""


@query("dataset_report", _REPORT)
def dataset_report(spark, sf):
    """One JSON document of the dataset's tables, as the report sinks write it."""
    rows = examples(spark, sf)
    return files.report(counts=profiling.counts(rows, "complexity", "domain", "source"), types=profiling.label_counts(rows, "error_types"), statistics=profiling.statistics(rows, words=F.col("word_count"), difficulty=F.col("difficulty_score")))


@query("distribution_lines", f"WITH {oracle.scored_pairs()}, t AS (SELECT unnest(error_types) AS value FROM scored), c AS (SELECT value, count(*) AS n FROM t GROUP BY value), s AS (SELECT *, sum(n) OVER () AS total FROM c) SELECT value || ': ' || n || ' (' || printf('%.1f', n * 100.0::DOUBLE / total) || '%)' AS line FROM s ORDER BY n DESC, value LIMIT 5")
def distribution_lines(spark, sf):
    found = profiling.label_counts(examples(spark, sf), "error_types")
    total = found.agg(F.sum("n").alias("total"))
    top = profiling.top(found.crossJoin(total), 5, "value")
    return top.select(F.format_string("%s: %d (%.1f%%)", "value", "n", F.col("n") * 100.0 / F.col("total")).alias("line"))


@query("example_counts", f"WITH {oracle.examples()} SELECT 'complexity' AS \"column\", complexity AS value, count(*) AS n FROM examples GROUP BY 2 UNION ALL SELECT 'domain', domain, count(*) FROM examples GROUP BY 2 UNION ALL SELECT 'source', source, count(*) FROM examples GROUP BY 2")
def example_counts(spark, sf):
    return profiling.counts(examples(spark, sf), "complexity", "domain", "source")


@query("half_split", f"WITH {oracle.pairs()}, r AS (SELECT doc_id, pos, row_number() OVER (ORDER BY {draw_sql('halves', 'doc_id', 'pos')}, doc_id, pos) - 1 AS i, count(*) OVER () AS n FROM pairs) SELECT doc_id, pos, i >= n // 2 AS second_half FROM r")
def half_split(spark, sf):
    return sampling.halves(pairs(spark, sf).select("doc_id", "pos"), "halves", "doc_id", "pos").select("doc_id", "pos", "second_half")
