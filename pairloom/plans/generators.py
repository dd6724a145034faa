"""Composed corruptions and generators, and their oracles, built from those of the word errors.

An oracle of a word error reads a table of words f(doc_id, pos, nth, word) and draws by
(doc_id, pos, nth). The oracles here put one such reading for each step after the other.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from pairloom.functions import lexicons
from pairloom.functions.rng import SEED, draw_sql
from pairloom.functions.text import quoted, words_sql
from pairloom.operators import corruption
from pairloom.plans import curate, oracle, pairs
from pairloom.plans.curate import pool
from pairloom.plans.registry import ORACLES, query

_KEY = "CAST(doc_id AS VARCHAR), CAST(pos AS VARCHAR)"
_HALF = f"{float(1 << 32)}::DOUBLE"

def _draw(step: str, *key: str) -> str:
    """A draw whose step is an SQL expression."""
    return f"CAST('0x' || substr(md5(concat_ws('|', '{SEED}', {_KEY}, {''.join(f'CAST({k} AS VARCHAR), ' for k in key)}{step})), 1, 8) AS BIGINT)"


def word_sql(kind: str, table: str, *more: str) -> str:
    """doc_id, pos, nth, word, made: a word error over the words of a table, drawn by (doc_id, pos, nth) and further SQL expressions."""
    key = f"{_KEY}, CAST(nth AS VARCHAR)"
    sql = ORACLES[f"pair_{kind}"].replace(pairs._EVERY, f"WITH f AS (SELECT doc_id, pos, nth, word FROM {table})")
    return sql.replace(key, key + "".join(f", CAST({k} AS VARCHAR)" for k in more))


_ON = "USING (doc_id, pos, nth)"


def corrupt_word_sql(name: str, table: str, limit: str) -> str:
    """CTEs, the last of them `name`(doc_id, pos, nth, word, made): a word corrupted with the given intensity."""
    kinds = {"kb": "keyboard", "ch": "character", "ph": "phonetic", "co": "contraction", "cp": "compound", "dl": "double_letter"}
    parts = [f"{name}_{k} AS MATERIALIZED ({word_sql(kind, table)})" for k, kind in kinds.items()]
    made = {"spelling": "CASE WHEN ch.made = x.word THEN dl.made ELSE ch.made END", "phonetic": "ph.made", "keyboard": "kb.made", "punctuation": "co.made", "spacing": "cp.made", "grammar": "x.word"}
    below, cases, total = 0.0, [], sum(lexicons.CHOICE.values())
    for kind, weight in lexicons.CHOICE.items():
        below += weight / total
        cases.append(f"WHEN {_draw(quoted('kind'), 'nth')} / {_HALF} < {below!r}::DOUBLE THEN {made[kind]}")
    joins = " ".join(f"JOIN {name}_{k} {k} {_ON}" for k in kinds)
    skip = f"length(x.word) <= 2 OR {_draw(quoted('intensity'), 'nth')} / {_HALF} > {limit}"
    return ",\n".join([*parts, f"{name} AS MATERIALIZED (SELECT doc_id, pos, nth, x.word, CASE WHEN {skip} THEN x.word {' '.join(cases)} ELSE x.word END AS made FROM {table} x {joins})"])


_THEN = ORACLES["contextual_then_than"]
_CONTEXT = _THEN[_THEN.index("array_to_string(") + len("array_to_string(") : _THEN.rindex(", ' ') AS made FROM w")]


def contextual_sql(name: str, table: str) -> str:
    """CTEs: {name}_w(doc_id, pos, sentence, w, c), the words before and after context errors, and `name`(doc_id, pos, nth, word) of the latter."""
    return f"""{name}_a AS (SELECT doc_id, pos, sentence, {words_sql('sentence')} AS w FROM {table}),
{name}_w AS MATERIALIZED (SELECT doc_id, pos, sentence, w, {_CONTEXT} AS c FROM {name}_a),
{name} AS MATERIALIZED (SELECT doc_id, pos, generate_subscripts(c, 1) - 1 AS nth, unnest(c) AS word FROM {name}_w)"""


def corrupt_sentence_sql(name: str, table: str, k: str) -> str:
    """CTEs, the last of them `name`(doc_id, pos, sentence, w, corrupted): whole sentences corrupted at drawn places; k is their number in terms of w."""
    x = f"(CAST('0x' || substr(md5(concat_ws('|', '{SEED}', {_KEY}, 'place' || j)), 1, 8) AS BIGINT) / {_HALF})"
    all_ = "(len(w) - 2 + 0.6::DOUBLE)"
    place = f"CASE WHEN len(w) > 3 THEN CASE WHEN {x} * {all_} < 0.3::DOUBLE THEN 0 WHEN {x} * {all_} >= {all_} - 0.3::DOUBLE THEN len(w) - 1 ELSE least(floor({x} * {all_} - 0.3::DOUBLE)::BIGINT + 1, len(w) - 2) END ELSE floor({x} * len(w))::BIGINT END"
    return f"""{contextual_sql(f'{name}_f', table)},
{name}_p AS MATERIALIZED (SELECT *, [{place} for j in range(0, least({k}, len(w))::BIGINT)] AS places FROM {name}_f_w),
{corrupt_word_sql(f'{name}_x', f'{name}_f', 'CASE WHEN length(x.word) > 4 THEN 0.8::DOUBLE ELSE 0.6::DOUBLE END')},
{name}_force AS MATERIALIZED ({word_sql('character', f'{name}_f', "'force'")}),
{name}_j AS (SELECT doc_id, pos, string_agg(CASE WHEN NOT list_contains(places, x.nth) THEN x.word WHEN x.made = x.word AND length(x.word) > 3 THEN force.made ELSE x.made END, ' ' ORDER BY x.nth) AS corrupted
 FROM {name}_x x JOIN {name}_force force {_ON} JOIN {name}_p USING (doc_id, pos) GROUP BY doc_id, pos),
{name} AS MATERIALIZED (SELECT p.*, corrupted FROM {name}_p p JOIN {name}_j USING (doc_id, pos))"""


def _below(step: str, n: str) -> str:
    return f"({draw_sql(step, 'doc_id', 'pos')} % greatest({n}, 1))"


_POOL = oracle.pool()
ORACLES["corrupt_words"] = f"""WITH {oracle.pieces()}, w AS (SELECT doc_id, pos, {words_sql('sentence')} AS w FROM sentences),
f AS MATERIALIZED (SELECT doc_id, pos, generate_subscripts(w, 1) - 1 AS nth, unnest(w) AS word FROM w), {corrupt_word_sql('x', 'f', '0.8::DOUBLE')} SELECT doc_id, pos, nth, word, made FROM x"""
ORACLES["corrupt_sentences"] = f"WITH {_POOL}, {corrupt_sentence_sql('x', 'pool', 'greatest(1, len(w) // 5)')} SELECT doc_id, pos, corrupted FROM x"


# ---- generators: CTEs, the last of them `name`(doc_id, pos, clean, corrupted, num_errors, error_types) over table(doc_id, pos, sentence) ----


def _scored(name: str, table: str) -> str:
    """`name`: a table with clean and corrupted, with the types and numbers of errors found in them."""
    sql = oracle.scored_pairs(f"pairs AS MATERIALIZED (SELECT * FROM {table})")
    return f"{name} AS MATERIALIZED (WITH {sql} SELECT * FROM scored)"


def multi_error_sql(name: str, table: str) -> str:
    k = f"({_below('count', 'least(6, greatest(2, len(w) // 3)) - 1')} + 2)"
    return f"""{corrupt_sentence_sql(f'{name}_s', table, k)},
{name}_c AS (SELECT doc_id, pos, sentence AS clean, corrupted FROM {name}_s WHERE len(w) >= 6 AND corrupted <> sentence),
{_scored(f'{name}_e', f'{name}_c')},
{name} AS MATERIALIZED (SELECT doc_id, pos, clean, corrupted, num_errors, error_types FROM {name}_e WHERE num_errors >= 2)"""


def simple_single_sql(name: str, table: str) -> str:
    k = f"({_below('count', 'least(2, greatest(1, len(w) // 6))')} + 1)"
    return f"""{corrupt_sentence_sql(f'{name}_s', table, k)},
{name}_c AS (SELECT doc_id, pos, sentence AS clean, corrupted, len({oracle.differing('w', words_sql('corrupted'))}) AS num_errors FROM {name}_s WHERE len(w) >= 3 AND corrupted <> sentence),
{name} AS MATERIALIZED (SELECT *, ['keyboard', 'spelling'] AS error_types FROM {name}_c WHERE num_errors > 0)"""


def _sampled(n: str, k: str) -> str:
    """The first k places (from 0) of n in the order of their draws."""
    h = f"CAST('0x' || substr(md5(concat_ws('|', '{SEED}', {_KEY}, CAST(i AS VARCHAR), 'pick')), 1, 8) AS BIGINT)"
    return f"list_transform(list_sort([{{'h': {h}, 'i': i}} for i in range(0, {n})])[1:{k}], lambda z: z.i)"


def _lists(name: str, table: str, value: str) -> str:
    return f"{name} AS MATERIALIZED (SELECT doc_id, pos, list({value} ORDER BY nth) AS w FROM {table} GROUP BY doc_id, pos)"


def contextual_phonetic_sql(name: str, table: str) -> str:
    n = name
    return f"""{contextual_sql(f'{n}_f', table)},
{n}_p AS MATERIALIZED (SELECT *, {_sampled('len(c)', f"({_below('count', 'least(3, len(c) // 3)')} + 1)")} AS places FROM {n}_f_w WHERE len(c) >= 4),
{n}_ph AS MATERIALIZED ({word_sql('phonetic', f'{n}_f')}),
{n}_1 AS MATERIALIZED (SELECT doc_id, pos, nth, CASE WHEN list_contains(places, nth) THEN made ELSE word END AS word FROM {n}_ph JOIN {n}_p USING (doc_id, pos)),
{n}_co AS MATERIALIZED ({word_sql('contraction', f'{n}_1')}),
{_lists(f'{n}_l1', f'{n}_1', 'word')}, {_lists(f'{n}_l2', f'{n}_co', 'made')},
{n}_2 AS (SELECT p.doc_id, p.pos, sentence, c, a.w AS one, CASE WHEN {draw_sql('sweep', 'doc_id', 'pos')} < {int(0.3 * (1 << 32))} THEN b.w ELSE a.w END AS two FROM {n}_p p JOIN {n}_l1 a USING (doc_id, pos) JOIN {n}_l2 b USING (doc_id, pos)),
{n}_3 AS (SELECT doc_id, pos, sentence AS clean, array_to_string(two, ' ') AS corrupted, len({oracle.differing('c', 'one')}) AS sounds, len({oracle.differing('one', 'two')}) AS short FROM {n}_2),
{n} AS MATERIALIZED (SELECT doc_id, pos, clean, corrupted, sounds + short AS num_errors, list_filter(['grammar', CASE WHEN sounds > 0 THEN 'phonetic' END, CASE WHEN short > 0 THEN 'punctuation' END], lambda t: t IS NOT NULL) AS error_types FROM {n}_3 WHERE sounds + short > 0 AND corrupted <> clean)"""


def _round(name: str, table: str, j: int, on: str) -> str:
    """`name`: a table with the words w and a number n after round j of character errors, where `on` holds; drawn by ('more', j)."""
    at = f"({_draw(quoted('word'), quoted('more'), str(j))} % greatest(len(w), 1))"
    return f"""{name}_f AS MATERIALIZED (SELECT doc_id, pos, 'more' AS nth, w[{at} + 1] AS word FROM {table}),
{name}_m AS MATERIALIZED ({word_sql('character', f'{name}_f', str(j))}),
{name} AS MATERIALIZED (SELECT t.* REPLACE (CASE WHEN {on} AND made <> word THEN w[1:{at}] || [made] || w[{at} + 2:] ELSE w END AS w, CASE WHEN {on} AND made <> word THEN n + 1 ELSE n END AS n) FROM {table} t JOIN {name}_m USING (doc_id, pos))"""


def keyboard_pattern_sql(name: str, table: str) -> str:
    n = name
    rounds = lambda j: f"({draw_sql('more', 'doc_id', 'pos')} < {int(0.4 * (1 << 32))} AND {j} <= {_below('more-count', '2')} + 1)"
    return f"""{n}_a AS MATERIALIZED (SELECT doc_id, pos, sentence, {words_sql('sentence')} AS own FROM {table}),
{n}_p AS MATERIALIZED (SELECT *, {_sampled('len(own)', f"({_below('count', 'least(3, greatest(1, len(own) // 4))')} + 1)")} AS places FROM {n}_a WHERE len(own) >= 3),
{n}_f AS MATERIALIZED (SELECT doc_id, pos, generate_subscripts(own, 1) - 1 AS nth, unnest(own) AS word FROM {n}_a),
{n}_kb AS MATERIALIZED ({word_sql('keyboard', f'{n}_f')}),
{n}_1 AS MATERIALIZED (SELECT doc_id, pos, nth, CASE WHEN list_contains(places, nth) THEN made ELSE word END AS word FROM {n}_kb JOIN {n}_p USING (doc_id, pos)),
{_lists(f'{n}_l', f'{n}_1', 'word')},
{n}_0 AS MATERIALIZED (SELECT p.doc_id, p.pos, sentence, w, len({oracle.differing('own', 'w')}) AS n FROM {n}_p p JOIN {n}_l USING (doc_id, pos)),
{_round(f'{n}_r1', f'{n}_0', 1, rounds(1))},
{_round(f'{n}_r2', f'{n}_r1', 2, rounds(2))},
{n}_2 AS (SELECT doc_id, pos, sentence AS clean, array_to_string(w, ' ') AS corrupted, n AS num_errors, ['keyboard', 'spelling'] AS error_types FROM {n}_r2),
{n} AS MATERIALIZED (SELECT * FROM {n}_2 WHERE num_errors > 0 AND corrupted <> clean)"""


def typography_sql(name: str, table: str) -> str:
    """Two rounds of double letters, torn compounds from left to right, and, with less than two errors so far, up to three character errors."""
    n = name
    put = "CASE WHEN instr(t, a) > 0 THEN substr(t, 1, instr(t, a) - 1) || b || substr(t, instr(t, a) + length(a)) ELSE t END"

    def doubled(j: int, table: str) -> str:
        at = f"({_draw(quoted('double-word'), str(j))} % greatest(len(own), 1))"
        on = f"({draw_sql('double-on', 'doc_id', 'pos')} < {int(0.6 * (1 << 32))} AND {j} <= {_below('double-count', '2')} + 1)"
        return f"""{n}_d{j}_f AS MATERIALIZED (SELECT doc_id, pos, {j} AS nth, own[{at} + 1] AS word FROM {table}),
{n}_d{j}_m AS MATERIALIZED ({word_sql('double_letter', f'{n}_d{j}_f')}),
{n}_d{j}_x AS (SELECT t.*, word AS a, made AS b, {on} AND made <> word AS hit FROM {table} t JOIN {n}_d{j}_m USING (doc_id, pos)),
{n}_d{j} AS MATERIALIZED (SELECT doc_id, pos, sentence, own, CASE WHEN hit THEN {put} ELSE t END AS t, CASE WHEN hit THEN n + 1 ELSE n END AS n, CASE WHEN hit THEN kinds || ['spelling'] ELSE kinds END AS kinds FROM {n}_d{j}_x)"""

    step = "lambda x, y: [CASE WHEN instr(x[1], y[1]) > 0 THEN substr(x[1], 1, instr(x[1], y[1]) - 1) || y[2] || substr(x[1], instr(x[1], y[1]) + length(y[1])) ELSE x[1] END, '']"
    more = lambda j: f"(n0 < 2 AND {j} <= {_below('more-count', '3')} + 1)"
    return f"""{n}_0 AS MATERIALIZED (SELECT * FROM (SELECT doc_id, pos, sentence, {words_sql('sentence')} AS own, sentence AS t, 0::BIGINT AS n, []::VARCHAR[] AS kinds FROM {table}) WHERE len(own) >= 3),
{doubled(1, f'{n}_0')},
{doubled(2, f'{n}_d1')},
{n}_tf AS MATERIALIZED (SELECT doc_id, pos, nth, word FROM (SELECT doc_id, pos, generate_subscripts(own, 1) AS nth, unnest(own) AS word FROM {n}_0)),
{n}_tm AS MATERIALIZED ({word_sql('compound', f'{n}_tf')}),
{n}_tl AS MATERIALIZED (SELECT doc_id, pos, list([word, made] ORDER BY nth) AS torn FROM {n}_tm WHERE made <> word AND {draw_sql('torn-on', 'doc_id', 'pos')} < {int(0.4 * (1 << 32))} GROUP BY doc_id, pos),
{n}_t AS MATERIALIZED (SELECT d.doc_id, d.pos, sentence, CASE WHEN torn IS NULL THEN t ELSE list_reduce(list_prepend([t, ''], torn), {step})[1] END AS t, n + coalesce(len(torn), 0) AS n, CASE WHEN torn IS NULL THEN kinds ELSE kinds || ['spacing'] END AS kinds FROM {n}_d2 d LEFT JOIN {n}_tl USING (doc_id, pos)),
{n}_r0 AS MATERIALIZED (SELECT *, {words_sql('t')} AS w, n AS n0 FROM {n}_t),
{_round(f'{n}_r1', f'{n}_r0', 1, more(1))},
{_round(f'{n}_r2', f'{n}_r1', 2, more(2))},
{_round(f'{n}_r3', f'{n}_r2', 3, more(3))},
{n}_2 AS (SELECT doc_id, pos, sentence AS clean, CASE WHEN n0 < 2 THEN array_to_string(w, ' ') ELSE t END AS corrupted, n AS num_errors, list_sort(list_distinct(CASE WHEN n > n0 THEN kinds || ['spelling'] ELSE kinds END)) AS error_types FROM {n}_r3),
{n} AS MATERIALIZED (SELECT * FROM {n}_2 WHERE num_errors > 0 AND corrupted <> clean)"""


SQL = {"multi_error_sentences": multi_error_sql, "contextual_phonetic": contextual_phonetic_sql, "advanced_typography": typography_sql, "keyboard_patterns": keyboard_pattern_sql, "simple_single": simple_single_sql}


def _every_sentence(name: str):
    def run(spark, sf):
        rows = pool(spark, sf).select("doc_id", "pos", F.explode(F.array(corruption.GENERATORS[name](F.col("sentence"), corruption.Draws("doc_id", "pos")))).alias("m")).where("m is not null")
        return rows.select("doc_id", "pos", "m.corrupted", "m.num_errors", F.array_join("m.error_types", ",").alias("error_types"))

    return run


for _name, _sql in SQL.items():
    query(f"generator_{_name}", f"WITH {_POOL}, {_sql('g', 'pool')} SELECT doc_id, pos, corrupted, num_errors, array_to_string(error_types, ',') AS error_types FROM g")(_every_sentence(_name))


def _generated(target: int, tries: int = 3) -> str:
    """The oracle of `generate`: attempts of every method over the numbered pool, the first successes up to the quota."""
    known = ", ".join(map(quoted, sorted(lexicons.DOMAINS)))
    parts = [
        _POOL,
        f"numbered AS MATERIALIZED (SELECT sentence, domain, row_number() OVER (PARTITION BY domain ORDER BY {draw_sql('pool', 'doc_id', 'pos')}, doc_id, pos) - 1 AS index FROM pool)",
        f"sizes AS MATERIALIZED (SELECT list(domain ORDER BY domain) AS names, list(n ORDER BY domain) AS counts FROM (SELECT domain, count(*) AS n FROM pool WHERE domain IN ({known}) GROUP BY domain))",
    ]
    for i, (name, (source, share)) in enumerate(lexicons.METHODS.items()):
        n = int(target * share)
        which = f"({draw_sql(f'{name}-domain', 'attempt')} % len(names)) + 1"
        parts.append(f"a{i} AS (SELECT attempt, names[{which}] AS domain, {draw_sql(f'{name}-sentence', 'attempt')} % counts[{which}] AS index FROM range({n * tries}) r(attempt), sizes)")
        parts.append(f"s{i} AS MATERIALIZED (SELECT '{name}' AS doc_id, attempt AS pos, sentence, domain FROM a{i} JOIN numbered USING (domain, index))")
        parts.append(SQL[name](f"g{i}", f"s{i}"))
        parts.append(f"q{i} AS (SELECT g.*, domain, '{source}' AS source FROM g{i} g JOIN s{i} USING (doc_id, pos) QUALIFY row_number() OVER (ORDER BY pos) <= {n})")
    parts.append(f"made AS ({' UNION ALL '.join(f'SELECT doc_id, pos, clean, corrupted, num_errors, error_types, domain, source FROM q{i}' for i in range(len(lexicons.METHODS)))})")
    chars = f"len({oracle.differing(oracle.chars_sql('clean'), oracle.chars_sql('corrupted'))}) / greatest(length(clean), 1)::DOUBLE"
    parts.append(f"sized AS (SELECT *, len({words_sql('clean')}) AS word_count, length(clean) AS char_count, {chars} AS change_ratio FROM made)")
    return f"""WITH {', '.join(parts)} SELECT doc_id AS method, pos AS attempt, corrupted, clean, domain, CASE WHEN source = 'simple_single' THEN 'simple' ELSE {oracle.complexity()} END AS complexity, array_to_string(error_types, ',') AS error_types, num_errors, word_count, char_count, {oracle.difficulty()} AS difficulty_score, source FROM sized"""


ORACLES["generate_examples"] = _generated(500)


# ---- the earlier generator ----

_EARLY_KEYS = "MAP {" + ", ".join(f"{quoted(k)}: {quoted(v)}" for k, v in lexicons.KEYBOARD_EARLY.items()) + "}"
_CONFUSED = "MAP {" + ", ".join(f"{quoted(k)}: {quoted(v)}" for k, v in lexicons.CONFUSIONS.items()) + "}"


def _hit(step: str, p: float) -> str:
    return f"({_draw(quoted(step), 'nth')} < {int(p * (1 << 32))})"


def _place(step: str, n: str) -> str:
    return f"({_draw(quoted(step), 'nth')} % greatest({n}, 1))"


def early_corrupt_sql(name: str, table: str, rate: float = 0.15) -> str:
    """CTEs, the last of them `name`(doc_id, pos, sentence, corrupted): merges that pass over the next word, word errors, runs of small words in random order."""
    n = name
    letter = "regexp_matches({}, '[a-zA-Z]')"
    split = f"""CASE WHEN NOT (length(word) >= 4 AND {_hit('split', 0.15)}) THEN word WHEN {_hit('split-last', 0.7)} THEN substr(word, 1, length(word) - 1) || ' ' || substr(word, length(word))
 WHEN {_hit('split-first', 0.5)} THEN substr(word, 1, 1) || ' ' || substr(word, 2) ELSE substr(word, 1, {_place('split-pos', 'length(word) - 3')} + 2) || ' ' || substr(word, {_place('split-pos', 'length(word) - 3')} + 3) END"""
    near = f"{_EARLY_KEYS}[lower(substr(word, key_pos + 1, 1))]"
    key = f"CASE WHEN length(word) >= 2 AND {near} IS NOT NULL AND {_hit('early-key-hit', 0.3)} THEN substr(word, 1, key_pos) || substr({near}, {_place('early-key-pick', f'length({near})')} + 1, 1) || substr(word, key_pos + 2) ELSE word END"
    swap = f"CASE WHEN length(word) >= 3 AND {_hit('swap', 0.2)} THEN substr(word, 1, swap_pos) || substr(word, swap_pos + 2, 1) || substr(word, swap_pos + 1, 1) || substr(word, swap_pos + 3) ELSE word END"
    drop = f"CASE WHEN length(word) > 3 AND {_hit('drop', 0.2)} THEN substr(word, 1, drop_pos) || substr(word, drop_pos + 2) ELSE word END"
    other = f"{_CONFUSED}[lower(word)]"
    whole = rf"CASE WHEN upper(word) = word AND lower(word) <> word THEN upper({other}) WHEN regexp_matches(substr(word, 1, 1), '^\p{{Lu}}$') THEN upper(substr({other}, 1, 1)) || lower(substr({other}, 2)) ELSE {other} END"
    confuse = f"CASE WHEN {other} IS NOT NULL AND {_hit('confuse', 0.25)} THEN {whole} ELSE word END"
    double = f"CASE WHEN length(word) >= 2 AND {_hit('early-double', 0.15)} THEN substr(word, 1, double_pos + 1) || substr(word, double_pos + 1) ELSE word END"
    choice = f"({_draw(quoted('choice'), 'nth')} / {_HALF})"
    small = rf"length(word) BETWEEN 2 AND 4 AND regexp_matches(word, '^\p{{L}}+$')"
    return f"""{n}_w AS MATERIALIZED (SELECT doc_id, pos, sentence, {words_sql('sentence')} AS w FROM {table}),
{n}_f AS (SELECT doc_id, pos, generate_subscripts(w, 1) - 1 AS nth, unnest(w) AS word, unnest(w[2:] || [NULL]) AS after FROM {n}_w),
{n}_c AS MATERIALIZED (SELECT *, coalesce({letter.format('word')} AND {letter.format('after')} AND length(after) >= 2 AND length(word) >= 3 AND {_hit('merge', 0.12)}, false) AS can FROM {n}_f),
{n}_g AS (SELECT *, nth - row_number() OVER (PARTITION BY doc_id, pos, can ORDER BY nth) AS island FROM {n}_c),
{n}_m AS (SELECT *, can AND (row_number() OVER (PARTITION BY doc_id, pos, can, island ORDER BY nth)) % 2 = 1 AS merges FROM {n}_g),
{n}_s AS MATERIALIZED (SELECT *, coalesce(lag(merges) OVER (PARTITION BY doc_id, pos ORDER BY nth), false) AS skipped, {_place('early-key-pos', 'length(word)')} AS key_pos, {_place('early-swap', 'length(word) - 1')} AS swap_pos, {_place('drop-pos', 'length(word) - 2')} + 1 AS drop_pos, {_place('double-pos', 'length(word)')} AS double_pos FROM {n}_m),
{n}_e AS (SELECT doc_id, pos, nth, CASE WHEN merges THEN [substr(word, 1, length(word) - 1), substr(word, length(word), 1) || after] WHEN NOT ({letter.format('word')} AND {_hit('rate', rate)}) THEN [word]
 ELSE [CASE WHEN {choice} < 0.3::DOUBLE THEN {split} WHEN {choice} < 0.45::DOUBLE THEN {key} WHEN {choice} < 0.6::DOUBLE THEN {swap} WHEN {choice} < 0.75::DOUBLE THEN {drop} WHEN {choice} < 0.85::DOUBLE THEN {confuse} ELSE {double} END] END AS made FROM {n}_s WHERE NOT skipped),
{n}_o AS MATERIALIZED (SELECT doc_id, pos, flatten(list(made ORDER BY nth)) AS out_ FROM {n}_e GROUP BY doc_id, pos),
{n}_k AS MATERIALIZED (SELECT doc_id, pos, generate_subscripts(out_, 1) - 1 AS nth, unnest(out_) AS word FROM {n}_o WHERE {draw_sql('scramble', 'doc_id', 'pos')} < {int(0.08 * (1 << 32))}),
{n}_l AS MATERIALIZED (SELECT *, {small} AS small, {_hit('run', 0.1)} AS begins, {_draw(quoted('order'), 'nth')} AS h FROM {n}_k),
{n}_r AS (SELECT doc_id, pos, -1::BIGINT AS nth, -1::BIGINT AS run, 0 AS size, NULL::VARCHAR AS word, 0::BIGINT AS h FROM (SELECT DISTINCT doc_id, pos FROM {n}_l)
 UNION ALL SELECT l.doc_id, l.pos, l.nth, CASE WHEN r.run >= 0 AND r.size < 4 AND l.small THEN r.run WHEN l.small AND l.begins THEN l.nth ELSE -1 END, CASE WHEN r.run >= 0 AND r.size < 4 AND l.small THEN r.size + 1 ELSE 1 END, l.word, l.h FROM {n}_r r JOIN {n}_l l ON l.doc_id = r.doc_id AND l.pos = r.pos AND l.nth = r.nth + 1),
{n}_x AS (SELECT doc_id, pos, string_agg(word, ' ' ORDER BY CASE WHEN run >= 0 THEN run ELSE nth END, CASE WHEN run >= 0 THEN h ELSE 0 END, word) AS mixed FROM {n}_r WHERE nth >= 0 GROUP BY doc_id, pos),
{n} AS MATERIALIZED (SELECT w.doc_id, w.pos, sentence, coalesce(mixed, array_to_string(out_, ' '), '') AS corrupted FROM {n}_w w LEFT JOIN {n}_o USING (doc_id, pos) LEFT JOIN {n}_x USING (doc_id, pos))"""


ORACLES["corrupt_legacy"] = f"WITH RECURSIVE {curate._EARLY}, {early_corrupt_sql('x', 'early')} SELECT doc_id, pos, corrupted FROM x"
_LEGACY = 500
ORACLES["generate_legacy"] = f"""WITH RECURSIVE {curate._EARLY}, levels AS MATERIALIZED (SELECT *, {curate._LEVEL} AS complexity FROM early),
numbered AS MATERIALIZED (SELECT sentence, complexity, row_number() OVER (PARTITION BY complexity ORDER BY {draw_sql('early', 'doc_id', 'pos')}, doc_id, pos) - 1 AS index, count(*) OVER (PARTITION BY complexity) AS n FROM levels),
tried AS (SELECT attempt, CASE WHEN attempt / {_LEGACY}::DOUBLE < 0.4::DOUBLE THEN 'simple' WHEN attempt / {_LEGACY}::DOUBLE < 0.8::DOUBLE THEN 'medium' ELSE 'complex' END AS complexity FROM range({_LEGACY}) r(attempt)),
picked AS (SELECT attempt, complexity, {draw_sql('early-pick', 'attempt')} % n AS index FROM tried JOIN (SELECT DISTINCT complexity, n FROM numbered) USING (complexity)),
chosen AS MATERIALIZED (SELECT 'early' AS doc_id, attempt AS pos, sentence, complexity FROM picked JOIN numbered USING (complexity, index)),
{early_corrupt_sql('x', 'chosen')}
SELECT pos AS attempt, corrupted, sentence AS clean, complexity, len({words_sql('sentence')}) AS word_count, length(sentence) AS char_count FROM x JOIN chosen USING (doc_id, pos, sentence) WHERE corrupted <> sentence"""
