"""Building blocks of the DuckDB oracles: common table expressions and expressions."""

from __future__ import annotations

from pairloom.functions import lexicons
from pairloom.functions.rng import draw_sql
from pairloom.functions.text import NON_WORD, chars_sql, fingerprint_sql, has_sql, quoted, strip_sql, words_sql


def pieces(least: int = 30, most: int | None = None, also: str = "", name: str = "sentences") -> str:
    cut = f"[1:{most}]" if most else ""
    return rf"""
docs_{name} AS (SELECT doc_id, {strip_sql("text")} AS t FROM documents WHERE length({strip_sql("text")}) >= {least}),
arrays_{name} AS (SELECT doc_id, regexp_split_to_array(t, '[.!?]+\s+'){cut} AS a FROM docs_{name}),
pieces_{name} AS (SELECT doc_id, generate_subscripts(a, 1) - 1 AS pos, unnest(a) AS raw FROM arrays_{name}),
stripped_{name} AS (SELECT doc_id, pos, {strip_sql("raw")} AS p FROM pieces_{name}),
{name} AS (SELECT doc_id, pos, CASE WHEN regexp_matches(p, '[.!?{also}]$') THEN p ELSE p || '.' END AS sentence FROM stripped_{name} WHERE p <> '')"""


def high_quality(s: str) -> str:
    bare = rf"len(list_distinct(list_transform({words_sql(s)}, lambda x: regexp_replace(lower(x), '^[.,!?;:]+|[.,!?;:]+$', '', 'g'))))"
    parts = [f"length({s}) BETWEEN 20 AND 200", f"len({words_sql(s)}) BETWEEN 4 AND 30", rf"regexp_matches({s}, '[.!?]$')", f"len(list_distinct({chars_sql(f'lower({s})')})) >= length({s}) * 0.3::DOUBLE"]
    parts += [f"NOT {has_sql(s, p)}" for p in lexicons.BAD_SENTENCE]
    parts += [f"{bare} >= len({words_sql(s)}) * 0.7::DOUBLE", rf"length(regexp_replace({s}, '[^\p{{L}}]', '', 'g')) >= length({s}) * 0.6::DOUBLE"]
    return " AND ".join(f"({p})" for p in parts)


def good(s: str) -> str:
    parts = [
        f"length({s}) BETWEEN 10 AND 150", f"len({words_sql(s)}) BETWEEN 3 AND 25", f"regexp_matches({s}, '[a-zA-Z]')", rf"length(regexp_replace({s}, '[^\p{{L}}]', '', 'g')) >= length({s}) * 0.6::DOUBLE",
        rf"length(regexp_replace({s}, '[\p{{L}}\p{{N}}_\s''\-.,?!():]', '', 'g')) <= 3", rf"NOT regexp_matches({s}, '^[=#*\-•]')", f"NOT (upper({s}) = {s} AND lower({s}) <> {s} AND length({s}) > 10)",
        rf"NOT regexp_matches({s}, 'http|@|www\.|```|[{{}}]')", f"regexp_matches({s}, '[.!?;]$')", rf"regexp_matches(substr({s}, 1, 1), '^\p{{Lu}}$')",
    ]
    return " AND ".join(f"({p})" for p in parts)


def score(s: str, domain: str) -> str:
    c = lexicons.DOMAINS[domain]
    low = f"lower({s})"

    def add(points: int, when: str) -> str:
        return f"CASE WHEN {when} THEN {points} ELSE 0 END"

    parts = [add(10, f"len({words_sql(s)}) BETWEEN {c['words'][0]} AND {c['words'][1]}")]
    parts += [add(5, f"contains({low}, {quoted(k)})") for k in c["keywords"]]
    parts += [add(-20, has_sql(s, p)) for p in c["avoid"]]
    if domain in lexicons.BONUS_PHRASES:
        points, phrases = lexicons.BONUS_PHRASES[domain]
        parts.append(add(points, " OR ".join(f"contains({low}, {quoted(p)})" for p in phrases)))
    if domain in lexicons.BONUS_WORDS:
        parts.append(add(3, has_sql(low, rf"(^|{NON_WORD})({'|'.join(lexicons.BONUS_WORDS[domain])})({NON_WORD}|$)")))
    if domain in lexicons.BONUS_STARTS:
        parts.append(add(3, " OR ".join(f"starts_with({low}, {quoted(p)})" for p in lexicons.BONUS_STARTS[domain])))
    if domain == "conversational":
        parts.append(add(2, f"contains({s}, '''')"))
    if domain == "creative":
        parts.append(add(2, f"len(list_filter({words_sql(s)}, lambda x: length(x) > 6)) >= 2"))
    return f"greatest(0, {' + '.join(parts)})"


def classified(source: str, name: str) -> str:
    """CTEs that add domain to a table with a sentence column."""
    names = list(lexicons.DOMAINS)
    scores = ", ".join(f"{score('sentence', d)} AS s_{d}" for d in names)
    best = f"greatest({', '.join(f's_{d}' for d in names)})"
    case = " ".join(f"WHEN s_{d} = {best} THEN '{d}'" for d in names)
    return f"""
scored_{name} AS MATERIALIZED (SELECT *, {scores} FROM {source}),
{name} AS (SELECT * EXCLUDE ({', '.join(f's_{d}' for d in names)}), CASE WHEN {best} <= 5 THEN 'general' {case} END AS domain FROM scored_{name})"""


def pool() -> str:
    """CTE pool(doc_id, pos, sentence, domain)."""
    return f"""{pieces()},
good AS MATERIALIZED (SELECT *, {fingerprint_sql("sentence")} AS fp FROM sentences WHERE {high_quality("sentence")}),
firsts AS (SELECT doc_id, pos, sentence FROM good QUALIFY row_number() OVER (PARTITION BY fp ORDER BY doc_id, pos) = 1),
{classified("firsts", "pool")}"""


def pairs() -> str:
    """CTE pairs(doc_id, pos, clean, corrupted, domain, source): one seeded edit of one word of each pool sentence."""
    h = lambda step: draw_sql(step, "doc_id", "pos")
    return f"""{pool()},
words_p AS MATERIALIZED (SELECT *, {words_sql("sentence")} AS w, {h("pair-word")} AS h1, {h("pair-op")} AS h2, {h("pair-pos")} AS h3 FROM pool),
places_p AS (SELECT *, list_filter(range(1, len(w) + 1), lambda i: length(w[i]) >= 4) AS c FROM words_p),
chosen_p AS (SELECT *, c[(h1 % len(c)) + 1] AS k, h2 % 3 AS op FROM places_p WHERE len(c) > 0),
word_p AS (SELECT *, w[k] AS x, (h3 % (length(w[k]) - 2)) + 1 AS p FROM chosen_p),
edited_p AS (SELECT *, CASE op WHEN 0 THEN substr(x, 1, p) || substr(x, p + 2, 1) || substr(x, p + 1, 1) || substr(x, p + 3) WHEN 1 THEN substr(x, 1, p) || substr(x, p + 2) ELSE substr(x, 1, p + 1) || substr(x, p + 1) END AS y FROM word_p),
joined_p AS (SELECT doc_id, pos, array_to_string(w, ' ') AS clean, array_to_string(w[1:k - 1] || [y] || w[k + 1:], ' ') AS corrupted, domain, 'edit_' || op AS source FROM edited_p),
pairs AS MATERIALIZED (SELECT * FROM joined_p WHERE clean <> corrupted)"""


def differing(a: str, b: str) -> str:
    """The list of places (from 1) at which two lists differ."""
    return f"list_filter(range(1, least(len({a}), len({b})) + 1), lambda i: ({a})[i] <> ({b})[i])"


def keyboard_like(a: str, b: str, layout: dict[str, str]) -> str:
    """Over two words given as columns, whose lists of lower-case characters are {a}_c and {b}_c."""
    m = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in layout.items()) + "}"
    d = differing(f"{a}_c", f"{b}_c")
    return f"(length({a}) = length({b}) AND len({d}) = 1 AND coalesce(contains({m}[{a}_c[({d})[1]]], {b}_c[({d})[1]]), false))"


def phonetic_like(a: str, b: str, table: list[tuple[str, str]], both_ways: bool) -> str:
    found = []
    for x, y in table:
        found.append(f"(contains(lower({a}), '{x}') AND contains(lower({b}), '{y}'))")
        if both_ways:
            found.append(f"(contains(lower({a}), '{y}') AND contains(lower({b}), '{x}'))")
    return "(" + " OR ".join(found) + ")"


def pair_kind() -> str:
    """The kind of two unlike words a and b, with lists of lower-case characters a_c and b_c."""
    return f"""CASE WHEN {keyboard_like('a', 'b', lexicons.KEYBOARD_PROFILE)} THEN 'keyboard' WHEN {phonetic_like('a', 'b', lexicons.PHONETIC_PROFILE, False)} THEN 'phonetic' WHEN abs(length(a) - length(b)) <= 2 THEN 'character' ELSE 'other' END"""


def scored_pairs(source: str | None = None) -> str:
    """CTE scored(pairs.*, types VARCHAR (comma-joined, sorted), n_types, num_errors, word_count, change, ratio)."""
    grammar = ", ".join(f"('{a.replace(chr(39), chr(39) * 2)}', '{b.replace(chr(39), chr(39) * 2)}')" for a, b in lexicons.GRAMMAR_PAIRS)
    return f"""{source or pairs()},
split_s AS MATERIALIZED (SELECT *, {words_sql("clean")} AS cw, {words_sql("corrupted")} AS kw, {chars_sql("clean")} AS cc, {chars_sql("corrupted")} AS kc FROM pairs),
diffs_s AS MATERIALIZED (SELECT *, {differing("cw", "kw")} AS d, len({differing("cc", "kc")}) AS char_changes FROM split_s),
long_s AS (SELECT doc_id, pos, len(cw) = len(kw) AS same_n, generate_subscripts(d, 1) AS ord, cw[unnest(d)] AS a, kw[unnest(d)] AS b FROM diffs_s),
chars_s AS (SELECT *, {chars_sql("lower(a)")} AS a_c, {chars_sql("lower(b)")} AS b_c FROM long_s),
kinds_s AS (SELECT doc_id, pos, ord, {keyboard_like("a", "b", lexicons.KEYBOARD)} AS kb, {phonetic_like("a", "b", lexicons.PHONETIC_PAIRS, True)} AS ph, (contains(a, '''') OR contains(b, '''')) AS pu, (same_n AND (lower(a), lower(b)) IN ({grammar})) AS gr FROM chars_s),
sets_s AS (SELECT doc_id, pos, bool_or(gr) AS gr, bool_or(kb) AS kb, bool_or(ph) AS ph, bool_or(pu) AS pu, bool_or(ord = 1 AND NOT (kb OR ph OR pu)) AS sp FROM kinds_s GROUP BY ALL),
types_s AS (SELECT diffs_s.*, list_filter([CASE WHEN gr THEN 'grammar' END, CASE WHEN kb THEN 'keyboard' END, CASE WHEN ph THEN 'phonetic' END, CASE WHEN pu THEN 'punctuation' END, CASE WHEN coalesce(sp, true) THEN 'spelling' END], lambda x: x IS NOT NULL) AS error_types FROM diffs_s LEFT JOIN sets_s USING (doc_id, pos)),
scored AS MATERIALIZED (SELECT *, len(d) AS num_errors, len(cw) AS word_count, length(clean) AS char_count, char_changes / greatest(length(clean), 1)::DOUBLE AS change_ratio, len(d) / greatest(len(cw), 1)::DOUBLE AS word_ratio FROM types_s)"""


def complexity() -> str:
    return """CASE WHEN num_errors <= 2 AND word_count <= 10 AND len(list_filter(error_types, lambda t: t NOT IN ('keyboard', 'spelling', 'spacing'))) = 0 THEN 'simple'
WHEN num_errors >= 4 OR word_count >= 18 OR list_has_any(error_types, ['phonetic', 'grammar']) OR len(error_types) >= 3 THEN 'complex' ELSE 'medium' END"""


def difficulty() -> str:
    m = "MAP {" + ", ".join(f"'{k}': {v}::DOUBLE" for k, v in lexicons.DIFFICULTY.items()) + "}"
    kinds = f"coalesce(list_sum(list_transform(error_types, lambda t: {m}[t] * 15.0::DOUBLE)), 0)"
    n = "greatest(word_count, 1)::DOUBLE"
    return f"round(least(least(num_errors / {n}, 0.5::DOUBLE) * 40.0::DOUBLE + {kinds} + least({n} / 20.0::DOUBLE, 1.0::DOUBLE) * 10.0::DOUBLE + change_ratio * 20.0::DOUBLE, 100.0::DOUBLE), 6)"


def examples() -> str:
    """CTE examples: scored pairs with complexity and difficulty_score."""
    return f"{scored_pairs()},\nexamples AS MATERIALIZED (SELECT *, {complexity()} AS complexity, {difficulty()} AS difficulty_score FROM scored)"


def values(rows: list[tuple], columns: str, name: str) -> str:
    def one(x) -> str:
        return "NULL" if x is None else quoted(x) if isinstance(x, str) else f"{x}::DOUBLE" if isinstance(x, float) else str(x)

    return f"{name}({columns}) AS (VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)})"
