"""Seeded corruptions of words and sentences, as Column expressions.

Every random choice is a draw keyed by the caller's key and a step name, so a
corruption depends on its row only. `Draws` binds the key; a word's draws add its
place in the sentence.
"""

from __future__ import annotations

from functools import reduce
from math import ceil, floor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from pairloom.functions import lexicons, text
from pairloom.functions.rng import SEED, chance, continued, digits, digits_after, draw, number, under
from pairloom.operators import sampling, scoring


class Draws:
    """Draws of one row (and word). head: what `rng.head` made of seed and key, where that is computed once for many draws."""

    def __init__(self, *key: Column | str, seed: int = SEED, head: Column | None = None):
        self.key, self.seed, self.head = key, seed, head

    def __call__(self, step: str) -> Column:
        return number(self.digits(step))

    def at(self, *more: Column | str) -> Draws:
        return Draws(*self.key, *more, seed=self.seed, head=None if self.head is None else continued(self.head, *more))

    def digits(self, step: str) -> Column:
        return digits(step, *self.key, seed=self.seed) if self.head is None else digits_after(self.head, step)

    def hit(self, step: str, p: float) -> Column:
        return under(self.digits(step), int(p * (1 << 32)))

    def below(self, step: str, n: Column | int) -> Column:
        """A whole number from 0 below n; 0 where n is 0."""
        return (self(step) % F.greatest(F.lit(n) if isinstance(n, int) else n.cast("bigint"), F.lit(1))).cast("int")


def _char(w: Column, pos: Column) -> Column:
    """The character at a place from 0."""
    return F.substring(w, pos + 1, F.lit(1))


def _put(w: Column, pos: Column, new: Column, over: Column | int) -> Column:
    """w with `over` characters from a place on replaced."""
    over = F.lit(over) if isinstance(over, int) else over
    return F.concat(F.substring(w, F.lit(1), pos), new, F.substring(w, pos + 1 + over, F.length(w)))


def _as(original: Column, c: Column) -> Column:
    return F.when(text.is_upper(original), text.upper_char(c)).otherwise(c)


def _neighbour(w: Column, d: Draws, table: dict[str, str], p: float, step: str, keep_case: bool = True) -> Column:
    """The character at a drawn place replaced by one the table lists for it."""

    def put(pos: Column, near: Column) -> Column:
        new = _char(near, d.below(f"{step}-pick", F.length(near)))
        return F.when(near.isNotNull(), _put(w, pos, _as(_char(w, pos), new) if keep_case else new, 1)).otherwise(w)

    def at(pos: Column) -> Column:
        return text.let(F.try_element_at(text.table(table), text.lower_char(_char(w, pos))), lambda near: put(pos, near))

    made = text.let(d.below(f"{step}-pos", F.length(w)), at)
    return made if p >= 1 else F.when(d.hit(f"{step}-hit", p), made).otherwise(w)  # without a hit no place is needed


def keyboard_error(w: Column, d: Draws) -> Column:
    return F.when(F.length(w) < 2, w).otherwise(_neighbour(w, d, lexicons.KEYBOARD, 0.4, "key"))


def character_error(w: Column, d: Draws) -> Column:
    """Insert, delete, transpose or substitute one character."""
    n = F.length(w)

    def inserted(at: Column) -> Column:
        vowel = _char(F.lit("aeiou"), d.below("ins-vowel", 5))
        return F.when(at > 0, _put(w, at, F.when(d.hit("ins-same", 0.7), _char(w, at - 1)).otherwise(vowel), 0)).otherwise(w)

    def by(op: Column) -> Column:
        deleted = text.let(d.below("del-pos", n - 2) + 1, lambda at: _put(w, at, F.lit(""), 1))
        swapped = text.let(d.below("swap-pos", n - 1), lambda at: _put(w, at, F.concat(_char(w, at + 1), _char(w, at)), 2))
        replaced = _neighbour(w, d, lexicons.SIMILAR, 1, "sub")
        return F.when(op == 0, text.let(d.below("ins-pos", n + 1), inserted)).when(op == 1, deleted).when(op == 2, swapped).otherwise(replaced)

    return F.when(n < 3, w).otherwise(text.let(d.below("op", 4), by))


def replace_first(w: Column, old: Column, new: Column) -> Column:
    """w with the first occurrence of old replaced; w where there is none."""
    return text.let(F.position(old, w), lambda at: F.when(at > 0, _put(w, at - 1, new, F.length(old))).otherwise(w))


def phonetic_error(w: Column, d: Draws) -> Column:
    """A known misspelling, else a homophone, else the first sound rule whose draw hits."""

    def one_of(options: Column, step: str) -> Column:
        return text.preserve_case(w, F.get(options, d.below(step, F.size(options))))

    def by(low: Column) -> Column:
        miss, homo = F.try_element_at(text.table(lexicons.MISSPELLINGS), low), F.try_element_at(text.table(lexicons.HOMOPHONES), low)
        out = F.when(miss.isNotNull() & d.hit("miss", 0.6), one_of(miss, "miss-pick")).when(homo.isNotNull() & d.hit("homo", 0.3), one_of(homo, "homo-pick"))
        for i, (old, new) in enumerate(lexicons.PHONETIC_RULES):
            out = out.when(F.contains(low, F.lit(old)) & d.hit(f"rule{i}", 0.2), text.preserve_case(w, replace_first(low, F.lit(old), F.lit(new))))
        return out.otherwise(w)

    return text.let(text.lower(w), by)


def contraction_error(w: Column, d: Draws) -> Column:
    options = F.try_element_at(text.table(lexicons.CONTRACTIONS), text.lower(w))
    return F.when(options.isNotNull() & d.hit("contraction", 0.5), text.preserve_case(w, F.get(options, d.below("contraction-pick", F.size(options))))).otherwise(w)


def compound_error(w: Column, d: Draws) -> Column:
    torn = F.try_element_at(text.table(lexicons.COMPOUNDS), text.lower(w))
    return F.when(torn.isNotNull() & d.hit("compound", 0.4), text.preserve_case(w, torn)).otherwise(w)


def double_letter_error(w: Column, d: Draws) -> Column:
    """A known word without its double letter; else, in longer words, the first pair whose draw hits loses one."""
    known = F.try_element_at(text.table(lexicons.DOUBLE_LETTERS), text.lower(w))

    def pairs(c: Column) -> Column:
        return F.filter(F.sequence(F.lit(0), F.greatest(F.length(w) - 2, F.lit(0))), lambda i: (F.get(c, i) == F.get(c, i + 1)) & d.at(i).hit("pair", 0.3))

    torn = text.let(F.get(text.let(F.split(text.lower(w), ""), pairs), 0), lambda first: F.when(first.isNotNull(), _put(w, first, F.lit(""), 1)).otherwise(w))
    return F.when(known.isNotNull() & d.hit("double", 0.4), text.preserve_case(w, known)).when(F.length(w) > 4, torn).otherwise(w)


def contextual(words: Column, d: Draws) -> Column:
    """then and than swapped after, or not after, a comparative."""
    comparative = F.array(*map(F.lit, lexicons.COMPARATIVES))

    def one(w: Column, i: Column) -> Column:
        after = F.array_contains(comparative, F.coalesce(text.lower(F.get(words, i - 1)), F.lit("")))
        to_than = (text.lower(w) == "then") & (i > 0) & after & chance(d.at(i)("than"), 0.4)
        to_then = (text.lower(w) == "than") & (i > 0) & ~after & chance(d.at(i)("then"), 0.3)
        return F.when(to_than, text.preserve_case(w, F.lit("than"))).when(to_then, text.preserve_case(w, F.lit("then"))).otherwise(w)

    return F.transform(words, one)


def corrupt_word(w: Column, d: Draws, intensity: Column | float = 0.15, kinds: dict[str, float] | None = None) -> Column:
    """With the given intensity, one error of a kind drawn by weight; spelling falls back to double letters."""
    kinds = kinds or lexicons.CHOICE
    total = sum(kinds.values())
    spelled = text.let(character_error(w, d), lambda x: F.when(x == w, double_letter_error(w, d)).otherwise(x))
    made = {"spelling": spelled, "phonetic": phonetic_error(w, d), "keyboard": keyboard_error(w, d), "punctuation": contraction_error(w, d), "spacing": compound_error(w, d), "grammar": w}

    def by(h: Column) -> Column:
        below, out = 0.0, None
        for kind, weight in kinds.items():
            below += weight / total
            out = (out.when if out is not None else F.when)(under(h, ceil(below * (1 << 32))), made[kind])
        return out.otherwise(w)

    if isinstance(intensity, float):
        over = ~under(d.digits("intensity"), floor(intensity * (1 << 32)) + 1)
    else:
        over = d("intensity").cast("double") / F.lit(float(1 << 32)) > intensity
    return F.when((F.length(w) <= 2) | over, w).otherwise(text.let(d.digits("kind"), by))


def n_errors_for(n_words: Column, level: str) -> Column:
    least, share = {"simple": (1, 8), "medium": (1, 5), "complex": (2, 3)}[level]
    return F.greatest(F.lit(least), F.floor(n_words / share).cast("int"))


def corrupt_sentence(s: Column | str, d: Draws, level: str = "medium", n_errors: Column | None = None) -> Column:
    """Context errors, then a corrupted word at each drawn place; a word left as it was gets a character error."""

    def over(own: Column) -> Column:
        n = F.size(own)
        k = F.least(n_errors if n_errors is not None else n_errors_for(n, level), n)

        def one(w: Column, i: Column, places: Column) -> Column:
            at = d.at(i)
            limit = F.when(F.length(w) > 4, F.lit(0.8)).otherwise(F.lit(0.6))
            changed = text.let(corrupt_word(w, at, limit), lambda x: F.when((x == w) & (F.length(w) > 3), character_error(w, at.at(F.lit("force")))).otherwise(x))
            return F.when(F.array_contains(places, i), changed).otherwise(w)

        return text.let(sampling.weighted_places(n, k, "place", *d.key), lambda places: F.array_join(F.transform(contextual(own, d), lambda w, i: one(w, i, places)), " "))

    return text.let(text.words(s), over)


# ---- generators: (sentence, draws) -> struct(corrupted, num_errors, error_types), null where one fails ----


def _made(corrupted: Column, n: Column, types: Column) -> Column:
    return F.struct(corrupted.alias("corrupted"), n.cast("int").alias("num_errors"), types.alias("error_types"))


def multi_error(s: Column, d: Draws) -> Column:
    n = text.n_words(s)
    most = F.least(F.lit(6), F.greatest(F.lit(2), F.floor(n / 3).cast("int")))

    def made(out: Column) -> Column:
        return text.let(scoring.word_changes(s, out), lambda errors: F.when((out != s) & (errors >= 2), _made(out, errors, scoring.error_types(s, out))))

    return F.when(n >= 6, text.let(corrupt_sentence(s, d, "complex", d.below("count", most - 1) + 2), made))


def _sampled(n: Column, k: Column, d: Draws, step: str) -> Column:
    """k distinct places of n in a random order: those with the least draws."""
    order = F.array_sort(F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.struct(d.at(i)(step).alias("h"), i.alias("i"))))
    return F.transform(F.slice(order, 1, F.greatest(k, F.lit(0))), lambda x: x["i"])


def contextual_phonetic(s: Column, d: Draws) -> Column:
    def over(own: Column) -> Column:
        n = F.size(own)
        places = _sampled(n, d.below("count", F.least(F.lit(3), F.floor(n / 3).cast("int"))) + 1, d, "pick")
        first = text.let(places, lambda p: F.transform(own, lambda w, i: F.when(F.array_contains(p, i), phonetic_error(w, d.at(i))).otherwise(w)))
        return F.when(n >= 4, text.let(first, lambda x: swept(own, x)))

    def swept(own: Column, first: Column) -> Column:
        second = F.when(d.hit("sweep", 0.3), F.transform(first, lambda w, i: contraction_error(w, d.at(i)))).otherwise(first)
        state = text.let(second, lambda x: F.struct(F.array_join(x, " ").alias("out"), F.size(scoring.differing(own, first)).alias("sounds"), F.size(scoring.differing(first, x)).alias("short")))

        def made(st: Column) -> Column:
            types = F.array_compact(F.array(F.lit("grammar"), F.when(st["sounds"] > 0, F.lit("phonetic")), F.when(st["short"] > 0, F.lit("punctuation"))))
            errors = st["sounds"] + st["short"]
            return F.when((errors > 0) & (st["out"] != s), _made(st["out"], errors, types))

        return text.let(state, made)

    return text.let(contextual(text.words(s), d), over)


def _rounds(on: Column, n: Column) -> Column:
    """1 to n, or nothing."""
    return F.when(on, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))


def _swap_word(words: Column, i: Column, new: Column) -> Column:
    return F.transform(words, lambda w, k: F.when(k == i, new).otherwise(w))


def typography(s: Column, d: Draws) -> Column:
    none = F.array().cast("array<string>")

    def edit(state: Column, w: Column, new: Column, kind: str) -> Column:
        def put(x: Column) -> Column:
            changed = F.struct(replace_first(state["t"], w, x).alias("t"), (state["n"] + 1).alias("n"), F.concat(state["kinds"], F.array(F.lit(kind))).alias("kinds"))
            return F.when(x != w, changed).otherwise(state)

        return text.let(new, put)

    def doubled(own: Column) -> Column:
        def step(st: Column, j: Column) -> Column:
            at = d.at(j)
            return text.let(F.get(own, at.below("double-word", F.size(own))), lambda w: edit(st, w, double_letter_error(w, at), "spelling"))

        start = F.struct(s.alias("t"), F.lit(0).alias("n"), none.alias("kinds"))
        state = F.aggregate(_rounds(d.hit("double-on", 0.6), d.below("double-count", 2) + 1), start, step)
        torn = _rounds(d.hit("torn-on", 0.4), F.size(own))
        return F.aggregate(torn, state, lambda st, i: text.let(F.get(own, i - 1), lambda w: edit(st, w, compound_error(w, d.at(i)), "spacing")))

    def more(st: Column, j: Column) -> Column:
        at = d.at(F.lit("more"), j)
        pick = F.struct(at.below("word", F.size(st["w"])).alias("i"), character_error(F.get(st["w"], at.below("word", F.size(st["w"]))), at).alias("x"))

        def put(p: Column) -> Column:
            changed = F.struct(_swap_word(st["w"], p["i"], p["x"]).alias("w"), (st["n"] + 1).alias("n"), F.concat(st["kinds"], F.array(F.lit("spelling"))).alias("kinds"))
            return F.when(p["x"] != F.get(st["w"], p["i"]), changed).otherwise(st)

        return text.let(pick, put)

    def finished(st: Column) -> Column:
        again = F.aggregate(_rounds(F.lit(True), d.below("more-count", 3) + 1), F.struct(text.words(st["t"]).alias("w"), st["n"].alias("n"), st["kinds"].alias("kinds")), more)
        spelled = text.let(again, lambda x: F.struct(F.array_join(x["w"], " ").alias("t"), x["n"].alias("n"), x["kinds"].alias("kinds")))
        return F.when(st["n"] < 2, spelled).otherwise(st)

    def made(st: Column) -> Column:
        return F.when((st["n"] > 0) & (st["t"] != s), _made(st["t"], st["n"], F.array_sort(F.array_distinct(st["kinds"]))))

    return F.when(text.n_words(s) >= 3, text.let(text.let(text.let(text.words(s), doubled), finished), made))


def keyboard_pattern(s: Column, d: Draws) -> Column:
    def over(own: Column) -> Column:
        n = F.size(own)
        places = _sampled(n, d.below("count", F.least(F.lit(3), F.greatest(F.lit(1), F.floor(n / 4).cast("int")))) + 1, d, "pick")
        first = text.let(places, lambda p: F.transform(own, lambda w, i: F.when(F.array_contains(p, i), keyboard_error(w, d.at(i))).otherwise(w)))
        start = text.let(first, lambda x: F.struct(x.alias("w"), F.size(scoring.differing(own, x)).alias("n")))
        end = F.aggregate(_rounds(d.hit("more", 0.4), d.below("more-count", 2) + 1), start, more)
        return F.when(n >= 3, text.let(text.let(end, lambda st: F.struct(F.array_join(st["w"], " ").alias("out"), st["n"].alias("n"))), made))

    def more(st: Column, j: Column) -> Column:
        at = d.at(F.lit("more"), j)
        pick = F.struct(at.below("word", F.size(st["w"])).alias("i"), character_error(F.get(st["w"], at.below("word", F.size(st["w"]))), at).alias("x"))
        return text.let(pick, lambda p: F.when(p["x"] != F.get(st["w"], p["i"]), F.struct(_swap_word(st["w"], p["i"], p["x"]).alias("w"), (st["n"] + 1).alias("n"))).otherwise(st))

    def made(st: Column) -> Column:
        return F.when((st["n"] > 0) & (st["out"] != s), _made(st["out"], st["n"], F.array(F.lit("keyboard"), F.lit("spelling"))))

    return text.let(text.words(s), over)


def simple_single(s: Column, d: Draws) -> Column:
    n = text.n_words(s)

    def made(out: Column) -> Column:
        return text.let(scoring.word_changes(s, out), lambda errors: F.when((out != s) & (errors > 0), _made(out, errors, F.array(F.lit("keyboard"), F.lit("spelling")))))

    return F.when(n >= 3, text.let(corrupt_sentence(s, d, "simple", d.below("count", F.least(F.lit(2), F.greatest(F.lit(1), F.floor(n / 6).cast("int")))) + 1), made))


# The least words of a sentence and the least errors of an example, by method.
LEAST = {"multi_error_sentences": (6, 2), "contextual_phonetic": (4, 1), "advanced_typography": (3, 1), "keyboard_patterns": (3, 1), "simple_single": (3, 1)}
#: The registry of generators; more can be added under a name with a share.
GENERATORS = {"multi_error_sentences": multi_error, "contextual_phonetic": contextual_phonetic, "advanced_typography": typography, "keyboard_patterns": keyboard_pattern, "simple_single": simple_single}


#: Attempts are broadcast to the pool up to so many.
MOST_BROADCAST = 200_000


def generate(pool: DataFrame, target: int, methods: dict[str, tuple[str, float]] | None = None, tries: int = 3) -> DataFrame:
    """Training examples from a pool (doc_id, pos, sentence, domain).

    Each method has a quota of int(target * share) and at most `tries` times as many
    attempts; an attempt draws one of the configured domains that the pool has, then one of its
    sentences. The first successes in the order of attempts fill the quota. The pool is
    numbered once and joined once, with the attempts of all methods; `shortfall` says
    where attempts ran out.
    """
    methods = methods or lexicons.METHODS
    # stored before it is numbered: numbering reads it twice, and its plan is long
    pool = sampling.stored(pool.select("doc_id", "pos", "domain", "sentence"))
    # one row for each configured domain
    sizes = {r.domain: r.n for r in pool.where(F.col("domain").isin(list(lexicons.DOMAINS))).groupBy("domain").agg(F.count("*").alias("n")).collect()}
    domains = sorted(sizes) or sorted(lexicons.DOMAINS)
    pool = sampling.shuffled(pool, ["domain"], "pool", "doc_id", "pos").select("domain", "index", "sentence")
    names, counts = F.array(*map(F.lit, domains)), F.array(*[F.lit(max(sizes.get(d, 0), 1)) for d in domains])
    quotas = {name: int(target * share) for name, (_, share) in methods.items()}

    def attempts(name: str) -> DataFrame:
        which = (draw(f"{name}-domain", "attempt") % len(domains)).cast("int")
        tried = pool.sparkSession.range(quotas[name] * tries).select(F.lit(name).alias("method"), F.col("id").alias("attempt"))
        return tried.withColumn("domain", F.get(names, which)).withColumn("index", draw(f"{name}-sentence", "attempt") % F.get(counts, which))

    tried = reduce(lambda a, b: a.union(b), map(attempts, methods))
    few = sum(quotas.values()) * tries <= MOST_BROADCAST
    rows = sampling.stored(pool.join(F.broadcast(tried) if few else tried, ["domain", "index"]))
    all_ = []
    for name, (source, _) in methods.items():
        # explode keeps the filter from computing the example again
        made = rows.where(F.col("method") == name).select("attempt", "domain", "sentence", F.explode(F.array(GENERATORS[name](F.col("sentence"), Draws(F.lit(name), "attempt")))).alias("m")).where("m is not null")
        all_.append(made.select(F.lit(name).alias("method"), "attempt", F.col("m.corrupted").alias("corrupted"), F.col("sentence").alias("clean"), "domain", F.col("m.error_types").alias("error_types"), F.col("m.num_errors").alias("num_errors"), F.lit(source).alias("source")))
    rows = reduce(lambda a, b: a.unionByName(b), all_)
    most = F.element_at(F.create_map(*[F.lit(x) for name, n in quotas.items() for x in (name, n)]), F.col("method"))
    if few:
        rows = rows.withColumn("rank", F.row_number().over(W.Window.partitionBy("method").orderBy("attempt")) - 1).where(F.col("rank") < most)
    else:
        cell = F.floor(F.col("attempt") * sampling.CELLS / F.greatest(most * tries, F.lit(1)))
        rows = sampling.numbered(sampling.stored(rows), ["method"], cell, ["attempt"], "rank").where(F.col("rank") < most)
    words = text.n_words("clean")
    level = F.when(F.col("source") == "simple_single", "simple").otherwise(scoring.complexity(words, F.col("num_errors"), F.col("error_types")))
    return rows.select(
        "method", "attempt", "corrupted", "clean", "domain", level.alias("complexity"), "error_types", "num_errors", words.alias("word_count"), F.length("clean").alias("char_count"),
        F.round(scoring.difficulty("clean", "corrupted", F.col("error_types"), F.col("num_errors")), 6).alias("difficulty_score"), "source",
    )


def shortfall(examples: DataFrame, target: int, methods: dict[str, tuple[str, float]] | None = None) -> DataFrame:
    """method, quota, made and missing of every method of generated examples."""
    quotas = [(name, int(target * share)) for name, (_, share) in (methods or lexicons.METHODS).items()]
    wanted = examples.sparkSession.createDataFrame(quotas, "method string, quota int")
    made = examples.groupBy("method").agg(F.count("*").alias("made"))
    rows = F.broadcast(wanted).join(made, "method", "left").select("method", "quota", F.coalesce("made", F.lit(0)).alias("made"))
    return rows.withColumn("missing", F.col("quota") - F.col("made"))


# ---- the earlier generator ----


def _early_word(w: Column, d: Draws) -> Column:
    """One of six word errors, drawn by weight; most leave the word as it is now and then."""
    n = F.length(w)
    middle = text.let(d.below("split-pos", n - 3) + 2, lambda at: _put(w, at, F.lit(" "), 0))
    split = F.when(d.hit("split-last", 0.7), _put(w, n - 1, F.lit(" "), 0)).when(d.hit("split-first", 0.5), _put(w, F.lit(1), F.lit(" "), 0)).otherwise(middle)
    split = F.when((n >= 4) & d.hit("split", 0.15), split).otherwise(w)
    key = F.when(n < 2, w).otherwise(_neighbour(w, d, lexicons.KEYBOARD_EARLY, 0.3, "early-key", keep_case=False))
    swapped = text.let(d.below("early-swap", n - 1), lambda at: _put(w, at, F.concat(_char(w, at + 1), _char(w, at)), 2))
    swapped = F.when((n >= 3) & d.hit("swap", 0.2), swapped).otherwise(w)
    dropped = F.when((n > 3) & d.hit("drop", 0.2), _put(w, d.below("drop-pos", n - 2) + 1, F.lit(""), 1)).otherwise(w)
    confused = text.let(F.try_element_at(text.table(lexicons.CONFUSIONS), text.lower(w)), lambda o: F.when(o.isNotNull() & d.hit("confuse", 0.25), text.whole_case(w, o)).otherwise(w))
    doubled = text.let(d.below("double-pos", n), lambda at: _put(w, at, F.concat(_char(w, at), _char(w, at)), 1))
    doubled = F.when((n >= 2) & d.hit("early-double", 0.15), doubled).otherwise(w)
    return text.let(d("choice").cast("double") / F.lit(float(1 << 32)), lambda x: F.when(x < 0.3, split).when(x < 0.45, key).when(x < 0.6, swapped).when(x < 0.75, dropped).when(x < 0.85, confused).otherwise(doubled))


def early_corrupt(s: Column | str, d: Draws, rate: float = 0.15) -> Column:
    """Word by word: a last character may move to the next word, which is then passed over, else a word error; rarely runs of small words are shuffled."""
    letters = "[a-zA-Z]"

    def over(own: Column) -> Column:
        start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(False).alias("skip"))

        def step(st: Column, i: Column) -> Column:
            w, after, at = F.get(own, i), F.get(own, i + 1), d.at(i)
            merge = w.rlike(letters) & F.coalesce(after.rlike(letters) & (F.length(after) >= 2), F.lit(False)) & (F.length(w) >= 3) & at.hit("merge", 0.12)
            moved = F.array(F.substring(w, F.lit(1), F.length(w) - 1), F.concat(_char(w, F.length(w) - 1), after))
            plain = F.array(F.when(w.rlike(letters) & at.hit("rate", rate), text.let(w, lambda x: _early_word(x, at))).otherwise(w))
            return F.when(st["skip"], F.struct(st["out"].alias("out"), F.lit(False).alias("skip"))).when(merge, F.struct(F.concat(st["out"], moved).alias("out"), F.lit(True).alias("skip"))).otherwise(F.struct(F.concat(st["out"], plain).alias("out"), F.lit(False).alias("skip")))

        return F.when(F.size(own) == 0, own).otherwise(F.aggregate(F.sequence(F.lit(0), F.greatest(F.size(own) - 1, F.lit(0))), start, step, lambda st: st["out"]))

    return text.let(text.let(text.words(s), over), lambda words: F.array_join(F.when(d.hit("scramble", 0.08), scramble_small(words, d)).otherwise(words), " "))


def scramble_small(words: Column, d: Draws) -> Column:
    """Runs of up to four words of two to four letters, begun one time in ten, in random order.

    The state carries the run's number; words of a run sort by a draw, others by their place.
    """

    def small(w: Column) -> Column:
        return F.length(w).between(2, 4) & w.rlike(r"^\p{L}+$")

    start = F.struct(F.array().cast("array<struct<run:int,h:bigint,w:string>>").alias("out"), F.lit(-1).alias("run"), F.lit(0).alias("size"))

    def step(st: Column, i: Column) -> Column:
        w = F.get(words, i)
        goes_on = (st["run"] >= 0) & (st["size"] < 4) & small(w)
        begins = ~goes_on & small(w) & d.at(i).hit("run", 0.1)
        run = F.when(goes_on, st["run"]).when(begins, i).otherwise(F.lit(-1))
        item = F.struct(F.when(run >= 0, run).otherwise(i).alias("run"), F.when(run >= 0, d.at(i)("order")).otherwise(F.lit(0)).cast("bigint").alias("h"), w.alias("w"))
        return F.struct(F.concat(st["out"], F.array(item)).alias("out"), run.alias("run"), F.when(goes_on, st["size"] + 1).otherwise(F.lit(1)).alias("size"))

    tagged = F.aggregate(F.sequence(F.lit(0), F.greatest(F.size(words) - 1, F.lit(0))), start, step, lambda st: st["out"])
    return F.when(F.size(words) == 0, words).otherwise(F.transform(F.array_sort(tagged), lambda x: x["w"]))


def early_generate(pool: DataFrame, target: int) -> DataFrame:
    """40 % simple, 40 % medium, 20 % complex sentences, one attempt each; unchanged rows are left out."""
    pool = sampling.shuffled(pool, ["complexity"], "early", "doc_id", "pos")
    sizes = pool.groupBy("complexity").agg(F.count("*").alias("n"))
    n = pool.sparkSession.range(target).withColumnRenamed("id", "attempt")
    part = F.col("attempt") / F.lit(max(target, 1))
    n = n.withColumn("complexity", F.when(part < 0.4, "simple").when(part < 0.8, "medium").otherwise("complex"))
    n = n.join(F.broadcast(sizes), "complexity").withColumn("index", draw("early-pick", "attempt") % F.col("n")).drop("n")
    rows = n.join(pool, ["complexity", "index"]).withColumn("corrupted", early_corrupt("sentence", Draws(F.lit("early"), "attempt"))).where(F.col("corrupted") != F.col("sentence"))
    return rows.select("attempt", "corrupted", F.col("sentence").alias("clean"), "complexity", text.n_words("sentence").alias("word_count"), F.length("sentence").alias("char_count"))


def edit_pairs(pool: DataFrame) -> DataFrame:
    """doc_id, pos, clean, corrupted, domain, source: one seeded edit (transpose, delete, double) of one word of four letters or more."""
    d = Draws("doc_id", "pos")

    def edit(x: Column, op: Column, p: Column) -> Column:
        return F.when(op == 0, _put(x, p, F.concat(_char(x, p + 1), _char(x, p)), 2)).when(op == 1, _put(x, p, F.lit(""), 1)).otherwise(_put(x, p, F.concat(_char(x, p), _char(x, p)), 1))

    def over(w: Column) -> Column:
        places = F.filter(F.sequence(F.lit(0), F.greatest(F.size(w) - 1, F.lit(0))), lambda i: F.length(F.get(w, i)) >= 4)

        def made(k: Column) -> Column:
            x = F.get(w, k)
            drawn = F.struct((d("pair-op") % 3).cast("int").alias("op"), ((d("pair-pos") % F.greatest(F.length(x) - 2, F.lit(1))).cast("int") + 1).alias("p"))

            def put(s: Column) -> Column:
                corrupted = text.let(edit(x, s["op"], s["p"]), lambda y: F.array_join(F.transform(w, lambda v, i: F.when(i == k, y).otherwise(v)), " "))
                return F.struct(F.array_join(w, " ").alias("clean"), corrupted.alias("corrupted"), F.concat(F.lit("edit_"), s["op"]).alias("source"))

            return F.when(k.isNotNull(), text.let(drawn, put))

        return text.let(text.let(places, lambda c: F.get(c, (d("pair-word") % F.greatest(F.size(c), F.lit(1))).cast("int"))), made)

    # explode keeps later filters from computing the edit again
    rows = pool.select("doc_id", "pos", "domain", F.explode(F.array(text.let(text.words("sentence"), over))).alias("e")).where("e is not null")
    return rows.select("doc_id", "pos", "e.clean", "e.corrupted", "domain", "e.source").where(F.col("clean") != F.col("corrupted"))


def examples(pairs: DataFrame, *key: str) -> DataFrame:
    """Pairs as training examples: types, counts, complexity and difficulty."""
    rows = pairs.withColumn("error_types", scoring.error_types("clean", "corrupted")).withColumn("num_errors", scoring.word_changes("clean", "corrupted"))
    rows = rows.withColumn("word_count", text.n_words("clean")).withColumn("char_count", F.length("clean"))
    rows = rows.withColumn("complexity", scoring.complexity(F.col("word_count"), F.col("num_errors"), F.col("error_types")))
    return rows.withColumn("difficulty_score", F.round(scoring.difficulty("clean", "corrupted", F.col("error_types"), F.col("num_errors")), 6))
