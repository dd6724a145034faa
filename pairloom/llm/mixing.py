"""Mixing sources to target weights: Pareto order sampling after whole copies.

Every source gets a target number of words: the weights share `budget` times
all words, a target stops at `most` times its source's words, and the excess is
reshared by weight until no target is above.

Within a source, documents have unequal expected copies: proportional to the
binary digits of their size (a copy of a long document brings more context), to
the power `tilt` (0: all alike), at most `most`, and scaled so that the expected words are the
target. The whole part of that number is certain and allocated at once; the
fraction is the inclusion probability p of one more copy. Those copies are drawn by
Pareto order sampling: each document draws U in (0, 1) from a seeded hash and is
ranked by Q = (U / (1 - U)) / (p / (1 - p)). The first ones, as many as fit, make up
the words that the whole copies leave open: the size of the sample is fixed, in words.
The gap that is left, smaller than the next document, is filled from the largest
size that fits down, documents of one size by rank; if the smallest document left
over is nearer to the rest of the gap than nothing, it closes it.

The order statistics are found without sorting a source in one task: sums over
1024 cells of the normalised rank find the cell in which the cut lies, and the cell
is cut again by 1024 until it holds few rows; only those are ordered. What is
joined back to the documents is a row for each source and class of sizes, and one
for each size that fills a gap.

Cases: a null text has size 0 and is never taken; null sources form one source,
ordered last; rows that are alike in all but position draw the same U and are taken
together or, where they don't fit whole, not at all; sources without words have
target 0; an empty table gives no rows; extra columns are kept by `mix` unless named
like one of its own, which it replaces, and by `mixed_docs` whatever they are named.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from pairloom.llm.shared import WORD, small, written

CELLS = 1024
#: A cell with more rows is cut again before its rows are ordered.
DENSE = 1 << 16
#: After so many cuts a cell is one step of a double.
LEVELS = 5
#: Expected copies this near to a whole number are whole.
NEAR = 1e-9
SEED = 20260101
OWN = ("size", "source_size", "target", "copies", "taken")


def n_words(text) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _filled(df: DataFrame, group: list[str], total: Column, cap: Column, weight: Column, order: list) -> DataFrame:
    """Adds level: what a unit of weight gets when `total` is shared by weight and no row above its cap.

    Water filling in one pass: in `order`, that of cap / weight, rows are capped up
    to the first whose cap is not below the level that remains.
    """
    by = W.Window.partitionBy(*group).orderBy(*order)
    w = df.withColumn("w_", weight).withColumn("cap_", cap)
    w = w.withColumn("capped_", F.coalesce(F.sum("cap_").over(by.rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0.0)))
    w = w.withColumn("rest_", F.sum("w_").over(by.rowsBetween(0, W.Window.unboundedFollowing))).withColumn("at_", F.row_number().over(by))
    w = w.withColumn("own_", (total - F.col("capped_")) / F.col("rest_"))
    first = F.min(F.when(F.col("cap_") / F.col("w_") >= F.col("own_"), F.struct("at_", "own_"))).over(W.Window.partitionBy(*group))
    return w.withColumn("level", F.coalesce(first["own_"], F.lit(float("inf")))).drop("w_", "cap_", "capped_", "rest_", "at_", "own_")


def source_targets(sizes: DataFrame, weights: tuple[float, ...], budget: float, most: float) -> DataFrame:
    """source, source_size, target from (source, source_size); one row for each source, so few rows."""
    one = sizes.groupBy("source").agg(F.sum("source_size").alias("source_size")).withColumn("all", F.lit(1))
    ranked = one.withColumn("r", F.row_number().over(W.Window.partitionBy("all").orderBy(F.col("source").asc_nulls_last())) - 1)
    ranked = ranked.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("r") % len(weights) + 1).cast("int")))
    total = F.sum("source_size").over(W.Window.partitionBy("all")) * F.lit(float(budget))
    cap = F.col("source_size") * F.lit(float(most))
    w = _filled(ranked.withColumn("total", total).withColumn("cap", cap), ["all"], F.col("total"), F.col("cap"), F.col("w"), [F.col("cap") / F.col("w"), F.col("r")])
    return w.select("source", "source_size", F.least(F.col("cap"), F.col("level") * F.col("w")).alias("target"))


def _digits(size: Column) -> Column:
    return F.length(F.bin(size)).cast("int")


def _classes(slim: DataFrame, targets: DataFrame, most: float, tilt: int, match) -> DataFrame:
    """source, digits, base (whole copies), p (of one more), even (a scale of ranks), open (words drawn in the source)."""
    sums = slim.where("size > 0").groupBy("source", _digits(F.col("size")).alias("digits")).agg(F.sum("size").alias("words"))
    sums = match(sums, targets.select("source", "target"), ["source"])
    gain = F.pow(F.col("digits").cast("double"), F.lit(float(tilt)))
    one = _filled(sums, ["source"], F.col("target"), F.col("words") * F.lit(float(most)), gain * F.col("words"), [F.col("digits").desc()])
    one = one.withColumn("e", F.least(F.lit(float(most)), F.col("level") * gain))
    one = one.withColumn("base", F.floor(F.col("e") + F.lit(NEAR)).cast("long"))
    one = one.withColumn("p", F.when(F.col("e") - F.col("base") > NEAR, F.col("e") - F.col("base")))
    whole = W.Window.partitionBy("source")
    one = one.withColumn("open", F.col("target") - F.sum(F.col("base") * F.col("words")).over(whole))
    drawn = F.sum(F.when(F.col("p").isNotNull(), F.col("words"))).over(whole)
    # the odds of a document of the source to be drawn, were they equal
    even = F.col("open") / F.greatest(drawn - F.col("open"), F.lit(1.0))
    return one.withColumn("even", F.greatest(even, F.lit(NEAR))).select("source", "digits", "base", "p", "even", "open")


def _drawn(df: DataFrame) -> DataFrame:
    """Adds key and u in (0, 1), a function of the row alone; MD5, so that other engines can check it."""
    parts = [F.lit(str(SEED)), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.coalesce("source", F.lit("null")), F.md5(F.coalesce("text", F.lit("")))]
    rows = df.withColumn("key", F.md5(F.concat_ws("|", *parts)))
    return rows.withColumn("u", (F.conv(F.substring("key", 1, 13), 16, 10).cast("bigint") + F.lit(0.5)) / F.lit(float(1 << 52)))


def _rank() -> Column:
    """The Pareto rank Q, scaled by a number of the source and brought into (0, 1) in its order, so that ranks spread over the cells; null where nothing is drawn."""
    q = (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p")))
    x = q * F.col("even")
    return F.when(F.col("p").isNotNull(), x / (1 + x))


def _cell(level: int) -> Column:
    return F.floor(F.col("v") * float(CELLS**level)).cast("long")


def _up_to(v: str, key: str) -> Column:
    """Whether a row's rank is at or before a cut; never null."""
    return F.coalesce((F.col("v") < F.col(v)) | ((F.col("v") == F.col(v)) & (F.col("key") <= F.col(key))), F.lit(False))


def _cuts(rows: DataFrame, limits: DataFrame, group: list[str], match, name: str) -> DataFrame:
    """group, limit, v_cut, key_cut, words: in each group the longest run of ranks whose sizes sum up to no more than its limit."""
    cut = limits.select(*group, "limit").withColumn("before", F.lit(0).cast("long"))
    inside = match(rows, limits.select(*group), group)
    for level in range(1, LEVELS + 1):
        sums = inside.groupBy(*group, _cell(level).alias("cell")).agg(F.sum("size").alias("words"), F.count("*").alias("n"))
        upto = W.Window.partitionBy(*group).orderBy("cell").rowsBetween(W.Window.unboundedPreceding, -1)
        sums = match(sums.withColumn("sum", F.coalesce(F.sum("words").over(upto), F.lit(0))), cut.select(*group, "limit", F.col("before").alias("earlier")), group)
        sums = sums.withColumn("before", F.col("sum") + F.col("earlier")).where(F.col("before") <= F.col("limit"))
        cut = written(sums.groupBy(*group).agg(F.max_by(F.struct("limit", "cell", "before", "n"), "cell").alias("x")).select(*group, "x.*"), f"mix-{name}")
        inside = match(inside, cut.select(*group, F.col("cell").alias("at")), group).where(_cell(level) == F.col("at")).drop("at")
        if (cut.agg(F.max("n")).first()[0] or 0) <= DENSE:
            break
    ties = match(inside.groupBy(*group, "v", "key").agg(F.sum("size").alias("words")), cut.select(*group, "limit", "before"), group)
    upto = W.Window.partitionBy(*group).orderBy("v", "key").rowsBetween(W.Window.unboundedPreceding, 0)
    ties = ties.withColumn("sum", F.sum("words").over(upto) + F.col("before")).where(F.col("sum") <= F.col("limit"))
    last = ties.groupBy(*group).agg(F.max(F.struct("v", "key", "sum")).alias("x"))
    # with none of the last cell, the cut is its lower end
    rows = _left(cut, last, group)
    low = F.col("cell") / F.lit(float(CELLS**level))
    out = rows.select(*group, "limit", F.coalesce("x.v", low).alias("v_cut"), F.coalesce("x.key", F.lit("")).alias("key_cut"), F.coalesce("x.sum", "before").alias("words"))
    return written(out, f"mix-{name}-cut")


def _on(group: list[str]) -> tuple[list[Column], list[str], dict[str, str]]:
    names = {g: f"{g}__" for g in group}
    return [F.col(g).eqNullSafe(F.col(names[g])) for g in group], list(names.values()), names


def _left(df: DataFrame, table: DataFrame, group: list[str]) -> DataFrame:
    on, drop, names = _on(group)
    return df.join(table.withColumnsRenamed(names), on, "left").drop(*drop)


def _fill(rest: DataFrame, gaps: DataFrame, match) -> DataFrame:
    """source, size, limit: how many words of which sizes fill the gaps of (source, gap), from the largest that fits down."""
    near = match(rest, gaps, ["source"]).where(F.col("size") < 2 * F.col("gap"))
    # one entry for each size that occurs under twice the gap, itself less than a document
    have = near.groupBy("source", "size").agg(F.count("*").alias("n"), F.max("gap").alias("gap"))
    have = have.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("size", "n")), asc=False).alias("have"), F.max("gap").alias("gap"))

    def step(st: Column, x: Column) -> Column:
        n = F.least(x["n"], F.floor(st["gap"] / x["size"]).cast("long"))
        pick = F.when(n > 0, F.concat(st["picks"], F.array(F.struct(x["size"].alias("size"), n.alias("n"))))).otherwise(st["picks"])
        return F.struct((st["gap"] - n * x["size"]).alias("gap"), F.when(n < x["n"], x["size"]).otherwise(st["next"]).alias("next"), pick.alias("picks"))

    none = F.array().cast("array<struct<size:bigint,n:bigint>>")
    st = F.aggregate("have", F.struct(F.col("gap").cast("double").alias("gap"), F.lit(None).cast("long").alias("next"), none.alias("picks")), step)
    done = have.select("source", st.alias("s"))
    closes = F.col("s.next") - F.col("s.gap") < F.col("s.gap")
    one = F.array(F.struct(F.col("s.next").alias("size"), F.lit(1).cast("long").alias("n")))
    picks = done.select("source", F.explode(F.when(closes, F.concat("s.picks", one)).otherwise(F.col("s.picks"))).alias("x"))
    return written(picks.groupBy("source", "x.size").agg(F.sum(F.col("x.size") * F.col("x.n")).cast("double").alias("limit")), "mix-fill")


class Mix:
    """The law of a mix: what each row gets, as a function of its source, size, key and u."""

    def __init__(self, slim: DataFrame, weights: tuple[float, ...] = (5, 2, 1), budget: float = 1.5, most: float = 2.0, tilt: int = 1):
        """slim: source, size, key, u of every document; read a few times."""
        self.targets = written(source_targets(slim.groupBy("source").agg(F.sum("size").alias("source_size")), weights, budget, most), "mix-targets")
        n = self.targets.count()

        def match(df: DataFrame, table: DataFrame, group: list[str], rows: int = n) -> DataFrame:
            """df with the columns of the one row of the table that is its group's; rows of other groups go."""
            on, drop, names = _on(group)
            return df.join(small(table.withColumnsRenamed(names), rows), on).drop(*drop)

        classes = written(_classes(slim, self.targets, most, tilt, match), "mix-classes")
        self.classes, self.n_classes = classes, classes.count()
        rows = match(slim.where("size > 0").withColumn("digits", _digits(F.col("size"))), classes, ["source", "digits"], self.n_classes)
        rows = rows.withColumn("v", _rank()).where("v is not null").select("source", "size", "key", "v")
        open_ = classes.where("p is not null").groupBy("source").agg(F.max("open").alias("limit"))
        self.cuts = _cuts(rows, open_, ["source"], match, "draw")
        gaps = self.cuts.select("source", (F.col("limit") - F.col("words")).alias("gap"), "v_cut", "key_cut").where("gap > 0")
        rest = match(rows, gaps.select("source", "v_cut", "key_cut"), ["source"]).where(~_up_to("v_cut", "key_cut")).drop("v_cut", "key_cut")
        picks = _fill(rest, gaps.select("source", "gap"), match)
        self.n_picks = picks.count()

        def of_size(df, table, group):
            return match(df, table, group, self.n_picks)

        self.picks = _cuts(rest, picks, ["source", "size"], of_size, "fill") if self.n_picks else picks.selectExpr("source", "size", "limit", "cast(null as double) v_cut", "cast(null as string) key_cut", "limit words")
        self.n = n

    def over(self, rows: DataFrame) -> DataFrame:
        """rows (source, size, key, u and others) with source_size, target, copies and taken."""
        law = _left(self.targets, self.cuts.select("source", "v_cut", "key_cut"), ["source"])
        on, drop, names = _on(["source"])
        out = rows.join(small(law.withColumnsRenamed(names), self.n), on).drop(*drop)  # every source has its row
        on, drop, names = _on(["source", "digits"])
        out = out.withColumn("digits", _digits(F.col("size"))).join(small(self.classes.drop("open").withColumnsRenamed(names), self.n_classes), on, "left").drop(*drop)
        on, drop, names = _on(["source", "size"])
        picks = self.picks.select("source", "size", F.col("v_cut").alias("v_fill"), F.col("key_cut").alias("key_fill"))
        out = out.join(small(picks.withColumnsRenamed(names), self.n_picks), on, "left").drop(*drop).withColumn("v", _rank())
        more = _up_to("v_cut", "key_cut") | _up_to("v_fill", "key_fill")
        out = out.withColumn("copies", F.when(F.col("size") > 0, F.col("base") + more.cast("long")).otherwise(F.lit(0).cast("long")))
        return out.withColumn("taken", F.col("copies") * F.col("size")).drop("digits", "base", "p", "even", "v", "v_cut", "key_cut", "v_fill", "key_fill")


def _slim(docs: DataFrame) -> DataFrame:
    rows = _drawn(docs.select("doc_id", "source", "text", n_words(F.col("text")).alias("size")))
    return written(rows.select("doc_id", "source", "size", "key", "u"), "mix")


def _mixed(docs: DataFrame, **law) -> DataFrame:
    """row (the columns of docs), size, source_size, target, copies and taken."""
    found = Mix(_slim(docs), **law)
    rows = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text", "source", n_words(F.col("text")).alias("size"))
    return found.over(_drawn(rows).drop("text"))


def mix(docs: DataFrame, **law) -> DataFrame:
    """docs with size, source_size, target, copies and taken; copies is how often the mix holds the row. Options as for Mix."""
    kept = [F.col("row")[c].alias(c) for c in docs.columns if c not in OWN]
    return _mixed(docs, **law).select(*kept, *OWN)


def mixed_query(docs: DataFrame) -> DataFrame:
    slim = _slim(docs)
    return Mix(slim).over(slim).select("doc_id", "size", "source_size", "target", "taken", "copies")


def mixed_docs(docs: DataFrame) -> DataFrame:
    """The mix itself: the columns of docs, each row as often as it is taken."""
    out = _mixed(docs).where(F.col("copies") > 0).select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return out.select("row.*")
