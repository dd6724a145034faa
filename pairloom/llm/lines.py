"""Line dedup: exact copies, and near copies by a segment-partition edit join.

Lines are compared lower-cased, trimmed and with single spaces. Lines are ordered by
their first occurrence (document id, nulls last, then position). A line is kept at its
first occurrence, unless an earlier distinct line is within `edits` edits of it; all
its other occurrences go. Blank lines stay.

The join: each distinct line is split into edits + 1 segments, which index it by its
length, segment number and segment. A line probes, for every length down to edits
less than its own, just the substrings that may match a segment there (multi-match
aware positions). Two lines within the threshold share a segment, so pairs meet at a
key. Candidates are verified by a banded bit-parallel automaton: bit d of word e says
that diagonal d of the band is reached with e edits; each character updates all
diagonals at once. Hashes of 128 bits and keys are made where a text is read; lines
travel with their text only if they are candidates.

A key with over `HOT` indexed lines would pair all of them up. For edits = 1 such keys
are split by the same rule: what the key leaves open of a line is halved, either half
is matched exactly and the other stays open, so that pairs meet again at a finer key,
until keys are small or one character is open; lines of a length that agree in all but
one place are near one another, and all but the earliest go. Each line adds as many
characters to each of these rounds as it has, so no group costs the square of its
lines. For more edits full keys are joined as they are.

Cases: null and empty texts have no lines; rows with equal id and text count as one
occurrence and get the same result; rows that share an id, or have none, are ordered by
a key of 128 bits; lines however long are compared whole; an empty table gives no rows;
extra columns are kept by `dedup` unless named like one of its own, which it replaces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.llm.shared import forget, let, row_key, small, written

EDITS = 1
#: Indexed lines at one key beyond which it is split further.
HOT = 64
OWN = ("n_lines", "n_removed", "n_near", "kept", "kept_sha256")
_DOC = ("nn", "id", "ka", "kb")


def _norm(line: Column) -> Column:
    # single spaces, by far the most, are no match
    return F.trim(F.regexp_replace(F.lower(line), r"\s{2,}|[\t\x0B\f\r]", " "))


def _lines() -> Column:
    return F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1)


def _doc() -> Column:
    """What orders documents by id, nulls last, and tells rows apart whose ids are equal."""
    key = row_key()
    return F.struct(F.col("doc_id").isNull().alias("nn"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), key["a"].alias("ka"), key["b"].alias("kb"))


def _keyed(rows: DataFrame, edits: int) -> DataFrame:
    """a, b (a line's hash), first (where it stands, then n, index and probe keys) of rows (d, pos, norm)."""
    where = [F.col("d")[c].alias(c) for c in _DOC]
    n = F.length("norm")
    rows = rows.select("d", "pos", "norm", n.alias("n"))
    first = F.struct(*where, "pos", "n", index_keys(edits).alias("index"), probe_keys(edits).alias("probe"))
    return rows.select(F.xxhash64("norm", F.lit("line")).alias("a"), F.xxhash64(F.lit("second"), "norm").alias("b"), first.alias("first"))


def distinct_lines(docs: DataFrame, edits: int = EDITS) -> DataFrame:
    """a, b, first (the least) of every distinct line that is not blank."""
    rows = docs.select(_doc().alias("d"), _lines().alias("all")).select("d", F.posexplode("all").alias("pos", "line")).select("d", "pos", _norm(F.col("line")).alias("norm"))
    return _keyed(rows, edits).groupBy("a", "b").agg(F.min("first").alias("first")).where("first.n > 0")


def line_texts(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """a, b, first, norm of the given ones of docs' distinct lines, read again where they stand; written."""
    by_doc = lines.groupBy(*[F.col("first")[c].alias(f"{c}_") for c in _DOC]).agg(F.collect_list(F.struct("a", "b", "first")).alias("own"))  # as many as a document has lines
    by_doc = written(by_doc, "lines-wanted")
    rows = docs.select(_doc().alias("d"), "text").join(small(by_doc, by_doc.count()), [F.col("d")[c] == F.col(f"{c}_") for c in _DOC])
    rows = rows.select(_lines().alias("all"), F.explode("own").alias("x")).select("x.*", _norm(F.get("all", F.col("x.first.pos"))).alias("norm"))
    out = written(rows.dropDuplicates(["a", "b"]), "lines-texts")  # rows that repeat hold the same line
    forget(by_doc)
    return out


def _part(n: Column, i: int, parts: int) -> tuple[Column, Column]:
    """Start (from 0) and length of segment i (from 0) of a line of n characters; the last n % parts are one longer."""
    base, extra = F.floor(n / parts).cast("int"), (n % parts).cast("int")
    longer = F.greatest(F.lit(0), F.lit(i) - (F.lit(parts) - extra))
    return base * i + longer, base + (F.lit(i) >= F.lit(parts) - extra).cast("int")


def _key(n: Column, i: int, piece: Column) -> Column:
    return F.xxhash64(n.cast("int"), F.lit(i), piece)


def index_keys(edits: int) -> Column:
    out = []
    for i in range(edits + 1):
        at, size = _part(F.col("n"), i, edits + 1)
        out.append(_key(F.col("n"), i, F.substring(F.col("norm"), at + 1, size)))
    return F.array(*out)


def probe_keys(edits: int) -> Column:
    """For each shorter or equal length and segment, the keys of the substrings that may match it."""
    out = []
    for less in range(edits + 1):
        n = F.col("n") - less
        for i in range(edits + 1):
            at, size = _part(n, i, edits + 1)
            low, high = max(-i, less - (edits - i)), min(i, less + (edits - i))
            for move in range(low, high + 1):
                fits = (n > 0) & (at + move >= 0) & (at + move + size <= F.col("n"))
                out.append(F.when(fits, _key(n, i, F.substring(F.col("norm"), at + move + 1, size))))
    return F.array_distinct(F.array_compact(F.array(*out)))


def within(x: Column | str, y: Column | str, edits: int) -> Column:
    """Whether two texts are within the edits: a banded bit-parallel automaton over the characters of x.

    Where the first halves are equal it starts after them: the path without an error
    reaches that place, and every other one is no better. A state without a live
    diagonal stays as it is.
    """
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    half = F.floor(F.least(F.length(x), F.length(y)) / 2).cast("int")
    skip = F.when(F.substring(x, F.lit(1), half) == F.substring(y, F.lit(1), half), half).otherwise(F.lit(0))

    def over(s: Column) -> Column:
        rest = F.struct(F.split(F.substring(x, s + 1, F.length(x)), "").alias("a"), F.split(F.substring(y, s + 1, F.length(y)), "").alias("b"))
        return let(rest, lambda r: _within(r["a"], r["b"], edits))

    return (F.abs(F.length(x) - F.length(y)) <= edits) & let(skip, over)


def _within(a: Column, b: Column, edits: int) -> Column:
    band = 2 * edits + 1
    mask = (1 << band) - 1
    start = [((1 << (edits + e + 1)) - 1) >> edits << edits & mask for e in range(edits + 1)]  # up to e insertions first

    def step(state: Column, i: Column) -> Column:
        own = F.get(a, i)
        match = F.lit(0)
        for d in range(band):
            match = match + F.when(own == F.get(b, i + (d - edits)), F.lit(1 << d)).otherwise(F.lit(0))
        alive = state[f"r{edits}"] != 0  # a word of more errors holds those of fewer
        return F.when(alive, let(match, lambda m: F.struct(*_advance(state, m, edits, mask)))).otherwise(state)

    last = F.aggregate(F.sequence(F.lit(0), F.size(a) - 1), F.struct(*[F.lit(s).alias(f"r{e}") for e, s in enumerate(start)]), step)
    reach = F.size(b) - F.size(a) + edits
    bit = F.element_at(F.array(*[F.lit(1 << d) for d in range(band)]), F.greatest(F.least(reach, F.lit(band - 1)), F.lit(0)) + 1)
    return (reach >= 0) & (reach < band) & (last[f"r{edits}"].bitwiseAND(bit) != 0)


def _advance(state: Column, match: Column, edits: int, mask: int) -> list[Column]:
    """The words after one more character of a: a match stays on its diagonal, a substitution too, a deletion moves one down, an insertion one up."""
    out: list[Column] = []
    for e in range(edits + 1):
        r = state[f"r{e}"].bitwiseAND(match)
        if e:
            less = state[f"r{e - 1}"]
            r = r.bitwiseOR(less).bitwiseOR(F.shiftright(less, 1)).bitwiseOR(F.shiftleft(out[e - 1], 1).bitwiseAND(F.lit(mask)))
        out.append(r)
    return [r.alias(f"r{e}") for e, r in enumerate(out)]


def _later(x: str, y: str) -> Column:
    """Of two lines, given as columns with a, b and first, the hash of the one that stands later."""
    return F.when(F.col(x)["first"] < F.col(y)["first"], F.struct(F.col(y)["a"], F.col(y)["b"])).otherwise(F.struct(F.col(x)["a"], F.col(x)["b"]))


def _hot(keys: DataFrame) -> tuple[DataFrame, int]:
    """The keys k that index over HOT lines, and how many they are."""
    hot = written(keys.groupBy("k").agg(F.count("*").alias("c")).where(F.col("c") > HOT).select("k"), "lines-hot")
    return hot, hot.count()


def _halves(rest: Column, probes: Column) -> Column:
    """(side, piece, rest) for either half of what is open of a line; a probing line has one character more open than an indexed one."""
    m = F.length(rest) - probes
    left, right = F.greatest(F.lit(1), F.floor(m / 2).cast("int")), m - F.floor(m / 2).cast("int")
    size = F.length(rest)
    one = F.struct(F.lit("L").alias("side"), F.substring(rest, F.lit(1), left).alias("piece"), F.substring(rest, left + 1, size).alias("rest"))
    two = F.struct(F.lit("R").alias("side"), F.substring(rest, size - right + 1, right).alias("piece"), F.substring(rest, F.lit(1), size - right).alias("rest"))
    return F.when(m > 0, F.array(one, two)).otherwise(F.array().cast("array<struct<side:string,piece:string,rest:string>>"))


def _at_hot(docs: DataFrame, lines: DataFrame, hot: DataFrame, n_hot: int) -> DataFrame:
    """k, probes (0: indexed, 1: probing), line (a, b, first), rest (what the key leaves open) of the lines at hot keys, for one edit."""
    keys = lines.select("a", "b", "first", F.explode(F.concat("first.index", "first.probe")).alias("k"))
    mine = keys.join(small(hot, n_hot), "k", "left_semi").select("a", "b", "first").dropDuplicates(["a", "b"])
    texts = line_texts(docs, mine)
    n, norm = F.length("norm"), F.col("norm")

    def rows(probes: int) -> Column:
        out = []
        for i in (0, 1):
            at, size = _part(n - probes, i, 2)
            move = probes * i  # the first segment is matched where it begins, the last where it ends
            piece = F.substring(norm, at + move + 1, size)
            rest = F.substring(norm, size + 1, n) if i == 0 else F.substring(norm, F.lit(1), at + probes)
            out.append(F.when(n > probes, F.struct(_key(n - probes, i, piece).alias("k"), F.lit(probes).alias("probes"), rest.alias("rest"))))
        return F.array_compact(F.array(*out))

    each = texts.select(F.struct("a", "b", "first").alias("line"), F.explode(F.concat(rows(0), rows(1))).alias("x")).select("x.k", "x.probes", "line", "x.rest")
    return each.join(small(hot, n_hot), "k", "left_semi")


def _split_hot(docs: DataFrame, lines: DataFrame, hot: DataFrame, n_hot: int) -> DataFrame:
    """(a, b): the lines that an earlier line at one of the hot keys is within one edit of."""
    rows = written(_at_hot(docs, lines, hot, n_hot), "lines-open")
    found = []
    while n_hot:
        # one place open: lines of one length are near one another there
        ends = rows.where("probes = 0 and length(rest) = 1").groupBy("k").agg(F.min("line.first").alias("least"))
        found.append(written(rows.where("probes = 0 and length(rest) = 1").join(ends, "k").where("line.first > least").select("line.a", "line.b").distinct(), "lines-one-place"))
        finer = rows.select("k", "probes", "line", F.explode(_halves(F.col("rest"), F.col("probes"))).alias("x"))
        finer = written(finer.select(F.xxhash64("k", "x.side", "x.piece").alias("k"), "probes", "line", "x.rest"), "lines-open")
        forget(rows)
        hot, n_hot = _hot(finer.where("probes = 0"))
        cold = finer.join(small(hot, n_hot), "k", "left_anti") if n_hot else finer
        x = cold.where("probes = 0").select("k", F.col("line").alias("x"), F.col("rest").alias("rx"))
        y = cold.select("k", F.col("line").alias("y"), F.col("rest").alias("ry"), "probes")
        pairs = x.join(y, "k").where((F.col("probes") == 1) | (F.col("x.first") < F.col("y.first")))
        pairs = pairs.where((F.col("ry") == "") | (F.col("rx") == "") | within("rx", "ry", 1))
        found.append(written(pairs.select(_later("x", "y").alias("l")).select("l.a", "l.b").distinct(), "lines-finer"))
        rows = written(finer.join(small(hot, n_hot), "k", "left_semi"), "lines-open") if n_hot else finer
        if n_hot:
            forget(finer)
    forget(rows)
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return out.distinct()


def near_lines(docs: DataFrame, lines: DataFrame, edits: int = EDITS) -> DataFrame:
    """(a, b): those of docs' distinct lines that an earlier line is within the edits of."""
    index = lines.select(F.explode("first.index").alias("k"), "a")
    probe = lines.select(F.explode("first.probe").alias("k"), F.col("a").alias("g"))
    split = None
    if edits == 1:
        hot, n_hot = _hot(index)
        if n_hot:
            split = _split_hot(docs, lines, hot, n_hot)
            index = index.join(small(hot, n_hot), "k", "left_anti")
    # 64 bits name a line here; lines are told apart when texts are compared
    pairs = written(index.join(probe, "k").where("a != g").select(F.least("a", "g").alias("a"), F.greatest("a", "g").alias("g")).distinct(), "lines-pairs")
    n = pairs.count()
    members = pairs.select("a").union(pairs.select("g")).distinct()
    texts = line_texts(docs, lines.join(small(members, 2 * n), "a", "left_semi"))
    one = texts.select(F.col("a").alias("k"), F.struct("a", "b", "first").alias("line"), "norm")
    both = pairs.join(one.select(F.col("k").alias("a"), F.col("line").alias("x"), F.col("norm").alias("nx")), "a").join(one.select(F.col("k").alias("g"), F.col("line").alias("y"), F.col("norm").alias("ny")), "g")
    near = both.where(within("nx", "ny", edits)).select(_later("x", "y").alias("l")).select("l.a", "l.b").distinct()
    return near.union(split).distinct() if split is not None else near


def dedup(docs: DataFrame, edits: int = EDITS) -> DataFrame:
    """docs with n_lines (not blank), n_removed, n_near (first occurrences removed), kept and kept_sha256."""
    rows = docs.select("doc_id", "text")
    lines = written(distinct_lines(rows, edits), "lines-distinct")
    near = written(near_lines(rows, lines, edits).withColumn("near", F.lit(True)), "lines-near")
    flagged = lines.select("a", "b", *[F.col("first")[c].alias(f"{c}_") for c in _DOC], "first.pos").join(small(near, near.count()), ["a", "b"], "left")
    # as many as a document has lines
    first = flagged.groupBy(*[f"{c}_" for c in _DOC]).agg(F.collect_list(F.when(F.col("near").isNull(), F.col("pos"))).alias("own"), F.count("near").alias("n_near"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), _doc().alias("d"), "text").join(first, [F.col("d")[c] == F.col(f"{c}_") for c in _DOC], "left")
    rows = rows.select("row", _lines().alias("all"), "own", "n_near")
    blank = F.filter(F.transform(F.col("all"), lambda x, i: F.when(x.rlike(r"^\s*$"), i)), lambda i: i.isNotNull())
    rows = rows.select("row", "all", blank.alias("blank"), F.coalesce("own", F.array().cast("array<int>")).alias("own"), F.coalesce("n_near", F.lit(0)).alias("n_near"))
    text = F.array_join(F.transform(F.sort_array(F.concat("own", "blank")), lambda i: F.get("all", i)), "\n")
    n_lines = (F.size("all") - F.size("blank")).cast("long")
    rows = rows.select("row", n_lines.alias("n_lines"), (n_lines - F.size("own")).alias("n_removed"), "n_near", text.alias("kept"))
    kept = [F.col("row")[c].alias(c) for c in docs.columns if c not in OWN]
    return rows.select(*kept, "n_lines", "n_removed", "n_near", "kept", F.sha2("kept", 256).alias("kept_sha256"))


def lines_query(docs: DataFrame) -> DataFrame:
    return dedup(docs.select("doc_id", "text")).select("doc_id", "n_lines", "n_removed", "n_near", "kept_sha256")
