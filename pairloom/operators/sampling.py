"""Numbering, quotas, splits and weighted choices that depend on rows, not on partitions."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from pairloom.functions.rng import draw
from pairloom.functions.text import let

#: Cells by which rows are numbered, as bits of a draw: the table of offsets has at most so many rows a group,
#: and a cell of 10^12 rows some 15 million.
CELL_BITS = 16
CELLS = 1 << CELL_BITS


def numbered(df: DataFrame, group: list[str], cell: Column, order: list[str], name: str = "index") -> DataFrame:
    """Adds a gapless number from 0 within each group, in the order of (cell, order).

    cell must follow the order and take few values; rows are ranked within a cell
    only, and cells are added up in a small table, so no group meets in one task.
    """
    rows = df.withColumn("cell_", cell)
    before = W.Window.partitionBy(*group, F.lit(0)).orderBy("cell_").rowsBetween(W.Window.unboundedPreceding, -1)
    sums = rows.groupBy(*group, "cell_").agg(F.count("*").alias("n_")).withColumn("offset_", F.coalesce(F.sum("n_").over(before), F.lit(0))).drop("n_")
    keys = [*group, "cell_"]
    renamed = sums.select(*[F.col(k).alias(f"{k}__") for k in keys], "offset_")
    on = [F.col(k).eqNullSafe(F.col(f"{k}__")) for k in keys]
    rank = F.row_number().over(W.Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("rank_", rank).join(renamed, on, "left").withColumn(name, F.col("offset_") + F.col("rank_") - 1).drop("cell_", "rank_", "offset_", *[f"{k}__" for k in keys])


def shuffled(df: DataFrame, group: list[str], step: str, *key: str, name: str = "index") -> DataFrame:
    """Numbers rows in a seeded random order within each group."""
    rows = df.withColumn("h_", draw(step, *key))
    return numbered(rows, group, F.shiftright("h_", 32 - CELL_BITS), ["h_", *key], name).drop("h_")


def quota(pool: DataFrame, total: int, shares: dict[str, float], *key: str) -> DataFrame:
    """Of each domain int(total * share) rows: a sample without replacement, or all and the rest drawn again.

    Adds copy: 0 for the first of a row, more for repeats.
    """
    wanted = F.create_map(*[F.lit(x) for d, s in shares.items() for x in (d, int(total * s))])
    rows = stored(shuffled(stored(pool), ["domain"], "quota", *key))  # the pool is read twice, its numbering three times
    sizes = rows.groupBy("domain").agg(F.count("*").alias("have")).withColumn("want", F.coalesce(F.try_element_at(wanted, F.col("domain")), F.lit(0)))
    rows = rows.join(F.broadcast(sizes), "domain")  # one row for each domain
    taken = rows.where(F.col("index") < F.col("want")).withColumn("copy", F.lit(0).cast("long"))
    short = sizes.where((F.col("want") > F.col("have")) & (F.col("have") > 0))
    again = short.select("domain", F.explode(F.sequence(F.lit(1), (F.col("want") - F.col("have")).cast("int"))).alias("copy"), F.col("have").alias("have_"))
    again = again.withColumn("index", draw("again", "domain", "copy") % F.col("have_")).drop("have_")
    more = rows.join(again, ["domain", "index"]).select(*taken.columns)
    return taken.unionByName(more).drop("have", "want", "index")


def halves(df: DataFrame, step: str, *key: str, group: list[str] | None = None) -> DataFrame:
    """Adds second_half: rows in random order from n // 2 on."""
    rows = df.withColumn("all_", F.lit(1))
    by = [*(group or []), "all_"]
    rows = stored(shuffled(rows, by, step, *key))  # read twice
    n = rows.groupBy(*by).agg(F.count("*").alias("n_"))
    return rows.join(F.broadcast(n), by).withColumn("second_half", F.col("index") >= F.floor(F.col("n_") / 2)).drop("all_", "index", "n_")


def split_eval(df: DataFrame, share: float, *key: str) -> DataFrame:
    """Adds split: exactly floor(share * n) rows are eval, the others train."""
    rows = shuffled(df.withColumn("all_", F.lit(1)), ["all_"], "split", *key)
    n = df.agg(F.count("*").alias("n_"))
    return rows.crossJoin(F.broadcast(n)).withColumn("split", F.when(F.col("index") < F.floor(F.col("n_") * F.lit(share)), "eval").otherwise("train")).drop("all_", "index", "n_")


def stratified(df: DataFrame, stratum: str, most: int, *key: str) -> DataFrame:
    """Up to `most` random rows of each stratum."""
    return shuffled(df, [stratum], "stratified", *key).where(F.col("index") < most).drop("index")


def sample(df: DataFrame, n: int, *key: str) -> DataFrame:
    """n random rows: a top-n by draw, which each partition cuts first."""
    return df.withColumn("h_", draw("sample", *key)).orderBy("h_", *key).limit(n).drop("h_")


def last(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The last n rows in an explicit order."""
    return df.orderBy(*[F.col(c).desc() for c in order]).limit(n)


def weighted_places(n: Column, k: Column, step: str, *key: Column | str, edge: float = 0.3) -> Column:
    """Up to k distinct places of n (from 0), drawn with replacement; the first and last weigh `edge` where n > 3."""

    def place(j: Column) -> Column:
        h = draw(F.concat(F.lit(step), j.cast("string")), *key).cast("double") / F.lit(float(1 << 32))
        all_ = n - 2 + F.lit(2 * edge)

        def at(x: Column) -> Column:
            heavy = F.when(x * all_ < edge, F.lit(0)).when(x * all_ >= all_ - F.lit(edge), n - 1).otherwise(F.least(F.floor(x * all_ - F.lit(edge)).cast("int") + 1, n - 2))
            return F.when(n > 3, heavy).otherwise(F.floor(x * n).cast("int"))

        return let(h, at)

    drawn = F.when(k > 0, F.transform(F.sequence(F.lit(0), k - 1), place)).otherwise(F.array().cast("array<int>"))
    return F.array_sort(F.array_distinct(drawn))


def stored(df: DataFrame) -> DataFrame:
    """df computed once: a checkpoint where the session names a shared folder, else on this machine's disk (tests, one machine)."""
    session = df.sparkSession.sparkContext
    folder = session.getConf().get("spark.checkpoint.dir") or df.sparkSession.conf.get("spark.checkpoint.dir", None)
    if not folder:
        return df.persist(StorageLevel.DISK_ONLY)
    if session._jsc.sc().getCheckpointDir().isEmpty():
        session.setCheckpointDir(folder)
    return df.checkpoint()
