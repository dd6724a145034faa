"""Connected components of a link table: large-star and small-star rounds.

Each round is three aggregations and two joins of the links; nothing is collected.
The rounds end when every node links to one node only, which links to none: then that
is the least node of its component. One aggregation tells it, so links that are stars
from the start take no round. Each round's links are a table in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.shared import BROADCAST_ROWS, forget, small, written


def _ends(links: DataFrame) -> tuple[int, int]:
    """How many nodes the links have, and how many of them link to several nodes or to one that links on."""
    up = links.select(F.col("a").alias("node"), F.col("b").alias("up"), F.lit(False).alias("below"))
    down = links.select(F.col("b").alias("node"), F.lit(None).cast(links.schema["b"].dataType).alias("up"), F.lit(True).alias("below"))
    nodes = up.union(down).groupBy("node").agg(F.min("up").alias("least"), F.max("up").alias("most"), F.max("below").alias("below"))
    return nodes.agg(F.count("*"), F.count_if((F.col("least") != F.col("most")) | (F.col("below") & F.col("least").isNotNull()))).first()[:]


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the links (a, b); root is the least node of its component.

    Null ends and self-links are ignored, links may repeat in either direction.
    """
    now = written(links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "links")
    for _ in range(most_rounds):
        n, loose = _ends(now)
        if not loose:
            break
        # large star: every greater neighbour of u links to the least of u and its neighbours
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(small(least, n), "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        if n > BROADCAST_ROWS:  # else it is made twice, without a shuffle
            large = large.distinct()
        # small star: u and its lesser neighbours link to the least of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        stars = large.join(small(least, n), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").union(least.select("a", "m")).distinct()
        before, now = now, written(stars, "links")
        forget(before)
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b")).groupBy("node").agg(F.min("root").alias("root"))
