"""Sharding: minimax contiguous partition of ordered atomic groups.

Groups are equal texts, ordered by 64 bits of the text's MD5, which other engines can
compute too. The smallest
shard capacity that lets a greedy left-to-right packing of whole groups use at
most `shards` shards is found by binary search; the cuts are those of that
packing. The search reads histograms only: sums of sizes by the next 12 bits of
the hash, and opens just those buckets in which a cut may fall, level by level,
so the driver never holds more than a few times 4096 sums whatever the input.

Cases: a null text counts as empty (size 1, checksum 0); equal texts, null and
empty among them, share a shard; rows that repeat, null ids too, are all placed;
an empty table gives no rows; other columns are ignored. Shards may be empty
when there are fewer groups than shards.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from pairloom.llm.shared import small, written

#: Bits of the hash by which a bucket is opened.
BITS = 12
#: Cells by which rows of a shard are numbered: a constant, so the table of offsets is bounded.
CELLS = 2048
#: Rows that are alike come back in blocks of so many, spread over tasks when there are many blocks.
BLOCK = 1 << 16


class _Groups:
    """Ordered group sizes, known as sums over hash ranges that are opened on demand.

    nodes: disjoint hash ranges in order, each (first, bits fixed, bytes, one group?).
    """

    def __init__(self, slim: DataFrame):
        self.slim, self.nodes = slim, []
        self.nodes = self._split([(-(1 << 63), 0)])[0] if slim is not None else []
        self._sum()

    def _split(self, ranges: list[tuple[int, int]]) -> list[list]:
        """One job: the children of the given (first, bits) ranges, all with equal bits."""
        bits = ranges[0][1]
        down = 64 - bits - min(BITS, 64 - bits)
        rows = self.slim
        if bits:
            rows = rows.where(F.shiftright("h", 64 - bits).isin([lo >> (64 - bits) for lo, _ in ranges]))
        sums = rows.groupBy(F.shiftright("h", down).alias("k")).agg(F.sum("size").alias("b"), (F.min("h") == F.max("h")).alias("one"), F.min("h").alias("lo"))
        out: list[list] = [[] for _ in ranges]
        at = {lo >> (64 - bits) if bits else 0: i for i, (lo, _) in enumerate(ranges)}
        for r in sorted(sums.collect(), key=lambda r: r.k):
            parent = (r.k << down) >> (64 - bits) if bits else 0
            out[at[parent]].append((r.lo if r.one else r.k << down, 64 if r.one else 64 - down, r.b, r.one))
        return out

    def _sum(self) -> None:
        self.ends, total = [], 0
        for n in self.nodes:
            total += n[2]
            self.ends.append(total)
        self.total = total

    def open(self, nodes: set[int]) -> None:
        by_bits: dict[int, list[int]] = {}
        for i in nodes:
            by_bits.setdefault(self.nodes[i][1], []).append(i)
        found = {}
        for ids in by_bits.values():
            found.update(zip(ids, self._split([self.nodes[i][:2] for i in ids]), strict=True))
        self.nodes = [x for i, n in enumerate(self.nodes) for x in found.get(i, [n])]
        self._sum()

    def pack(self, capacity: int, shards: int) -> tuple[bool | None, list[int], set[int]]:
        """Does a greedy packing fit? None: unknown until the returned buckets are opened. Also the cuts, as node indices."""
        low = high = 0  # bounds of the bytes packed so far
        unsure: set[int] = set()
        cuts = []
        for _ in range(shards):
            if low >= self.total:
                break
            i = bisect_right(self.ends, low + capacity)  # nodes up to i fit whole
            j = bisect_right(self.ends, high + capacity)
            for x in {i, j} if low != high or i < len(self.nodes) else ():
                if x < len(self.nodes) and not self.nodes[x][3]:
                    unsure.add(x)
            cuts.append(i)
            low = max(low, self.ends[i - 1] if i else 0)
            if j < len(self.nodes) and self.nodes[j][3]:
                high = max(high, self.ends[j - 1] if j else 0)
            else:
                high = min(self.total, high + capacity)
            high = max(high, low)
        if low >= self.total:
            return True, cuts, unsure
        if high < self.total:
            return False, cuts, unsure
        return None, cuts, unsure


def minimax_cuts(slim: DataFrame, shards: int) -> tuple[list[int], int]:
    """The first hash of each shard but the first, and the smallest feasible capacity; slim has `h`, `size`."""
    groups = _Groups(slim)
    if not groups.nodes:
        return [], 0

    def fits(capacity: int) -> bool:
        while True:
            verdict, _, unsure = groups.pack(capacity, shards)
            if verdict is not None:
                return verdict
            if not unsure:
                return False
            groups.open(unsure)

    low, high = -(-groups.total // shards), groups.total
    while low < high:
        mid = (low + high) // 2
        if fits(mid):
            high = mid
        else:
            low = mid + 1
    while True:  # the cuts themselves must be exact
        _, cuts, unsure = groups.pack(low, shards)
        if not unsure:
            break
        groups.open(unsure)
    return [groups.nodes[i][0] for i in cuts if i < len(groups.nodes)], low


def _hash(text: F.Column) -> F.Column:
    """The first 64 bits of an MD5, signed."""
    return F.conv(F.substring(F.md5(text), 1, 16), 16, -10).cast("bigint")


def shard(docs: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot and group of every row of docs."""
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = written(docs.select("doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"), _hash(text).alias("h")), "shard")
    cuts, _ = minimax_cuts(slim, shards)
    number = F.lit(0)
    for c in cuts:
        number = number + (F.col("h") >= F.lit(c)).cast("int")
    # rows that are alike are numbered as one, with their number: a cell holds no more rows for them
    rows = slim.groupBy("doc_id", "size", "text_crc32", "h").agg(F.count("*").alias("alike")).withColumn("shard", number)
    key = F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("h").cast("string")))
    rows = rows.withColumn("cell", F.conv(F.substring(key, 1, 4), 16, 10).cast("int") % CELLS)
    before = W.Window.partitionBy("shard").orderBy("cell").rowsBetween(W.Window.unboundedPreceding, -1)
    offsets = rows.groupBy("shard", "cell").agg(F.sum("alike").alias("n")).select("shard", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = W.Window.partitionBy("shard", "cell").orderBy("doc_id", "h").rowsBetween(W.Window.unboundedPreceding, -1)
    placed = rows.withColumn("rank", F.coalesce(F.sum("alike").over(within), F.lit(0)))
    placed = placed.join(small(offsets, shards * CELLS), ["shard", "cell"])
    placed = placed.select("doc_id", "size", "text_crc32", "shard", (F.col("offset") + F.col("rank")).alias("slot"), F.col("h").alias("group_hash"), "alike")
    blocks = placed.withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("alike") - 1, F.lit(BLOCK).cast("long"))))
    if (rows.agg(F.max("alike")).first()[0] or 0) > 16 * BLOCK:
        blocks = blocks.repartition("group_hash", "at")
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.col("alike") - F.col("at"), F.lit(BLOCK)) - 1)).alias("i")
    rows = blocks.select("doc_id", "size", "text_crc32", "shard", (F.col("slot") + F.col("at")).alias("slot"), "group_hash", each)
    return rows.select("doc_id", "size", "text_crc32", "shard", (F.col("slot") + F.col("i")).alias("slot"), "group_hash")


def sharded_query(docs: DataFrame, shards: int = 8) -> DataFrame:
    return shard(docs, shards).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
