"""SimHash near-dedup with BK-trees.

A document's fingerprint sums its shingles' hashes bit by bit. Equal fingerprints
collapse to one; the distinct ones are searched for pairs within `radius` bits.

Shards: a pair within `radius` bits of 64 agrees on at least one of radius + 1
bit blocks (on more of them when blocks are finer), so each fingerprint goes to
one shard per block, keyed by the block's value, and pairs meet in a shard. Each
shard builds a BK-tree: children keyed by their integer Hamming distance to the
parent; a query follows only the edges within `radius` of its own distance to a node.
A task builds and searches the trees of all its shards at once, a level at a time.
Trees live in the tasks that hold their shard: broadcasting them would collect every
fingerprint at the driver. Shards over `TILE` fingerprints are dealt over tiles, a
task for each pair of tiles: the tree of one slice, searched by the other. Within a
task only links that join two groups are kept, never all pairs of a group.

Cases: null and empty texts have fingerprint zero and link like any other; fewer
words than a shingle make one shingle of the whole; rows that repeat share a
component; a null doc_id never names a component unless no other id is there;
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import sys
from itertools import combinations

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.components import components
from pairloom.llm.shared import BROADCAST_ROWS, forget, row_key, small, utf8, with_classes, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: The most fingerprints of one shard in a tile.
TILE = 4096
#: Nodes that the queries of one step may visit at most.
STEP = 1 << 17


def fingerprint(text: bytes, width: int = 4, seed: int = 42) -> int:
    """64-bit SimHash over the word shingles of the lower-cased text, repeats included."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    sums = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):  # bounded memory for very long texts
        part = [b" ".join(words[i : i + width]) for i in range(at, min(n, at + (1 << 16)))]
        h = np.array([xxh64_intdigest(s, seed) for s in part], np.uint64)
        sums += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * sums > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int = 4, seed: int = 42) -> DataFrame:
    """rk, doc_id, fp (signed) of every row."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            fps = np.array([fingerprint(t, width, seed) for t in utf8(b.column("text"))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("rk"), b.column("doc_id"), pa.array(fps, pa.int64())], ["rk", "doc_id", "fp"])

    rows = docs.select(row_key().alias("rk"), F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(run, "rk struct<a:long,b:long>, doc_id long, fp long")


class Groups:
    """Union-find over positions, in whole arrays; links that join two groups are kept."""

    def __init__(self, n: int):
        self.up = np.arange(n)
        self.links: list[np.ndarray] = []

    def link(self, x: np.ndarray, y: np.ndarray) -> None:
        while len(x):
            a, b = self.up[x], self.up[y]
            apart = a != b
            x, y, high, low = x[apart], y[apart], np.maximum(a, b)[apart], np.minimum(a, b)[apart]
            # each group hangs on one lower group, so every link kept joins two
            high, first = np.unique(high, return_index=True)
            self.links.append(np.stack([x[first], y[first]], 1))
            self.up[high] = low[first]
            while (self.up[self.up] != self.up).any():
                self.up = self.up[self.up]


class BKForest:
    """BK-trees over uint64 fingerprints, one for each shard, built and searched a level at a time.

    A node holds one fingerprint (`item`, a position) and its children by Hamming
    distance. Nodes are numbered by level, then parent, then distance, so that the
    children of a node follow each other and `edge` (parent * 128 + distance) is sorted;
    the first nodes are the roots.
    """

    def __init__(self, fps: np.ndarray, items: np.ndarray, shard: np.ndarray):
        """items: positions of the fingerprints that become nodes; shard: the number of each one's shard, ascending from 0."""
        self.fps = fps
        self.size = np.bincount(shard) if len(shard) else np.zeros(0, np.int64)
        nodes, edges, made, key = [], [], 0, shard
        while len(items):
            new = np.ones(len(items), bool)
            new[1:] = key[1:] != key[:-1]
            first = np.flatnonzero(new)
            nodes.append(items[first])
            edges.append(key[first] if made else first[:0])
            node = made + np.cumsum(new) - 1
            made += len(first)
            rest = np.flatnonzero(~new)
            far = np.bitwise_count(fps[items[rest]] ^ fps[items[first][node[rest] - made + len(first)]]).astype(np.int64)
            key = node[rest] * 128 + far
            order = np.argsort(key, kind="stable")
            items, key = items[rest][order], key[order]
        self.item = np.concatenate(nodes) if nodes else np.zeros(0, np.int64)
        self.edge = np.concatenate(edges) if edges else np.zeros(0, np.int64)
        self.roots = len(self.item) - len(self.edge)
        self.visited = 0

    def search(self, queries: np.ndarray, shard: np.ndarray, radius: int, found) -> None:
        """Calls found(queries, items) with arrays of positions that are within the radius of each other, in steps."""
        cost = np.cumsum(self.size[shard])
        cut = np.searchsorted(cost, np.arange(STEP, cost[-1] if len(cost) else 0, STEP))
        for q, node in zip(np.split(queries, cut), np.split(shard, cut), strict=True):
            while len(q):
                self.visited += len(q)
                item = self.item[node]
                far = np.bitwise_count(self.fps[q] ^ self.fps[item]).astype(np.int64)
                hit = (far <= radius) & (q != item)
                if hit.any():
                    found(q[hit], item[hit])
                low = np.searchsorted(self.edge, node * 128 + np.maximum(far - radius, 0))
                high = np.searchsorted(self.edge, node * 128 + far + radius, "right")
                n = high - low
                q = np.repeat(q, n)
                node = self.roots + np.repeat(low - (np.cumsum(n) - n), n) + np.arange(len(q))


def shard_links(fps: np.ndarray, side: np.ndarray, radius: int, shard: np.ndarray | None = None) -> np.ndarray:
    """Links, as pairs of positions, that connect what each shard connects; side 0 is the tree, side 1 queries it (2: both)."""
    shard = np.zeros(len(fps), np.int64) if shard is None else shard
    groups, tree, queries = Groups(len(fps)), np.flatnonzero(side != 1), np.flatnonzero(side != 0)
    known, number = np.unique(shard[tree], return_inverse=True)
    if len(known):
        at = np.minimum(np.searchsorted(known, shard[queries]), len(known) - 1)
        here = known[at] == shard[queries]
        BKForest(fps, tree, number).search(queries[here], at[here], radius, groups.link)
    return np.concatenate(groups.links) if groups.links else np.zeros((0, 2), np.int64)


def block_masks(radius: int, distinct: int) -> list[int]:
    """Bit masks of which a pair within the radius agrees on one at least; finer the more fingerprints there are."""
    for blocks in range(radius + 1, radius + 6):
        agree = blocks - radius
        bits = 64 * agree // blocks
        if distinct >> bits <= 256 or blocks == radius + 5:
            edges = [64 * i // blocks for i in range(blocks + 1)]
            parts = [((1 << edges[i + 1]) - (1 << edges[i])) for i in range(blocks)]
            return [sum(c) for c in combinations(parts, agree)]
    raise AssertionError


def near_links(distinct: DataFrame, radius: int) -> DataFrame:
    """(a, b): links that connect every two fingerprints (column fp, distinct) within `radius` bits, through groups."""
    masks = block_masks(radius, distinct.count())
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m))) for i, m in enumerate(signed)])
    rows = distinct.select("fp", F.explode(keys).alias("key"))
    hot = written(rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > TILE), "simhash-hot")
    n_hot = hot.count()
    whole = F.lit(2).cast("byte").alias("side")
    if n_hot:
        joined = rows.join(F.broadcast(hot) if n_hot <= BROADCAST_ROWS else hot, "key", "left")
        cold = joined.where("n is null").select("key", "fp", whole)
        # a shard over TILE is cut into g slices; tile (x, y), x <= y, holds slices x and y
        g = F.ceil(F.col("n") / TILE).cast("int")
        own = joined.where("n is not null").withColumn("g", g).withColumn("x", F.pmod(F.xxhash64("fp", F.lit("tile")), F.col("g")).cast("int"))
        own = own.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
        tile = F.xxhash64("key", F.least("x", "y"), F.greatest("x", "y"))
        side = F.when(F.col("x") == F.col("y"), 2).when(F.col("x") < F.col("y"), 0).otherwise(1).cast("byte")
        rows = cold.union(own.select(tile.alias("key"), "fp", side.alias("side")))
    else:
        rows = rows.select("key", "fp", whole)

    def run(batches):
        import pyarrow as pa

        def links(keys, fps, sides):
            shard = np.cumsum(np.append(0, np.diff(keys) != 0))
            several = np.bincount(shard)[shard] > 1
            fps = fps[several]
            found = shard_links(fps.view(np.uint64), sides[several], radius, shard[several])
            if len(found):
                yield pa.RecordBatch.from_arrays([pa.array(fps[found[:, 0]]), pa.array(fps[found[:, 1]])], ["a", "b"])

        held = None
        for b in batches:
            now = [b.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            if held is not None:
                now = [np.concatenate(x) for x in zip(held, now, strict=True)]
            last = np.searchsorted(now[0], now[0][-1]) if len(now[0]) else 0  # the last key may go on in the next batch
            held = [x[last:] for x in now]
            if last:
                yield from links(*(np.ascontiguousarray(x[:last]) for x in now))
        if held is not None and len(held[0]):
            yield from links(*(np.ascontiguousarray(x) for x in held))

    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long")


def dedup(docs: DataFrame, radius: int = 4, width: int = 4, seed: int = 42) -> DataFrame:
    """rk, doc_id, fp, component_id of every row, and of its component: root (a fingerprint), first (the row that leads it), rows.

    component_id is the least doc_id that links reach; the row with the least (doc_id, nulls last, rk) leads a component.
    """
    fps = written(fingerprints(docs, width, seed), "simhash-fp")
    row = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "rk")
    classes = written(fps.groupBy("fp").agg(F.min(row).alias("first"), F.count("*").alias("n")), "simhash-classes")
    roots = components(near_links(classes.select("fp"), radius))
    named = classes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "n", "first", F.coalesce("root", "fp").alias("root"))
    named = written(named, "simhash-named")
    groups = written(named.groupBy("root").agg(F.min("first").alias("lead"), F.sum("n").alias("rows"), F.count("*").alias("fps")), "simhash-groups")
    n_fps, n_rows = classes.count(), fps.count()
    named = with_classes(named.select("fp", "n", "root"), groups, "root", "fps", n_fps)
    named = written(named.select("fp", "n", "root", "lead", "rows"), "simhash-components")
    found = with_classes(fps, named, "fp", "n", n_rows)
    return found.select("rk", "doc_id", "fp", F.col("lead.doc_id").alias("component_id"), "root", F.col("lead.rk").alias("first"), "rows")


def simhash_query(docs: DataFrame) -> DataFrame:
    found = dedup(docs)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_per_group(docs: DataFrame, radius: int = 4) -> DataFrame:
    """The rows of docs without near copies: of each component the row with the least doc_id stays (nulls last).

    Only keys of rows that go are joined to the texts, by broadcast where they are few.
    """
    found = written(dedup(docs, radius).where("rows > 1").select("rk", "first"), "simhash-several")
    gone = written(found.where("rk != first").select("rk").distinct(), "simhash-gone")
    # the row that stays may itself repeat
    again = written(found.where("rk = first").groupBy("rk").agg(F.count("*").alias("n")).where("n > 1").select("rk"), "simhash-again")
    forget(found)
    n_gone, n_again = gone.count(), again.count()
    rows = docs.select(F.struct(*docs.columns).alias("row"), row_key().alias("rk")).join(small(gone, n_gone), "rk", "left_anti")
    if n_again:
        once = rows.join(small(again, n_again), "rk", "left_semi").dropDuplicates(["rk"])
        rows = rows.join(small(again, n_again), "rk", "left_anti").unionByName(once)
    return rows.select("row.*")
