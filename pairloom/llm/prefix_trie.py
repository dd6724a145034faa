"""The prefix trie of conversations, rolled up by pointer jumping.

Turns are put in order by one range sort, whose partitions split long conversations, and
numbered by the partitions' offsets. A prefix's digest is the XOR of 128-bit hashes of
its turns and their places; it is accumulated in blocks, then over blocks of blocks, so
that no task walks a whole conversation. A node is a depth and a digest, an edge leads to
the digest without the last turn.

Roll-up: every node points to its parent and holds its own leaf and savings. In a round
each node adds what it holds to the node it points to, and then points to where that one
points. After round k a node holds its subtree down to depth 2^k, so the rounds are the
logarithm of the greatest depth. Nodes that very many point to are joined by broadcast.

Rebuilding, as the query does it: conversation c is the first h turns of c - c % 5 (h is
crc32 of c's decimal digits, modulo 9) and then its own turns after its first h.

Cases: rows without conv_id are left out; null turns come first; turns of equal number
are ordered by role and text; null role and text are empty; rows that repeat are turns
of their own; a conversation that is rebuilt without turns is a member of the root only;
`%` keeps the sign of c; an empty table has no nodes, not even a root; extra columns are
ignored. The SHA-256 of a node's ends has to read them in one order; where a node has
more than ENDS of them, they arrive as strings of ENDS ids and go through the hash one
after the other, without being held together.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.llm.shared import forget, small, with_classes, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Turns of one block of a prefix, and ids that are joined to one string.
BLOCK, ENDS = 1024, 4096
#: First turns that a conversation may take from another: h is below this.
HEAD = 9


def in_order(rows: DataFrame) -> DataFrame:
    """conv_id, at (0, 1, ... through the whole table, ascending by conv_id and turn), ca and cb (128 bits of role and text) and bytes."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turns = rows.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", text("role").alias("role"), text("text").alias("text"))
    order = ["conv_id", "turn", "role", "text"]
    ranged = turns.repartitionByRange(*order).sortWithinPartitions(*order)
    lanes = F.xxhash64("role", "text").alias("ca"), F.xxhash64(F.lit("second"), "text", "role").alias("cb")
    found = written(ranged.select("conv_id", *lanes, F.octet_length("text").cast("long").alias("bytes"), F.monotonically_increasing_id().alias("id")), "trie-turns")
    part, offsets, upto = F.shiftright("id", 33), [], 0
    for p, n in sorted(found.groupBy(part.alias("part")).count().collect()):  # one row for each partition
        offsets.append((p, upto))
        upto += n
    starts = rows.sparkSession.createDataFrame(offsets, "part long, start long")
    at = F.col("start") + F.col("id").bitwiseAND(F.lit((1 << 33) - 1))
    return found.withColumn("part", part).join(F.broadcast(starts), "part").select("conv_id", at.alias("at"), "ca", "cb", "bytes")


def rebuilt(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rebuilt turns (conv_id, p from 0, ca, cb, bytes) and the conversations (conv_id, length)."""
    turns = in_order(rows)
    convs = turns.groupBy("conv_id").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEAD
    convs = written(convs.select("*", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % 5).alias("base")), "trie-convs")
    bases = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    convs = written(convs.join(bases, "base", "left").withColumn("taken", F.least("h", F.coalesce("n_base", F.lit(0)))), "trie-convs")
    total = convs.agg(F.sum("n")).first()[0] or 0
    placed = with_classes(turns, convs.select("conv_id", "first", "n", "h", "taken"), "conv_id", "n", total).withColumn("j", F.col("at") - F.col("first"))
    own = placed.where("j >= h").select("conv_id", (F.col("taken") + F.col("j") - F.col("h")).alias("p"), "ca", "cb", "bytes")
    heads = placed.where(F.col("j") < HEAD - 1).select(F.col("conv_id").alias("base"), F.col("j").alias("p"), "ca", "cb", "bytes")
    begun = convs.select("conv_id", "base", "taken").join(heads, "base").where("p < taken").select("conv_id", "p", "ca", "cb", "bytes")
    return own.unionByName(begun), convs.select("conv_id", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"))


def running(rows: DataFrame, longest: int) -> DataFrame:
    """rows (conv_id, p from 0 without gaps, xa, xb, ...) with a and b, the XOR of xa and xb up to p."""
    rows = rows.withColumn("block", F.floor(F.col("p") / BLOCK).cast("long"))
    upto = Window.partitionBy("conv_id", "block").orderBy("p")
    out = rows.select("*", F.bit_xor("xa").over(upto).alias("a"), F.bit_xor("xb").over(upto).alias("b"))
    if longest > BLOCK:
        totals = rows.groupBy("conv_id", F.col("block").alias("p")).agg(F.bit_xor("xa").alias("xa"), F.bit_xor("xb").alias("xb"))
        before = running(totals, -(-longest // BLOCK)).select("conv_id", (F.col("p") + 1).alias("block"), F.col("a").alias("va"), F.col("b").alias("vb"))
        zero = F.lit(0).cast("long")
        out = out.join(before, ["conv_id", "block"], "left").withColumns({"a": F.col("a").bitwiseXOR(F.coalesce("va", zero)), "b": F.col("b").bitwiseXOR(F.coalesce("vb", zero))}).drop("va", "vb")
    return out.drop("block")


def prefixes(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """conv_id, id (depth, a, b), up (its parent's id; null at the root), bytes of the last text, ends (whether the conversation is no longer) of every prefix."""
    longest = convs.agg(F.max("length")).first()[0] or 0
    placed = turns.select("conv_id", "p", "bytes", F.xxhash64("ca", "cb", "p").alias("xa"), F.xxhash64("p", "cb", "ca", F.lit("second")).alias("xb"))
    of = lambda depth, a, b: F.struct(depth.cast("long").alias("depth"), a.alias("a"), b.alias("b"))
    scanned = running(placed, longest)
    up = of(F.col("p"), F.col("a").bitwiseXOR(F.col("xa")), F.col("b").bitwiseXOR(F.col("xb")))
    below = scanned.select("conv_id", of(F.col("p") + 1, F.col("a"), F.col("b")).alias("id"), up.alias("up"), "bytes")
    zero = F.lit(0).cast("long")
    return below.unionByName(convs.select("conv_id", of(zero, zero, zero).alias("id"), F.lit(None).cast("struct<depth:long,a:long,b:long>").alias("up"), zero.alias("bytes")))


def rolled_up(nodes: DataFrame, deepest: int) -> DataFrame:
    """id, n_leaves and saved_tokens of each node's subtree. nodes: id, up, n_children, own (its savings)."""
    now = nodes.select("id", F.col("up").alias("to"), F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("n_leaves"), F.col("own").alias("saved_tokens"))
    total, held = None, None
    for k in range(deepest.bit_length()):
        sums = now.where("to IS NOT NULL").groupBy(F.col("to").alias("id")).agg(F.count("*").alias("n"), F.sum("n_leaves").alias("l"), F.sum("saved_tokens").alias("s"))
        zero = F.lit(0).cast("long")
        added = now.join(sums, "id", "left").select("id", "to", F.coalesce("n", zero).alias("n"), (F.col("n_leaves") + F.coalesce("l", zero)).alias("n_leaves"), (F.col("saved_tokens") + F.coalesce("s", zero)).alias("saved_tokens"))
        added = written(added, f"trie-sums-{k}")
        if held is not None:
            forget(held)
        held = added
        total = total or added.count()
        targets = added.where("n > 0").select(F.col("id").alias("to"), F.col("to").alias("next"), "n")
        moved = with_classes(added.where("to IS NOT NULL").drop("n"), targets, "to", "n", total).select("id", F.col("next").alias("to"), "n_leaves", "saved_tokens")
        now = moved.unionByName(added.where("to IS NULL").select("id", "to", "n_leaves", "saved_tokens"))
    return (now if held is None else held).select("id", "n_leaves", "saved_tokens")


def _digest(ids: Column) -> Column:
    return F.sha2(ids.cast("binary"), 256)


def ends_digests(ends: DataFrame) -> DataFrame:
    """id and ends_sha256 of the nodes in ends (id, conv_id)."""
    counts = ends.groupBy("id").agg(F.count("*").alias("n"))
    hot = written(counts.where(F.col("n") > ENDS).select("id"), "trie-hot-ends")
    n_hot = hot.count()
    cold = ends.join(small(hot, n_hot), "id", "left_anti") if n_hot else ends
    cold = cold.groupBy("id").agg(_digest(F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")).alias("ends_sha256"))
    if not n_hot:
        return cold
    most = ENDS

    def strings(batches):
        import pyarrow as pa

        for b in batches:
            keys, ids = b.column("id").to_pylist(), b.column("conv_id").to_pylist()
            cut = [i for i in range(len(ids)) if not i or keys[i] != keys[i - 1]]
            cut = [i for x, y in zip(cut, [*cut[1:], len(ids)], strict=True) for i in range(x, y, most)]
            texts = [",".join(map(str, ids[x:y])) for x, y in zip(cut, [*cut[1:], len(ids)], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(cut, pa.int64())), pa.array([ids[i] for i in cut], pa.int64()), pa.array(texts, pa.string())], ["id", "first", "part"])

    def hashes(batches):
        import hashlib

        import pyarrow as pa

        key = value = None
        for b in batches:
            for k, part in zip(b.column("id").to_pylist(), b.column("part").to_pylist(), strict=True):
                if k != key:
                    if value:
                        yield pa.RecordBatch.from_arrays([pa.array([key], b.schema.field("id").type), pa.array([value.hexdigest()])], ["id", "ends_sha256"])
                    key, value = k, hashlib.sha256(part.encode())
                else:
                    value.update(b"," + part.encode())
            kind = b.schema.field("id").type
        if value:
            yield pa.RecordBatch.from_arrays([pa.array([key], kind), pa.array([value.hexdigest()])], ["id", "ends_sha256"])

    kind = "struct<depth:long,a:long,b:long>"
    ranged = ends.join(small(hot, n_hot), "id", "left_semi").repartitionByRange("id", "conv_id").sortWithinPartitions("id", "conv_id")
    parts = ranged.mapInArrow(strings, f"id {kind}, first long, part string")
    return cold.unionByName(parts.repartition("id").sortWithinPartitions("id", "first").mapInArrow(hashes, f"id {kind}, ends_sha256 string"))


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """A row for each node, as `trie_query` returns it. turns: conv_id, p, ca, cb, bytes; convs: conv_id, length."""
    found = written(prefixes(turns, convs), "trie-prefixes")
    nodes = found.groupBy("id").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.any_value("up").alias("up"), F.any_value("bytes").alias("bytes"))
    nodes = written(nodes, "trie-nodes")
    children = nodes.where("up IS NOT NULL").groupBy(F.col("up").alias("id")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, "id", "left").select("id", "conv_id", "n_convs", "up", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("own"))
    nodes = written(nodes, "trie-nodes")
    n_nodes, deepest = nodes.agg(F.count("*"), F.max("id.depth")).first()
    sums = rolled_up(nodes, deepest or 0)
    ends = found.join(convs, "conv_id").where(F.col("id.depth") == F.col("length")).select("id", "conv_id")
    ends = ends_digests(written(ends, "trie-ends"))
    parents = nodes.where("n_children > 0").select(F.col("id").alias("up"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("n"))
    named = with_classes(nodes.where("up IS NOT NULL"), parents, "up", "n", n_nodes).select("id", "parent_conv_id")
    out = nodes.join(named, "id", "left").join(sums, "id").join(ends, "id", "left")
    none = _digest(F.lit(""))
    return out.select("conv_id", F.col("id.depth").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256"))


def trie_query(rows: DataFrame) -> DataFrame:
    turns, convs = rebuilt(rows)
    return trie(turns, written(convs, "trie-lengths"))
