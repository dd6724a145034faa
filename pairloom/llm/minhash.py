"""MinHash near-dedup with circulant permutations.

A document's set holds the hashes of its distinct word shingles. Two permutations make
all coordinates of its signature: the first scatters a shingle over 2^32 places; the
second orders the places, shifted circularly by k for coordinate k, whose value is the
least one of the set. `bands` groups of `rows` coordinates are the bucket keys. With 32
bands of 4, two documents at similarity 0.8 share no bucket with a probability below
5e-8, and less the more alike they are.

Equal sets collapse to one class first. Candidates are confirmed by the exact Jaccard
similarity of their whole sets. A bucket's pairs are never all written: members are
tested against a pivot; a pivot that met all members outside its component leaves the
bucket, and a bucket closes when its members have one component. Only members of other
components than the bucket's largest become pivots, more of them in each round, and a
pair meets in one bucket only. Pairs are not tested where sizes, the shingles that only
one member of large buckets has, or the differences of both from the bucket's first
pivot leave too few in common. So a group of near copies costs about one test a member,
while every pair of a bucket is tested, linked through others, or ruled out exactly.

Cases: texts without words, null ones among them, have an empty set, link with nothing
and lead themselves; fewer words than a shingle make one shingle of the whole; rows that
repeat share a class; a null doc_id never names a component unless it has no other, and
is kept only then; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import sys

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.llm.components import components
from pairloom.llm.shared import BROADCAST_ROWS, forget, hashed_words, mix, pieces, row_key, small, utf8, with_classes, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BANDS, ROWS, WIDTH, SHARE = 32, 4, 4, 80
#: A set is sent to a join once for each so many pairs that need it.
HEAVY = 1000
#: From so many members on, a bucket's members are first held against the shingles that no other has.
LARGE = 16
#: Places that one step permutes, so that they stay in the processor's cache.
STEP = 1 << 16


def word_sets(texts: list[bytes], width: int = WIDTH) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text, lower-cased in ASCII."""
    words, at = hashed_words([t.lower() for t in texts])
    out = []
    for a, b in zip(at[:-1], at[1:], strict=True):
        w, n = words[a:b], max(min(width, b - a), 0)
        h = np.full(max(b - a - n + 1, 0) if n else 0, n, np.uint64)
        for k in range(n):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + w[k : k + len(h)])
        out.append(np.unique(h))
    return out


def places(shingles: np.ndarray) -> np.ndarray:
    """The first permutation: where a shingle stands among 2^32 places."""
    return (mix(shingles ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)).astype(np.uint32)


def order_of(x: np.ndarray) -> np.ndarray:
    """The second permutation, of all 32-bit numbers; overwrites x."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x21F0AAAD)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0xD35A2D97)
    x ^= x >> np.uint32(15)
    return x


def signatures(sets: list[np.ndarray], coordinates: int) -> np.ndarray:
    """coordinates x sets of uint32: coordinate k is the least order of the places shifted by k. No set may be empty."""
    out = np.full((coordinates, len(sets)), 0xFFFFFFFF, np.uint32)
    sizes = np.array([len(s) for s in sets])
    ends = np.cumsum(sizes)
    u = places(np.concatenate(sets)) if sets else np.zeros(0, np.uint32)
    for at in range(0, len(u), STEP):
        part = u[at : at + STEP]
        first = int(np.searchsorted(ends, at, "right"))
        last = int(np.searchsorted(ends, at + len(part) - 1, "right")) + 1
        starts = np.maximum(ends[first:last] - sizes[first:last] - at, 0)
        for k in range(coordinates):
            least = np.minimum.reduceat(order_of(part + np.uint32(k)), starts)
            np.minimum(out[k, first:last], least, out=out[k, first:last])
    return out


def band_keys(signature: np.ndarray, rows: int) -> np.ndarray:
    """sets x bands of int64: the hash of each `rows` consecutive coordinates and the band's number."""
    bands = len(signature) // rows
    keys = np.empty((signature.shape[1], bands), np.uint64)
    for b in range(bands):
        h = np.full(signature.shape[1], b + 1, np.uint64)
        for r in range(rows):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + signature[b * rows + r])
        keys[:, b] = h
    return keys.view(np.int64)


def signed(docs: DataFrame, width: int = WIDTH, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """rk, doc_id, c (128 bits of the set), n (its size) and keys (its buckets; none for an empty set) of every row."""

    def run(batches):
        import pyarrow as pa
        from xxhash import xxh3_128_digest

        for b in batches:
            texts = utf8(b.column("text"))
            for i, j in pieces(texts):
                sets = word_sets(texts[i:j], width)
                digests = np.frombuffer(b"".join(xxh3_128_digest(s.tobytes()) for s in sets), ">i8").astype(np.int64).reshape(-1, 2)
                full = np.array([len(s) > 0 for s in sets])
                keys = band_keys(signatures([s for s in sets if len(s)], bands * rows), rows)
                ends = np.append(0, np.cumsum(full) * bands).astype(np.int32)
                c = pa.StructArray.from_arrays([pa.array(digests[:, 0]), pa.array(digests[:, 1])], ["a", "b"])
                yield pa.RecordBatch.from_arrays(
                    [b.column("rk").slice(i, j - i), b.column("doc_id").slice(i, j - i), c, pa.array([len(s) for s in sets], pa.int64()), pa.ListArray.from_arrays(ends, pa.array(keys.reshape(-1)))], ["rk", "doc_id", "c", "n", "keys"]
                )

    rows_ = docs.select(row_key().alias("rk"), F.col("doc_id").cast("long"), "text")
    return rows_.mapInArrow(run, "rk struct<a:long,b:long>, doc_id long, c struct<a:long,b:long>, n long, keys array<long>")


def sets_of(docs: DataFrame, wanted: DataFrame, n_wanted: int, width: int) -> DataFrame:
    """c and its whole set (shingles), for the rows of docs whose key rk is `wanted`; once for each c."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            texts = utf8(b.column("text"))
            for i, j in pieces(texts):
                sets = word_sets(texts[i:j], width)
                ends = np.append(0, np.cumsum([len(s) for s in sets])).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column("c").slice(i, j - i), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(sets).view(np.int64)))], ["c", "shingles"])

    texts = docs.select(row_key().alias("rk"), "text").join(small(wanted, n_wanted), "rk").select("c", "text")
    return texts.mapInArrow(run, "c struct<a:long,b:long>, shingles array<long>").groupBy("c").agg(F.any_value("shingles").alias("shingles"))


def alike(n: Column | str, spare: Column | str, m: Column | str, other: Column | str, share: int) -> Column:
    """Whether sets of sizes n and m, which can have at most spare and other shingles in common, can be similar enough."""
    f = lambda c: F.col(c) if isinstance(c, str) else c
    return F.least(f(spare), f(other)) * (100 + share) >= (f(n) + f(m)) * share


def spares(members: DataFrame, sets: DataFrame, crowd: DataFrame, n_crowd: int, share: int) -> DataFrame:
    """members (key, c, n, m) with spare, how many shingles a member can share with another of its bucket at most; without members that cannot have a partner.

    In a bucket of `LARGE` members and more, shingles that no other member of any such bucket has are not counted:
    most members of a crowd that is alike, but not enough so, go here without a test. crowd: c of the members of such buckets.
    """
    if not n_crowd:
        return members.withColumn("spare", F.col("n"))
    each = sets.join(small(crowd, n_crowd), "c").select("c", F.explode("shingles").alias("h"))
    alone = each.groupBy("h").agg(F.count("*").alias("sets"), F.min("c.a").alias("a"), F.min("c.b").alias("b")).where("sets = 1")
    own = written(alone.groupBy(F.struct("a", "b").alias("c")).agg(F.count("*").alias("own")), "minhash-own")
    spare = F.col("n") - F.when(F.col("m") >= LARGE, F.coalesce("own", F.lit(0))).otherwise(0)
    rows = members.join(small(own, own.count()), "c", "left").withColumn("spare", spare).drop("own")
    return rows.where(F.col("spare") * 100 >= F.col("n") * share)


def compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b and what else they have), distinct, with n, the sum of their sets' sizes, and common; as a written table.

    Only sets of pairs are sent. A set that many pairs share as a is sent in copies, to a slice of them each.
    """
    pairs = written(pairs.distinct(), "minhash-pairs")
    n_pairs = pairs.count()
    left, right = (sets.select(F.col("c").alias(k), F.col("shingles").alias(s)) for k, s in (("a", "x"), ("b", "y")))
    if n_pairs <= BROADCAST_ROWS:
        left, right = (side.join(F.broadcast(pairs.select(k)), k, "left_semi") for side, k in ((left, "a"), (right, "b")))
    n_heavy = 0
    if n_pairs > HEAVY:
        heavy = written(pairs.groupBy("a").agg(F.ceil(F.count("*") / HEAVY).cast("int").alias("slices")).where("slices > 1"), "minhash-heavy")
        n_heavy = heavy.count()
    if n_heavy:
        slices = F.coalesce("slices", F.lit(1))
        sliced = pairs.join(small(heavy, n_heavy), "a", "left").withColumn("slice", F.pmod(F.xxhash64("b"), slices).cast("int")).drop("slices")
        left = left.join(small(heavy, n_heavy), "a", "left").select("a", "x", F.explode(F.sequence(F.lit(0), slices - 1)).alias("slice"))
        both = sliced.join(left, ["a", "slice"]).drop("slice")
    else:
        both = pairs.join(left, "a")
    n, common = (F.size("x") + F.size("y")).cast("long"), F.size(F.array_intersect("x", "y")).cast("long")
    tested = written(both.join(right, "b").withColumn("n", n).withColumn("common", common).drop("x", "y"), "minhash-tested")
    forget(pairs)
    return tested


def joined_roots(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    """roots (node, root) after links (a, b) between roots, or nodes that had none, as a written table."""
    new = components(links)
    if roots is not None:
        new = written(new, "minhash-joined")
        n = new.count()
        to = small(new.select(F.col("node").alias("root"), F.col("root").alias("to")), n)
        known = roots.join(to, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
        new = known.unionByName(new.join(small(roots.select("node"), roots.count()), "node", "left_anti"))
    return written(new, "minhash-roots")


def apart(n: Column, own: Column, far: Column, m: Column, others: Column, other_far: Column, share: int) -> Column:
    """Whether two sets differ too much to be similar, judging by a third.

    A set differs from the third in `far` shingles, `own` of which no other set has. What two sets can differ
    in alike is at most the smaller far - own, so they differ from each other in own + others +
    |(far - own) - (other_far - others)| shingles at least. Unknown (null) is not apart.
    """
    least = own + others + F.abs((far - own) - (other_far - others))
    return F.coalesce(least * (100 + share) > (n + m) * (100 - share), F.lit(False))


def component_roots(docs: DataFrame, classes: DataFrame, width: int, share: int) -> DataFrame | None:
    """(node, root) of the classes that link with another; None if none does. classes: c, n, keys, rk."""
    rows = classes.select("c", "n", "rk", F.explode("keys").alias("key"))
    buckets = written(rows.groupBy("key").agg(F.count("*").alias("m")).where("m > 1"), "minhash-buckets")
    total = buckets.agg(F.sum("m")).first()[0]
    if not total:
        return None
    members = written(with_classes(rows, buckets, "key", "m", total), "minhash-members")
    wanted = written(members.groupBy("c", "rk", "n").agg((F.max("m") >= LARGE).alias("crowd")), "minhash-wanted")
    n_wanted, n_crowd = wanted.agg(F.count("*"), F.count_if("crowd")).first()
    sets = written(sets_of(docs, wanted.select("rk", "c"), n_wanted, width), "minhash-sets")
    members = written(spares(members.drop("rk"), sets, wanted.where("crowd").select("c"), n_crowd, share), "minhash-members")
    forget(buckets, wanted)
    # the first pivot is the member with the fewest shingles of its own: what links with others mostly links with it
    pivots = members.groupBy("key").agg(F.count("*").alias("m"), F.min(F.struct((F.col("n") - F.col("spare")).alias("own"), "c", "n", "spare")).alias("pivot")).where("m > 1")
    pivots = written(pivots, "minhash-pivots")
    members = written(with_classes(members.drop("m"), pivots, "key", "m", total, pivots.count()), "minhash-members")
    other = F.col("c") != F.col("pivot.c")
    pairs = members.where(other & alike("n", "spare", "pivot.n", "pivot.spare", share)).select(F.col("pivot.c").alias("a"), F.col("c").alias("b"), F.col("pivot.c").alias("ra"), F.col("c").alias("rb"))
    rest = members.where(other).select("key", "c", "n", "spare", F.col("pivot.c").alias("p"))
    roots, first, most = None, None, 64
    while True:
        tested = compared(pairs, sets)
        links = tested.where(F.col("common") * 100 >= (F.col("n") - F.col("common")) * share).select(F.col("ra").alias("a"), F.col("rb").alias("b"))
        if links.count():
            roots = joined_roots(roots, links)
        state = rest.withColumn("root", F.col("c"))
        if roots is not None:
            state = rest.join(small(roots, roots.count()), F.col("c") == F.col("node"), "left").select(rest["*"], F.coalesce("root", "c").alias("root"))
        state = written(state, "minhash-rest")
        by_root = state.groupBy("key", "root").agg(F.count("*").alias("m")).groupBy("key").agg(F.sum("m").alias("m"), F.max(F.struct("m", "root")).alias("top"))
        open_ = written(by_root.where(F.col("m") > F.col("top.m")).select("key", "m", (F.col("m") - F.col("top.m")).alias("others"), F.col("top.root").alias("top")), "minhash-open")
        forget(members)
        n_open, total = open_.agg(F.count("*"), F.sum("m")).first()
        if not total:
            return roots
        # of the members outside the largest component, `most` by hash become pivots; others stay for the next round
        drawn = (F.col("root") != F.col("top")) & ((F.col("others") <= most) | (F.pmod(F.xxhash64("c", F.lit(most)), F.col("others")) < most))
        members = with_classes(state, open_, "key", "m", total, n_open).withColumn("drawn", drawn).drop("m", "others", "top")
        if first is None:  # how far each is from its bucket's first pivot
            first = tested.select(F.col("a").alias("p"), F.col("b").alias("c"), (F.col("n") - 2 * F.col("common")).alias("far"))
            members = members.join(small(first, tested.count()), ["p", "c"], "left").drop("p")
        members = written(members, "minhash-members")
        forget(state, open_)
        mine = members.groupBy("c").agg(F.collect_list("key").alias("mine"))  # at most one for each band
        keyed = members.join(small(mine, total), "c")
        if total > BROADCAST_ROWS:
            keyed = written(keyed, "minhash-keyed")
        pivots = keyed.where("drawn").select("key", F.col("c").alias("a"), F.col("n").alias("na"), F.col("spare").alias("sa"), F.col("far").alias("fa"), F.col("root").alias("ra"), F.col("mine").alias("theirs"))
        once = F.col("key") == F.array_min(F.array_intersect("mine", "theirs"))  # a pair meets in one bucket
        ruled_out = apart(F.col("n"), F.col("n") - F.col("spare"), F.col("far"), F.col("na"), F.col("na") - F.col("sa"), F.col("fa"), share)
        n_pivots = members.where("drawn").count()
        meet = keyed.join(small(pivots, n_pivots), "key").where((F.col("root") != F.col("ra")) & alike("n", "spare", "na", "sa", share) & ~ruled_out & (~F.col("drawn") | (F.col("a") < F.col("c"))) & once)
        pairs = meet.select("a", F.col("c").alias("b"), "ra", F.col("root").alias("rb"))
        rest = members.where(~F.col("drawn")).select("key", "c", "n", "spare", "far")
        most *= 16


def dedup(docs: DataFrame, width: int = WIDTH, share: int = SHARE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """rk, doc_id, n_shingles and component_id, the least doc_id that links reach, of every row; similar from `share` per cent."""
    found = written(signed(docs, width, bands, rows), "minhash-signed")
    row = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "rk")
    full = found.where("n > 0").groupBy("c").agg(F.min(row).alias("first"), F.count("*").alias("copies"), F.any_value("n").alias("n"), F.any_value("keys").alias("keys"))
    classes = written(full.select("c", "first", "copies", "n", "keys", F.col("first.rk").alias("rk")), "minhash-classes")
    roots = component_roots(docs, classes, width, share)
    empty = found.where("n = 0").select("rk", "doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    named = classes.select("c", "copies", "first", F.col("c").alias("root"))
    if roots is not None:
        named = named.drop("root").join(small(roots, roots.count()), F.col("c") == F.col("node"), "left").select("c", "copies", "first", F.coalesce("root", "c").alias("root"))
    named = written(named, "minhash-named")
    groups = written(named.groupBy("root").agg(F.min("first").alias("lead"), F.count("*").alias("sets")), "minhash-groups")
    n_classes, n_rows = named.count(), found.count()
    leads = written(with_classes(named, groups, "root", "sets", n_classes, groups.count()).select("c", "copies", F.col("lead.doc_id").alias("component_id")), "minhash-leads")
    of_full = with_classes(found.where("n > 0").select("rk", "doc_id", "n", "c"), leads, "c", "copies", n_rows, n_classes)
    return of_full.select("rk", "doc_id", F.col("n").alias("n_shingles"), "component_id").unionByName(empty)


def minhash_query(docs: DataFrame) -> DataFrame:
    return dedup(docs).select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
