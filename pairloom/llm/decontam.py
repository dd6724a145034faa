"""Benchmark decontamination: size-partitioned MinHash containment search, exactly verified.

Texts are lower-cased; words are runs of letters and digits; shingles are five
words. A document is contaminated by an item if it holds at least `share` of the
item's distinct shingles. An item of fewer words is one shingle of that many words;
where there are such items, documents have shingles of those widths, too.

Items are partitioned by their number of shingles, in powers of two; each partition
has one sketch size: the m least hashes (a bottom-m MinHash) of an item's shingles,
with m one more than an item of the partition may lack. An item that a document
contains to the threshold has a sketch shingle in the document, so no document is
missed. (Banded signatures of whole documents could not promise that: a short item
in a very long document has a Jaccard similarity near zero.) A document's hashes
are looked up in the index of sketches; documents found that way, and only those,
are verified: their distinct shingle strings are joined to those of the items they
were found by, and counted.

The index and the items are broadcast only if their counted rows are within the
bound. A larger index is joined by shuffle, and only with shingles whose bit is set in
a bitmap of the index's hashes, whose size is fixed.

Cases: null and empty texts match nothing; an item of fewer than five words, even of
one, matches every document in which its words follow each other; rows that repeat give one result per
row key; item rows with equal id and words count once, unlike texts under one id are
items of their own; a null doc_id or item_id is reported as null; no documents or no
items give no rows; other columns do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from pairloom.llm import shared
from pairloom.llm.shared import row_key, small, written

WIDTH = 5
SHARE = 0.8
#: The bitmap of a large index has 64 times 2 to this power bits: 16 MB.
BITMAP = 21


def _words(text: str = "text") -> Column:
    """The normalised words; no empty ones."""
    one = F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    return F.when(one == "", F.array().cast("array<string>")).otherwise(F.split(one, " "))


def _runs(words: Column, width: int, join) -> Column:
    """join(words of a run) for every run of so many consecutive words; none in a shorter array."""
    return F.transform(F.slice(words, 1, F.greatest(F.size(words) - (width - 1), F.lit(0))), lambda w, i: join(w, *[F.get(words, i + k) for k in range(1, width)]))


def _item_shingles(words: Column, width: int) -> Column:
    """The text of every shingle of an item; the whole sequence if it is shorter."""
    return F.when(F.size(words) >= width, _runs(words, width, _text)).otherwise(F.array(F.array_join(words, " ")))


def _shingles(words: Column, width: int, short: list[int], join) -> Column:
    """join(words) for every shingle of a document, of the common width and of those of short items."""
    whole = lambda *ws: join(_text(*ws))
    return F.concat(_runs(words, width, join), *[_runs(words, k, whole) for k in short])


def _text(*words: Column) -> Column:
    return F.concat_ws(" ", *words)


def _hash(*words: Column) -> Column:
    return F.xxhash64(*words)


def _items(items: DataFrame, width: int, share: float) -> DataFrame:
    """key (never null), item_id, shingles (distinct strings), n, and m, of how many of them (by hash) the sketch is; one row for each distinct item."""
    key = F.xxhash64(F.col("item_id").isNull(), "item_id", F.array_join("w", " "), F.lit("item"))
    rows = items.select("item_id", _words().alias("w")).where(F.size("w") > 0).withColumn("key", key).dropDuplicates(["key"])
    rows = rows.select("key", "item_id", F.array_distinct(_item_shingles(F.col("w"), width)).alias("shingles"), F.size("w").alias("words"))
    rows = rows.withColumn("n", F.size("shingles")).withColumn("partition", F.ceil(F.log2(F.col("n").cast("double"))).cast("int"))
    # the most shingles that an item of the partition may lack, and one more
    most = F.pow(F.lit(2.0), F.col("partition"))
    return rows.withColumn("m", (most - F.ceil(most * share - 1e-9) + 1).cast("int"))


def _possible(hashes: DataFrame, index: DataFrame) -> DataFrame:
    """The rows of hashes (h) whose bit is set in a bitmap of the index: all that are in it, and few others."""
    place = F.col("h").bitwiseAND(F.lit((1 << BITMAP) - 1))
    bit = F.shiftrightunsigned("h", 58)
    one = F.element_at(F.array(*[F.lit(1 << k if k < 63 else -(1 << 63)).cast("long") for k in range(64)]), bit.cast("int") + 1)
    words = index.groupBy(place.cast("int").alias("at")).agg(F.bit_or(one).alias("bits"))
    all_ = index.sparkSession.range(1 << BITMAP).select(F.col("id").cast("int").alias("at")).join(words, "at", "left")
    bitmap = all_.agg(F.transform(F.sort_array(F.collect_list(F.struct("at", F.coalesce("bits", F.lit(0).cast("long")).alias("bits")))), lambda x: x["bits"]).alias("bitmap"))
    bitmap = written(bitmap, "decontam-bitmap")  # one row of a fixed size
    return hashes.crossJoin(F.broadcast(bitmap)).where(F.get("bitmap", place.cast("int")).bitwiseAND(one) != 0).drop("bitmap")


def contaminated(docs: DataFrame, items: DataFrame, width: int = WIDTH, share: float = SHARE) -> DataFrame:
    """rk, doc_id, item_id, n_shingles, n_found, containment: one row for each document row key and item it contains."""
    table = written(_items(items, width, share), "decontam-items")
    short = sorted(r[0] for r in table.where(F.col("words") < width).select("words").distinct().collect())  # fewer than `width` numbers
    # the hash of a shingle's words, as documents compute it
    parts = F.split(F.col("s"), " ")
    hashed = F.when(F.size(parts) == width, F.xxhash64(*[F.get(parts, F.lit(k)) for k in range(width)])).otherwise(F.xxhash64("s"))
    index = table.select("key", "m", F.explode("shingles").alias("s")).withColumn("h", hashed)
    rank = F.row_number().over(W.Window.partitionBy("key").orderBy("h", "s"))
    index = written(index.withColumn("r", rank).where(F.col("r") <= F.col("m")).select("h", "key").distinct(), "decontam-index")
    n_index = index.count()
    keyed = docs.select(row_key().alias("rk"), F.col("doc_id"), "text")
    words = keyed.select("rk", _words().alias("w"))
    hashes = words.select("rk", F.explode(_shingles(F.col("w"), width, short, _hash)).alias("h"))
    if n_index > shared.BROADCAST_ROWS:
        hashes = _possible(hashes, index)
    found = hashes.join(small(index, n_index), "h").groupBy("rk").agg(F.collect_set("key").alias("items"))
    found = written(found, "decontam-found")
    n_found = found.count()
    rows = keyed.join(small(found, n_found), "rk").dropDuplicates(["rk"])
    rows = rows.select("rk", "doc_id", "items", _words().alias("w"))
    rows = rows.select("rk", "doc_id", "items", F.explode(F.array_distinct(_shingles(F.col("w"), width, short, _text))).alias("s"))
    known = table.select("key", F.explode("shingles").alias("s"))
    pairs = rows.join(small(known, table.agg(F.sum("n")).first()[0] or 0), "s").where(F.array_contains("items", F.col("key")))
    pairs = pairs.groupBy("rk", "doc_id", "key").agg(F.count("*").cast("int").alias("n_found"))
    pairs = pairs.join(small(table.select("key", "item_id", F.col("n").alias("n_shingles")), table.count()), "key")
    pairs = pairs.select("rk", "doc_id", "item_id", "n_shingles", "n_found", (F.col("n_found") / F.col("n_shingles")).alias("containment"))
    return pairs.where(F.col("n_found") >= F.ceil(F.col("n_shingles") * share - 1e-9))


def decontam_query(docs: DataFrame, items: DataFrame) -> DataFrame:
    return contaminated(docs, items).select("doc_id", "item_id", "n_shingles", "n_found", F.round("containment", 6).alias("containment"))


def clean_docs(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs that contain no item."""
    leaks = written(contaminated(docs, items).select("rk").distinct(), "decontam-leaks")
    rows = docs.select(F.struct(*docs.columns).alias("row"), row_key().alias("rk"))
    return rows.join(small(leaks, leaks.count()), "rk", "left_anti").select("row.*")
