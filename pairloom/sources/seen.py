"""What earlier runs have seen: a stored table of fingerprints that outlives the session.

The table is partitioned by run and bucketed by fingerprint, so a later run joins it
without moving it: only its own rows are dealt to the buckets. A Bloom filter, stored
beside it and kept up by OR-ing each run's bits into it, is asked first: rows whose bits
are not all set are new for sure and do not take part in the join at all. The filter has
a fixed size; when it fills up, more rows go through the join, with the same result.

A run that is repeated under its name replaces its own entries and is never held against
them. A run's rows are written before its fingerprints are added.

Cases: rows with a null key are new in every run and are not stored; rows that repeat
within a run count once, the first in the given order; an empty run adds nothing.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Buckets of a new table, words of 64 bits of its filter (16 MB), and bits of a fingerprint that are set in it.
BUCKETS, WORDS, BITS = 64, 1 << 21, 4


def _bits(fp: str) -> list[tuple[Column, Column]]:
    """The word and the mask of each bit that a fingerprint sets."""
    masks = F.array(*[F.lit(1 << k if k < 63 else -(1 << 63)).cast("long") for k in range(64)])
    out = []
    for i in range(BITS):
        h = F.xxhash64(F.lit(i), fp)
        out.append((F.pmod(h, F.lit(WORDS)).cast("int"), F.get(masks, F.shiftrightunsigned(h, 58).cast("int"))))
    return out


class Seen:
    """The stored fingerprints at a path that all machines share; made where there are none."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path = spark, path.rstrip("/")
        self.name = f"seen_{hashlib.md5(self.path.encode()).hexdigest()}"
        self.fs = spark._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        if not self._there("settings"):
            spark.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.json(f"{self.path}/settings")
        self.buckets = spark.read.schema("buckets int").json(f"{self.path}/settings").first()[0]
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} (fp STRING, run STRING) USING parquet PARTITIONED BY (run) CLUSTERED BY (fp) SORTED BY (fp) INTO {self.buckets} BUCKETS LOCATION '{self.path}/fingerprints'"
        )
        if self._there("fingerprints"):
            spark.catalog.recoverPartitions(self.name)

    def _there(self, name: str) -> bool:
        return self.fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}"))

    def fingerprints(self, but: str | None = None) -> DataFrame:
        """fp of all runs but one."""
        rows = self.spark.table(self.name)
        return (rows if but is None else rows.where(F.col("run") != but)).select("fp")

    def filter(self) -> DataFrame | None:
        """One row, words: the filter's words in order; None before the first run."""
        parts = [f.getPath().toString() for f in self.fs.listStatus(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/filter"))] if self._there("filter") else []
        if not parts:
            return None
        words = self.spark.read.schema("at int, bits long").parquet(*parts).groupBy("at").agg(F.bit_or("bits").alias("bits"))
        every = self.spark.range(WORDS).select(F.col("id").cast("int").alias("at")).join(words, "at", "left")
        zero = F.lit(0).cast("long")
        return every.agg(F.transform(F.sort_array(F.collect_list(F.struct("at", F.coalesce("bits", zero).alias("bits")))), lambda x: x["bits"]).alias("words"))

    def maybe(self, fp: str = "fp") -> Column:
        """Whether the filter (column words) has all bits of a fingerprint."""
        found = F.lit(True)
        for at, mask in _bits(fp):
            found = found & (F.get("words", at).bitwiseAND(mask) != 0)
        return found

    def new(self, rows: DataFrame, run: str) -> DataFrame:
        """The rows (column fp, distinct but for nulls) that no run but this one has seen."""
        words = self.filter()
        if words is None:
            return rows
        asked = rows.crossJoin(F.broadcast(words)).withColumn("maybe_", F.coalesce(self.maybe(), F.lit(False))).drop("words")
        sure = asked.where("NOT maybe_").drop("maybe_")
        return sure.unionByName(asked.where("maybe_").drop("maybe_").join(self.fingerprints(run), "fp", "left_anti").select(*sure.columns))

    def add(self, rows: DataFrame, run: str) -> None:
        """Store the fingerprints (column fp) of a run, in place of what it stored before."""
        fps = rows.where("fp IS NOT NULL").select("fp").distinct().repartition(self.buckets, "fp")
        view = f"{self.name}_new"
        fps.createOrReplaceTempView(view)
        self.spark.sql(f"INSERT OVERWRITE TABLE {self.name} PARTITION (run = '{run}') SELECT fp FROM {view}")
        self.spark.catalog.dropTempView(view)
        own = self.spark.table(self.name).where(F.col("run") == run)
        bits = own.select(F.explode(F.array(*[F.struct(at.alias("at"), mask.alias("mask")) for at, mask in _bits("fp")])).alias("b"))
        bits.groupBy("b.at").agg(F.bit_or("b.mask").alias("bits")).write.mode("overwrite").parquet(f"{self.path}/filter/run={run}")


def first_seen(seen: Seen, rows: DataFrame, key: Column, order: list[str], run: str, out: str) -> DataFrame:
    """Of each key that no other run has seen, the first row in the given order; written to `out` and added to what was seen."""
    if not run.replace("_", "").replace("-", "").isalnum():
        raise ValueError(f"the name of a run has letters, digits, - and _: {run}")
    rest = [c for c in rows.columns if c not in order]
    keyed = rows.select(F.md5(key).alias("fp"), F.struct(*order, *rest).alias("row_"))
    firsts = keyed.where("fp IS NOT NULL").groupBy("fp").agg(F.min("row_").alias("row_")).unionByName(keyed.where("fp IS NULL"))
    seen.new(firsts, run).select("fp", "row_.*").write.mode("overwrite").parquet(out)
    found = seen.spark.read.parquet(out)
    seen.add(found, run)
    return found.select(*rows.columns)
