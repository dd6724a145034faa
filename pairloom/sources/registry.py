"""Named document sources with a fallback, and the built-in tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from pairloom.sources import cases

Loader = Callable[[SparkSession], DataFrame]


class Sources:
    """Loaders of (doc_id, text) by name; an unknown name goes to the default, a failing one to the built-in sentences."""

    def __init__(self, default: str):
        self.default, self.loaders = default, {}

    def add(self, name: str, loader: Loader) -> Sources:
        self.loaders[name] = loader
        return self

    def table(self, name: str, path: str, text: str = "text", key: str = "doc_id", where: str | None = None) -> Sources:
        """A Parquet table with the given text and key columns."""

        def load(spark: SparkSession) -> DataFrame:
            df = spark.read.parquet(path)
            df = df.where(where) if where else df
            return df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))

        return self.add(name, load)

    def load(self, spark: SparkSession, name: str, most: int | None = None) -> DataFrame:
        loader = self.loaders.get(name) or self.loaders[self.default]
        try:
            df = loader(spark)
        except (AnalysisException, OSError):
            df = cases.samples(spark)
        return df.limit(most) if most else df

    def blend(self, spark: SparkSession, shares: dict[str, float], total: int) -> DataFrame:
        """source, doc_id, text: int(total * share) documents of each source."""
        out = None
        for name, share in shares.items():
            part = self.load(spark, name, int(total * share)).withColumn("source", F.lit(name))
            out = part if out is None else out.unionByName(part)
        return out.select("source", "doc_id", "text")
