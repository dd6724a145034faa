"""The sentence pipeline on a stream: an extension, for documents that keep arriving."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.functions import text
from pairloom.operators import sentences


def curated(docs: DataFrame, ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """ts, doc_id, pos, sentence, domain: good sentences of a stream, near duplicates within the watermark dropped."""
    pieces = docs.withWatermark(ts, late).where(F.length(text.strip("text")) >= sentences.MIN_CHARS)
    pieces = pieces.select(ts, "doc_id", F.posexplode(text.sentence_pieces("text")).alias("pos", "raw"))
    pieces = pieces.withColumn("piece", text.strip("raw")).where("piece != ''").select(ts, "doc_id", "pos", text.reterminate("piece").alias("sentence"))
    good = pieces.where(sentences.is_high_quality("sentence")).withColumn("fp", text.fingerprint("sentence"))
    return good.dropDuplicatesWithinWatermark(["fp"]).withColumn("domain", sentences.classify("sentence")).drop("fp")


def domain_counts(curated_: DataFrame, ts: str = "ts", width: str = "1 hour") -> DataFrame:
    """Windowed counts of each domain."""
    return curated_.groupBy(F.window(ts, width), "domain").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "domain", "n")
