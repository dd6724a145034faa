"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pairloom.llm import decontam, html_main, lines, media, minhash, mixing, oracles, prefix_trie, quality, sharding, simhash, substring, toxicity, whitening


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.decontam_query(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.substring_query(_table(spark, sf_dir, "documents"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_query(_table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_query(_table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.lines_query(_table(spark, sf_dir, "documents"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.html_query(_table(spark, sf_dir, "pages"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_query(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded_query(_table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_query(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_query(_table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie_query(_table(spark, sf_dir, "conversations"))


def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.minhash_query(_table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitening_query(_table(spark, sf_dir, "embeddings"))


_ALL = (op1_decontamination, op2_substring_dedup, op3_simhash, op4_mixing, op5_line_dedup, op6_html_extraction, op7_toxicity, op8_sharding, op9_quality, op10_media, op11_prefix_trie, op12_minhash, op13_whitening)

_ORACLES: dict[str, str] = {"op1_decontamination": oracles.DECONTAMINATION, "op2_substring_dedup": oracles.SUBSTRING, "op4_mixing": oracles.MIXING, "op5_line_dedup": oracles.LINES, "op8_sharding": oracles.SHARDING, "op11_prefix_trie": oracles.PREFIX_TRIE, "op12_minhash": oracles.MINHASH}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _ALL}


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)
