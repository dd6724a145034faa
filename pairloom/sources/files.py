"""Scans and sinks: JSON Lines (strict, permissive), sentence pools, files by extension, checkpoints, reports, caches."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairloom.functions.lexicons import COLUMN_PAIRS, DOMAINS

#: Training examples; earlier files lack some fields.
EXAMPLE = (
    "corrupted string, clean string, domain string, complexity string, error_types array<string>, num_errors int, word_count int, char_count int, difficulty_score double, source string, punctuation_removed boolean"
)
CHAT = "messages array<struct<role: string, content: string>>, metadata struct<domain: string, complexity: string, error_types: array<string>, num_errors: int, difficulty_score: double, source: string, word_count: int, char_count: int>"


def read_strict(spark: SparkSession, path: str, schema: str = EXAMPLE) -> DataFrame:
    """JSON Lines; blank lines are skipped, a bad line fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_permissive(spark: SparkSession, path: str, schema: str = EXAMPLE) -> DataFrame:
    """JSON Lines without the lines that do not parse."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def bad_lines(spark: SparkSession, path: str, schema: str = EXAMPLE) -> DataFrame:
    """file, line (text) of what does not parse."""
    parsed = F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    rows = spark.read.text(path).where("trim(value) != ''").select(F.input_file_name().alias("file"), F.col("value").alias("line"), parsed["_bad"].alias("bad"))
    return rows.where("bad is not null").select("file", "line")


def with_defaults(df: DataFrame) -> DataFrame:
    """Missing fields of training examples: unknown categories, counts taken from the clean text, no errors, a difficulty of 0 as none."""
    from pairloom.functions import text

    for name in ("domain", "complexity", "source"):
        df = df.withColumn(name, F.coalesce(name, F.lit("unknown")))
    df = df.withColumn("error_types", F.coalesce("error_types", F.array().cast("array<string>"))).withColumn("num_errors", F.coalesce("num_errors", F.lit(0)))
    df = df.withColumn("word_count", F.coalesce("word_count", text.n_words("clean"))).withColumn("char_count", F.coalesce("char_count", F.length("clean")))
    return df.withColumn("difficulty_score", F.nullif("difficulty_score", F.lit(0.0)))


def read_pool(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """domain, pos, sentence of sentence-pool files, each one document or, with lines, one in each line; an absent map is empty."""
    rows = spark.read.schema("metadata map<string, string>, sentences_by_domain map<string, array<string>>").option("multiLine", not lines).json(path)
    return rows.select(F.explode("sentences_by_domain").alias("domain", "s")).select("domain", F.posexplode("s").alias("pos", "sentence"))


def write_observed(df: DataFrame, path: str, kind: str = "parquet", by: tuple[str, ...] = (), **measures: Column) -> dict:
    """Write df and return the measures (aggregates) of what was written, taken by the job that writes.

    The measures stand in the stage that writes, whose tasks count once however often they are tried.
    """
    seen = Observation()
    df.observe(seen, *[c.alias(k) for k, c in measures.items()]).write.partitionBy(*by).format(kind).save(path)
    return seen.get


#: Files of a domain in a written pool.
POOL_FILES = 16


def write_pool(pool: DataFrame, path: str, method: str = "documents") -> dict:
    """JSON files by domain and a metadata file, which is returned as well; counted while the sentences are written.

    A domain is dealt over several tasks. `pool_document` gives the single-document form for pools that fit a row.
    """
    names = [*DOMAINS, "general"] if "general" not in DOMAINS else [*DOMAINS]
    rows = pool.select("domain", "sentence").repartition(F.col("domain"), F.pmod(F.xxhash64("sentence"), F.lit(POOL_FILES)))
    found = write_observed(rows, f"{path}/sentences", "json", ("domain",), total=F.count("*"), chars=F.sum(F.length("sentence")), **{f"n_{d}": F.count_if(F.col("domain") == d) for d in names})
    counts = {d: found[f"n_{d}"] for d in names if found[f"n_{d}"]}
    meta = {"total_sentences": found["total"], "total_chars": found["chars"] or 0, "domains": len(counts), "domain_counts": counts, "collection_method": method, "quality_filtered": True}
    schema = "total_sentences long, total_chars long, domains long, domain_counts map<string, long>, collection_method string, quality_filtered boolean"
    pool.sparkSession.createDataFrame([tuple(meta.values())], schema).coalesce(1).write.json(f"{path}/metadata")
    return meta


def pool_documents(pool: DataFrame, *by: str, method: str = "documents") -> DataFrame:
    """value: a JSON pool document for each group of `by`, as large as the group. A pool in one document is one group: it must fit a row."""
    domains = pool.groupBy(*by, "domain").agg(F.sort_array(F.collect_list("sentence")).alias("s"), F.count("*").alias("n"))
    meta = F.struct(F.sum("n").alias("total_sentences"), F.sort_array(F.collect_list("domain")).alias("domains"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("domain", "n")))).alias("domain_counts"), F.lit(method).alias("collection_method"), F.lit(True).alias("quality_filtered"))
    return domains.groupBy(*by).agg(F.to_json(F.struct(meta.alias("metadata"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("domain", "s")))).alias("sentences_by_domain"))).alias("value")).select("value")


def pool_document(pool: DataFrame, method: str = "documents") -> DataFrame:
    """One row, value: the pool as a JSON document. For pools that fit a row."""
    return pool_documents(pool, method=method)


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """CSV, JSON, JSON Lines, Parquet, ORC or text by extension."""
    kind = re.search(r"\.(\w+)(?:\.gz)?/?$", path)
    name = kind.group(1).lower() if kind else "parquet"
    reader = spark.read
    if name == "csv":
        reader = reader.option("header", True).option("multiLine", True).option("escape", '"')
    return reader.format({"jsonl": "json"}.get(name, name)).load(path)


def guess_columns(df: DataFrame, pairs: list[tuple[str, str]] | None = None) -> tuple[str, str]:
    """The source and target columns: a known pair of names, else the first two string columns."""
    for a, b in pairs or COLUMN_PAIRS:
        if a in df.columns and b in df.columns:
            return a, b
    strings = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if len(strings) < 2:
        raise ValueError(f"no pair of text columns among {df.columns}")
    return strings[0], strings[1]


def checkpoints(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, checkpoint, step of folders named checkpoint-<step>; others have step 0. The list is the driver's."""
    rows = spark.createDataFrame([(p,) for p in paths], "path string")
    name = F.regexp_extract("path", r"([^/]*)/?$", 1)
    step = F.coalesce(F.nullif(F.regexp_extract("path", r"checkpoint-(\d+)", 1), F.lit("")).cast("int"), F.lit(0))
    return rows.select("path", name.alias("checkpoint"), step.alias("step"))


def checkpoint_folder(spark: SparkSession, path: str) -> DataFrame:
    """path, checkpoint, step, epoch of the folders checkpoint-* in a folder of any store; epoch from their trainer_state.json, 0 without one."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/checkpoint-*")
    store = at.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [str(f.getPath()) for f in store.globStatus(at) or [] if f.isDirectory()]
    listed = checkpoints(spark, found) if found else spark.createDataFrame([], "path string, checkpoint string, step int")
    states = [f"{p}/trainer_state.json" for p in found if store.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{p}/trainer_state.json"))]
    if not states:
        return listed.withColumn("epoch", F.lit(0.0))
    read = spark.read.schema("epoch double").option("multiLine", True).json(states)
    return with_epochs(listed, read.select(F.regexp_extract(F.input_file_name(), r"(checkpoint-[^/]*)/trainer_state\.json", 1).alias("checkpoint"), "epoch"))


def with_epochs(found: DataFrame, states: DataFrame) -> DataFrame:
    """Adds epoch from trainer states (checkpoint, epoch); 0 where there is none."""
    return found.join(states.select("checkpoint", "epoch"), "checkpoint", "left").withColumn("epoch", F.coalesce("epoch", F.lit(0.0)))


def write_lines(df: DataFrame, path: str) -> None:
    df.write.json(path)


def report(**parts: DataFrame) -> DataFrame:
    """One row, value: a JSON report of small tables, each a list of its rows in the order of all columns."""
    out = None
    for name, table in parts.items():
        row = table.select(F.struct(*table.columns).alias("r")).agg(F.sort_array(F.collect_list("r")).alias(name))
        out = row if out is None else out.crossJoin(row)
    return out.select(F.to_json(F.struct(*parts)).alias("value"))


def write_cache(df: DataFrame, path: str, **meta: str) -> None:
    """Token columns as Parquet, with a metadata file."""
    df.write.parquet(f"{path}/tokens")
    df.sparkSession.createDataFrame([(dict(meta),)], "meta map<string, string>").coalesce(1).write.json(f"{path}/metadata")


def read_cache(spark: SparkSession, path: str, **meta: str) -> DataFrame:
    """The cached tokens; fails if they are missing or were made with other settings."""
    found = spark.read.schema("meta map<string, string>").json(f"{path}/metadata").first()
    for k, v in meta.items():
        if not found or found.meta.get(k) != v:
            raise ValueError(f"the cache was made with {k} = {found.meta.get(k) if found else None}, not {v}")
    return spark.read.parquet(f"{path}/tokens")


def texts(spark: SparkSession, values: list[str]) -> DataFrame:
    """Texts given by hand, numbered."""
    return spark.createDataFrame(list(enumerate(values)), "id int, text string")
