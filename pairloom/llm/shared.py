"""What several operators need: the shared folder, written intermediate tables, row keys, word hashes.

Python code of this package that runs on executors is shipped by value, so that
workers need not have the package on their path.
"""

from __future__ import annotations

import atexit
import re
import shutil
import sys
import tempfile
import uuid

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: The words of all word-based contracts: runs of bytes other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: A side of a join is broadcast only when it was counted and has at most so many rows.
BROADCAST_ROWS = 200_000

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is set (tests)."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
            spark.sparkContext.setCheckpointDir(found)
        return found.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        path = tempfile.mkdtemp(prefix="pairloom-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        _own[app] = f"file://{path}"
        spark.sparkContext.setCheckpointDir(_own[app])
    return _own[app]


def new_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, below one folder for the application."""
    return f"{shared_dir(spark)}/pairloom/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df as a table in the shared folder: cuts the lineage and survives lost executors.

    Shuffle files of the plan go when the table is written: nothing else reads them.
    """
    spark, schema = df.sparkSession, df.schema
    path, before = new_path(spark, name), spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(schema).parquet(path)
    out.written_at = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete tables of `written` that no later step reads."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.written_at)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def let(value: Column, f) -> Column:
    """f(value), with value computed once however often f refers to it."""
    return F.get(F.transform(F.array(value), lambda v: f(v)), 0)


def row_key(text: str = "text", doc_id: str = "doc_id") -> Column:
    """A key (a, b) of 128 bits; rows with equal id and text have equal keys. A null differs from an empty text."""
    parts = [F.col(doc_id).isNull(), doc_id, F.col(text).isNull(), text]
    return F.struct(F.xxhash64(*parts, F.lit("row")).alias("a"), F.xxhash64(F.lit("second"), *parts).alias("b"))


def small(df: DataFrame, rows: int) -> DataFrame:
    """df marked for broadcast if its counted rows are within the bound."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


#: Keys that hold more than this part of all rows are hot; they are fewer than its inverse.
HOT_PART = 1e-5


def with_classes(rows: DataFrame, classes: DataFrame, key: str, count: str, total: int, n_classes: int | None = None) -> DataFrame:
    """rows with the columns of the one row of `classes` that has their key; `count` says how many of the `total` rows that is.

    Hot keys, fewer than 1 / HOT_PART of them, are joined by broadcast, so that no task gets all rows of one. So are all
    classes where they were counted, as `n_classes`, and are few.
    """
    if n_classes is not None and n_classes <= BROADCAST_ROWS:
        return rows.join(F.broadcast(classes), key)
    hot = F.col(count) > F.lit(max(total * HOT_PART, 1000.0))
    few, rest = classes.where(hot), classes.where(~hot)
    of_hot = rows.join(F.broadcast(few), key)
    return of_hot.unionByName(rows.join(F.broadcast(few.select(key)), key, "left_anti").join(rest, key))


# ---- word hashes over UTF-8 bytes (NumPy) ----

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Odd multipliers of the two polynomial lanes, for bytes and for words.
BYTE_BASE, WORD_BASES = 0x9E3779B97F4A7C15, (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 to base ** n; those up to 2 ** 21 are kept."""
    known = _powers.get(base)
    if known is None or len(known) <= n:
        known = np.full(max(n, min(2 * n, 1 << 21)) + 1, base, np.uint64)
        known[0] = 1
        np.multiply.accumulate(known, out=known)
        if n <= 1 << 21:
            _powers[base] = known
    return known[: n + 1]


def word_spans(data: np.ndarray, space: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes that are not `space`."""
    word = np.empty(len(data) + 2, bool)
    word[0] = word[-1] = False
    np.logical_not(space[data], out=word[1:-1])
    edge = np.flatnonzero(word[1:] != word[:-1])
    return edge[::2], edge[1::2]


class ByteHash:
    """Polynomial hashes, modulo 2^64, of any slices of one byte string: for columns of models, not to decide equality."""

    def __init__(self, data: np.ndarray):
        self.inverse = powers(pow(BYTE_BASE, -1, 1 << 64), len(data))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(BYTE_BASE, len(data))[:-1], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.inverse[starts] + (ends - starts).astype(np.uint64))


def rolling(words: np.ndarray, width: int, base: int) -> np.ndarray:
    """A hash of each `width` consecutive word hashes."""
    n = len(words)
    if n < width:
        return np.zeros(0, np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(mix(words ^ np.uint64(base)) * powers(base, n)[:-1], out=sums[1:])
    return mix((sums[width:] - sums[:-width]) * powers(pow(base, -1, 1 << 64), n)[: n - width + 1])


def pieces(texts: list[bytes], most: int = 1 << 19):
    """Runs (from, to) of consecutive texts with about `most` bytes each; one text is never split."""
    at = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield at, i
            at, size = i, 0
        size += len(t) + 1
    if at < len(texts):
        yield at, len(texts)


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes, a space after each, and the offset at which each begins (one more for the end)."""
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=at[1:])
    return np.frombuffer(b" ".join(texts) + b" ", np.uint8), at


_GAP = re.compile(rb"[\x20\x09-\x0D]")


def words_of(text: bytes, most: int = 4 << 20):
    """Lists of consecutive words of a text, of about `most` bytes each."""
    at = 0
    while at < len(text):
        end = min(at + most, len(text))
        gap = _GAP.search(text, end) if end < len(text) else None
        end = gap.start() if gap else len(text)
        yield text[at:end].split() if at or end < len(text) else text.split()
        at = end


def hashed_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """XXH3 of all words and, for each text, the index of its first word (one more for the end)."""
    from xxhash import xxh3_64_intdigest

    at, out = np.zeros(len(texts) + 1, np.int64), []
    for i, t in enumerate(texts):
        n = 0
        for words in words_of(t):
            out.append(np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words)))
            n += len(words)
        at[i + 1] = at[i] + n
    return np.concatenate(out) if out else np.zeros(0, np.uint64), at


def utf8(column) -> list[bytes]:
    """An Arrow string column as byte strings; null as empty."""
    import pyarrow as pa

    return [b or b"" for b in column.cast(pa.binary()).to_pylist()]
