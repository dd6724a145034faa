"""Token columns: a native byte tokenizer, and subword tokenizers of given files through Arrow."""

from collections.abc import Callable
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairloom.functions import text

#: Ids below this are special: pad 0, end 1, unknown 2.
OFFSET = 3


def byte_ids(c: Column | str, most: int = 512) -> Column:
    """UTF-8 bytes plus OFFSET, then the end id, cut to `most` ids."""

    def ids(h: Column) -> Column:
        n = F.least((F.length(h) / 2).cast("int"), F.lit(most - 1))
        own = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.conv(F.substring(h, i * 2 + 1, F.lit(2)), 16, 10).cast("int") + OFFSET)
        return F.concat(F.when(n < 1, F.array().cast("array<int>")).otherwise(own), F.array(F.lit(1)))

    return text.let(F.hex(F.encode(text.col(c), "UTF-8")), ids)


def padded(ids: Column, most: int, pad: int = 0) -> tuple[Column, Column]:
    """Ids cut, or padded on the right, to a length, and their attention mask."""
    own = F.slice(ids, 1, most)
    rest = F.lit(most) - F.size(own)
    return F.concat(own, F.array_repeat(F.lit(pad), rest)), F.concat(F.array_repeat(F.lit(1), F.size(own)), F.array_repeat(F.lit(0), rest))


def tokenise(pairs: DataFrame, *key: str, source: str = "source_text", target: str = "target_text", most: int = 128, least: tuple[int, int] = (5, 2)) -> DataFrame:
    """input_ids, attention_mask, labels of rows whose source and target have more than the least tokens."""
    rows = pairs.select(*key, byte_ids(source, most).alias("s"), byte_ids(target, most).alias("labels")).where((F.size("s") > least[0]) & (F.size("labels") > least[1]))
    ids, mask = padded(F.col("s"), most)
    return rows.select(*key, ids.alias("input_ids"), mask.alias("attention_mask"), "labels")


def _tokenizer(path: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True  # their names in a text are ordinary text
    return tokenizer


#: Bytes of text, or ids, that a tokenizer gets at a time: its results take some hundred times as much memory as the texts.
PIECE = 1 << 18


def _runs(sizes: list[int], most: int = PIECE) -> Iterator[slice]:
    """Rows that follow one another and have at most so much in all, or a single larger row."""
    first, total = 0, 0
    for i, n in enumerate(sizes):
        if i > first and total + n > most:
            yield slice(first, i)
            first, total = i, 0
        total += n
    if first < len(sizes):
        yield slice(first, len(sizes))


def subword_ids(path: str, most: int | None = 512) -> Callable[[Column], Column]:
    """A column function for the tokenizer file at a path that all machines can read; null is empty, `most` truncates."""

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokenizer = _tokenizer(path)
        for s in batches:
            texts = s.fillna("").tolist()
            for r in _runs([4 * len(t) for t in texts]):
                yield pd.Series([np.array(e.ids[:most], np.int32) for e in tokenizer.encode_batch(texts[r], add_special_tokens=False)], dtype="object")

    return ids


def subword_text(path: str) -> Callable[[Column], Column]:
    """A column function from token ids back to text."""

    @F.pandas_udf("string")
    def text_(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokenizer = _tokenizer(path)
        for s in batches:
            for r in _runs([len(x) for x in s]):
                yield pd.Series(tokenizer.decode_batch([x.tolist() for x in s.iloc[r]], skip_special_tokens=False), dtype="object")

    return text_


def corrected(df: DataFrame, column: str, make: Callable[[], Callable[[list[str]], list[str]]], name: str = "predicted") -> DataFrame:
    """Adds what a corrector writes. make() runs once a worker and returns a function of a list of texts.

    Blank texts are returned as they are; a batch that fails is returned as it came. Batches go through Python as a whole:
    Spark cannot evaluate a Python function of an expression with nested lambdas, as `column` may be.
    """
    kept = [c for c in df.columns if c != name]

    def run(batches):
        import pyarrow as pa

        correct = make()
        for b in batches:
            texts = b.column(column).to_pylist()
            work = [i for i, t in enumerate(texts) if t and t.strip()]
            try:
                found = correct([texts[i] for i in work])
            except Exception:  # noqa: BLE001 - a model may fail in any way
                found = [texts[i] for i in work]
            for i, t in zip(work, found, strict=True):
                texts[i] = t
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], pa.array(texts, pa.string())], [*kept, name])

    return df.mapInArrow(run, T.StructType([*[df.schema[c] for c in kept], T.StructField(name, T.StringType())]))
