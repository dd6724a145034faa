"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

Inputs of a document: its distinct words hashed to 2^15 columns (damped counts,
normalised), a one-hot bin of each structure statistic, and a bin of its length as
the only metadata. The score is the logistic of
    w0 + sum w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2),
linear time by the sum-of-squares identity. Labels, ids, languages and sources are
never inputs. The model is fitted at the driver on at most `sample` labelled rows
(those with the least seeded hash of their id) of at most `longest` bytes; everything
else covers all rows.

Cases: a null text scores as the empty text; empty texts have a score; a null
doc_id is never held out and never used to fit; rows that repeat score alike; an
empty table gives no rows; without labels every score is the prior 0.5; extra
columns are kept by `score` but for one named score, which it replaces.
"""

from __future__ import annotations

import sys

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.shared import ByteHash, joined, pieces, utf8, word_spans

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WORD_COLUMNS = 1 << 15
BINS = 16
FACTORS = 4
#: The most labelled rows the model is fitted on.
SAMPLE = 12_000
#: Labelled texts of more bytes are not fitted on, which bounds what the driver holds; they are scored like any other.
LONGEST = 1 << 18
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_UPPER = np.zeros(256, bool)
_UPPER[0x41:0x5B] = True
_LETTER = _UPPER.copy()
_LETTER[0x61:0x7B] = True
_LETTER[0x80:] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[0x30:0x3A] = True
_MARK = np.zeros(256, bool)  # full stops, commas and the like, as prose has them
_MARK[[ord(c) for c in ".,;:?!'\"-()"]] = True
_OTHER = ~(_SPACE | _LETTER | _DIGIT | _MARK)
_STATS = 12
COLUMNS = WORD_COLUMNS + BINS * _STATS


def _share(x: np.ndarray) -> np.ndarray:
    """Bins of a share in [0, 1], finer near 0: 0, then a bin for each halving from 2^-12 up."""
    return np.where(x <= 0, 0, np.clip(np.floor(np.log2(np.maximum(x, 1e-9)) + 14), 1, BINS - 1)).astype(np.int64)


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Columns, values and the first entry of each text (one more for the end)."""
    n = len(texts)
    data, at = joined(texts)
    starts, ends = word_spans(data, _SPACE)
    h = ByteHash(data).of(starts, ends)
    first = np.searchsorted(starts, at)
    doc = np.repeat(np.arange(n), np.diff(first))
    words = np.diff(first)
    some = np.maximum(words, 1)
    size = np.maximum(np.diff(at) - 1, 1)

    def per_text(mask: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(data) + 1, np.int64)
        np.cumsum(mask, out=sums[1:])
        return np.diff(sums[at])

    def per_word(mask: np.ndarray) -> np.ndarray:
        return np.bincount(doc, mask, n)

    sums = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_OTHER[data], out=sums[1:])
    odd = sums[ends] - sums[starts] > 0  # words with a sign that prose lacks
    np.cumsum(_LETTER[data], out=sums[1:])
    letters = sums[ends] - sums[starts]
    np.cumsum(_UPPER[data], out=sums[1:])
    loud = (letters > 1) & (sums[ends] - sums[starts] > 1)  # two capitals and more
    last = data[ends - 1]
    stop = _MARK[last]
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    # distinct words with their counts
    order = np.lexsort((h, doc))
    sd, sh = doc[order], h[order]
    new = np.ones(len(sd), bool)
    new[1:] = (sd[1:] != sd[:-1]) | (sh[1:] != sh[:-1])
    where = np.flatnonzero(new)
    count = np.diff(np.append(where, len(sd)))
    owner, column = sd[where], (sh[where] & np.uint64(WORD_COLUMNS - 1)).astype(np.int64)
    value = np.log1p(count)
    norm = np.sqrt(np.bincount(owner, value**2, n))
    value = value / np.maximum(norm[owner], 1e-9)
    distinct = np.bincount(owner, minlength=n)
    most = np.zeros(n)
    np.maximum.at(most, owner, count)
    stats = [
        _share(per_text(_UPPER[data]) / size), _share(per_text(_DIGIT[data]) / size), _share(per_text(_OTHER[data]) / size), _share(per_word(odd) / some), _share(per_word(loud) / some),
        _share(per_word(again) / some), _share(per_word(stop) / some), np.clip((15 * distinct / some).astype(np.int64), 0, BINS - 1), np.clip((15 * most / some).astype(np.int64), 0, BINS - 1),
        np.clip((np.bincount(doc, ends - starts, n) / some).astype(np.int64), 0, BINS - 1), np.clip(np.log2(words + 1).astype(np.int64), 0, BINS - 1), np.clip(np.log2(size + 1).astype(np.int64) - 2, 0, BINS - 1),
    ]
    side = np.stack([WORD_COLUMNS + BINS * i + s for i, s in enumerate(stats)], 1)
    owner = np.concatenate([owner, np.repeat(np.arange(n), _STATS)])
    column = np.concatenate([column, side.ravel()])
    value = np.concatenate([value, np.full(n * _STATS, 0.5)])
    order = np.argsort(owner, kind="stable")
    return column[order], value[order], np.searchsorted(owner[order], np.arange(n + 1))


class FactorisationMachine:
    """Weights and the linear-time score; fitted by AdaGrad on the logistic loss."""

    def __init__(self, columns: int = COLUMNS, factors: int = FACTORS, seed: int = 7):
        self.w0 = 0.0
        self.w = np.zeros(columns, np.float64)
        self.v = np.random.default_rng(seed).normal(0, 0.02, (columns, factors))

    def raw(self, column: np.ndarray, value: np.ndarray, at: np.ndarray) -> np.ndarray:
        doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
        n = len(at) - 1
        out = self.w0 + np.bincount(doc, self.w[column] * value, n)
        for f in range(self.v.shape[1]):
            x = self.v[column, f] * value
            out += 0.5 * (np.bincount(doc, x, n) ** 2 - np.bincount(doc, x**2, n))
        return out

    def fit(self, column, value, at, label, rounds: int = 12, batch: int = 256, rate: float = 0.15, shrink: float = 1e-5, seed: int = 7) -> FactorisationMachine:
        n = len(label)
        if not n:
            return self
        g0, gw, gv = 1e-6, np.full(self.w.shape, 1e-6), np.full(self.v.shape, 1e-6)
        share = np.clip(label.mean(), 0.02, 0.98)
        weight = np.where(label > 0, 0.5 / share, 0.5 / (1 - share))  # both classes count alike
        rng = np.random.default_rng(seed)
        for _ in range(rounds):
            for ids in np.array_split(rng.permutation(n), max(1, n // batch)):
                size = (at[1:] - at[:-1])[ids]
                doc = np.repeat(np.arange(len(ids)), size)
                entry = np.repeat(at[ids], size) + np.arange(len(doc)) - np.repeat(np.cumsum(size) - size, size)
                c, x = column[entry].astype(np.int64), value[entry].astype(np.float64)
                sums = np.stack([np.bincount(doc, self.v[c, f] * x, len(ids)) for f in range(self.v.shape[1])], 1)
                score = self.raw(c, x, np.append(0, np.cumsum(size)))
                err = (1 / (1 + np.exp(-np.clip(score, -30, 30))) - label[ids]) * weight[ids] / len(ids)
                cols, which = np.unique(c, return_inverse=True)
                e = err[doc] * x
                dw = np.bincount(which, e, len(cols)) + shrink * self.w[cols]
                dv = np.stack([np.bincount(which, e * (sums[doc, f] - self.v[c, f] * x), len(cols)) for f in range(self.v.shape[1])], 1) + shrink * self.v[cols]
                g0 += err.sum() ** 2
                gw[cols] += dw**2
                gv[cols] += dv**2
                self.w0 -= rate * err.sum() / np.sqrt(g0)
                self.w[cols] -= rate * dw / np.sqrt(gw[cols])
                self.v[cols] -= 0.2 * rate * dv / np.sqrt(gv[cols])
        return self

    def score(self, texts: list[bytes]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(*features(texts)), -30, 30)))


def _vectors(docs: DataFrame) -> DataFrame:
    """Features of few rows, for the driver: label and packed columns and values."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            texts = utf8(b.column("text"))
            out = []
            for lo, hi in pieces(texts):
                c, x, at = features(texts[lo:hi])
                out += [(c[i:j].astype(np.uint32).tobytes(), x[i:j].astype(np.float32).tobytes()) for i, j in zip(at, at[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([b.column("k"), b.column("label"), pa.array([o[0] for o in out], pa.binary()), pa.array([o[1] for o in out], pa.binary())], ["k", "label", "c", "x"])

    return docs.select("k", F.col("label").cast("int"), "text").mapInArrow(run, "k long, label int, c binary, x binary")


def held_out() -> F.Column:
    """Whether a row's id is kept out of fitting."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE, longest: int = LONGEST) -> FactorisationMachine:
    """A model of labels.`label`, from the labelled rows that are not held out."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max(label).alias("label"))
    chosen = known.withColumn("k", F.xxhash64("doc_id", F.lit("quality"))).orderBy("k", "doc_id").limit(sample)
    chosen = F.broadcast(chosen)  # at most `sample` rows
    # should an id repeat, its least text stands for it
    rows = _vectors(docs.select("doc_id", "text").where(F.coalesce(F.octet_length("text"), F.lit(0)) <= longest).join(chosen, "doc_id")).groupBy("k").agg(F.min(F.struct("c", "x", "label")).alias("r")).select("k", "r.*")
    c, x, at, label = packed(rows)
    return FactorisationMachine().fit(c, x, at, label)


def packed(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Columns, values, first entries and labels of few rows by k. They come part by part, and each value stays in its four bytes, so the driver holds little more than these arrays."""
    got, c, x = [], bytearray(), bytearray()
    for r in rows.coalesce(8).toLocalIterator():
        got.append((r.k, len(c) // 4, len(r.c) // 4, r.label))
        c += r.c
        x += r.x
    got.sort()
    at = np.append(0, np.cumsum([n for _, _, n, _ in got])).astype(np.int64)
    out = np.empty(at[-1], np.uint32), np.empty(at[-1], np.float32)
    for to, raw in zip(out, (np.frombuffer(bytes_, to.dtype) for to, bytes_ in zip(out, (c, x), strict=True)), strict=True):
        for (_, first, n, _), begin in zip(got, at, strict=False):
            to[begin : begin + n] = raw[first : first + n]
    return *out, at, np.array([label for *_, label in got], np.float64)


def _scored(docs: DataFrame, model: FactorisationMachine) -> DataFrame:
    """row (the columns of docs) and score."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), "text")
    light = FactorisationMachine.__new__(FactorisationMachine)
    light.w0, light.w, light.v = float(model.w0), model.w.astype(np.float32), model.v.astype(np.float32)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            texts = utf8(b.column("text"))
            for lo, hi in pieces(texts):
                yield pa.RecordBatch.from_arrays([b.column("row").slice(lo, hi - lo), pa.array(light.score(texts[lo:hi]), pa.float64())], ["row", "score"])

    return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, score double")


def score(docs: DataFrame, model: FactorisationMachine) -> DataFrame:
    """docs with score, the model's probability of label 1."""
    return _scored(docs, model).select(*[F.col("row")[c].alias(c) for c in docs.columns if c != "score"], "score")


#: Rows under this score are rejected.
THRESHOLD = 0.3


def quality_query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score(docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def good_docs(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the classifier keeps, their columns as they were."""
    return _scored(docs, fit(docs, labels)).where(F.col("score") >= THRESHOLD).select("row.*")
