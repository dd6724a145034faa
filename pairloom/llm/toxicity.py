"""Toxicity: a classifier chain of linear models.

Categories, in the order of the chain: `kind1` to `kind3`, kinds of toxic language, then
`toxic`, the label itself, which is the answer. Only `toxic` is labelled by hand. Words
and stems that tell toxic rows from others are put into three groups by the rows they
share, and a row is of a kind if it is toxic and holds something of that group.

Each category has a logistic model over a document's distinct hashed words and word
stems and over the probabilities of the categories before it. The link of
`toxic` does not see the words that make up the kinds: it knows of them by the
probabilities of the kinds alone. Models learn earlier probabilities as predicted out
of fold: each fold's rows are scored by models, words chosen, of the other folds, so a
later model learns from the errors it will meet. All are fitted at the driver on at
most `sample` labelled rows (with the least seeded hash of their id) of at most `longest`
bytes, read whole; every
document is scored over its whole text.

Cases: null and empty texts score as texts without words; a null doc_id is scored,
never used to fit; rows that repeat score alike; an empty table gives no rows; with no
labels every probability is 0; extra columns are kept by `score` unless named like one
of its own, which it replaces.
"""

from __future__ import annotations

import sys

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.shared import ByteHash, joined, pieces, utf8, word_spans

cloudpickle.register_pickle_by_value(sys.modules[__name__])

KINDS = 3
CATEGORIES = (*[f"kind{k + 1}" for k in range(KINDS)], "toxic")
STEMS = (4, 5, 6)
FOLDS = 5
SAMPLE = 6_000
#: Labelled texts of more bytes are not fitted on, which bounds what the driver holds; they are scored like any other.
LONGEST = 1 << 18
#: Standard errors beyond which a column is more than chance among some millions of them.
SURE = 5.0
#: What earlier probabilities are multiplied by as inputs, so that they are learned as fast as words.
SCALE = 8.0
#: Columns that a model of the chain has at most.
COLUMNS = 4_096
OWN = (*[f"p_{c}" for c in CATEGORIES], *[f"is_{c}" for c in CATEGORIES], "n_telling")
_BREAK = np.ones(256, bool)  # what is no letter or digit, in ASCII
_BREAK[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct columns of each text, and the first entry of each text (one more for the end)."""
    data, at = joined([t.lower() for t in texts])
    starts, ends = word_spans(data, _BREAK)
    hashes = ByteHash(data)
    first = np.searchsorted(starts, at)
    doc = np.repeat(np.arange(len(texts)), np.diff(first))
    all_h, all_d = [hashes.of(starts, ends)], [doc]
    for n in STEMS:
        long = np.flatnonzero(ends - starts > n)
        all_h.append(hashes.of(starts[long], starts[long] + n) ^ np.uint64(0x5851F42D4C957F2D * n & (1 << 64) - 1))
        all_d.append(doc[long])
    column = np.concatenate(all_h) >> np.uint64(32)  # 32 bits, so that chance hits are rare
    key = np.unique(np.concatenate(all_d).astype(np.uint64) << np.uint64(32) | column)
    owner = (key >> np.uint64(32)).astype(np.int64)
    return (key & np.uint64((1 << 32) - 1)).astype(np.int64), np.searchsorted(owner, np.arange(len(texts) + 1))


class Linear:
    """A logistic model over chosen columns, with further dense inputs."""

    def __init__(self, columns: np.ndarray):
        self.columns = np.sort(columns)
        self.w = np.zeros(len(columns))
        self.dense = np.zeros(0)
        self.bias = 0.0

    def rows(self, column: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(document, position among the chosen columns) of the entries that are chosen."""
        doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
        if not len(self.columns):
            return doc[:0], doc[:0]
        i = np.minimum(np.searchsorted(self.columns, column), len(self.columns) - 1)
        hit = self.columns[i] == column
        return doc[hit], i[hit]

    def raw(self, doc, which, n: int, dense: np.ndarray) -> np.ndarray:
        return self.bias + np.bincount(doc, self.w[which], n) + dense @ self.dense

    def fit(self, column, at, dense: np.ndarray, label: np.ndarray, steps: int = 150, rate: float = 0.3, shrink: float = 1e-4) -> Linear:
        n = len(label)
        doc, which = self.rows(column, at)
        self.dense = np.zeros(dense.shape[1])
        share = min(max(label.mean(), 1e-3), 0.999) if n else 0.5
        self.bias = float(np.log(share / (1 - share)))
        weight = np.where(label > 0, 0.5 / share, 0.5 / (1 - share)) / max(n, 1)
        gw, gd, gb = np.full(self.w.shape, 1e-8), np.full(self.dense.shape, 1e-8), 1e-8
        for _ in range(steps):
            err = (self.probability(doc, which, n, dense) - label) * weight
            dw = np.bincount(which, err[doc], len(self.w)) + shrink * self.w
            dd = err @ dense + shrink * self.dense
            gw += dw**2
            gd += dd**2
            gb += err.sum() ** 2
            self.w -= rate * dw / np.sqrt(gw)
            self.dense -= rate * dd / np.sqrt(gd)
            self.bias -= rate * err.sum() / np.sqrt(gb)
        return self

    def probability(self, doc, which, n: int, dense: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(doc, which, n, dense), -30, 30)))


def _held(column: np.ndarray, at: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Columns, and how many rows with and without the label hold each."""
    doc = np.repeat(np.arange(len(label)), np.diff(at))
    cols, which = np.unique(column, return_inverse=True)
    return cols, np.bincount(which, label[doc] > 0, len(cols)), np.bincount(which, label[doc] <= 0, len(cols))


def chosen(column: np.ndarray, at: np.ndarray, label: np.ndarray, against: bool = True, odds: float = 16.0, most: int = COLUMNS) -> np.ndarray:
    """Columns held `odds` times oftener with the label than without it (or, `against`, the other way round), and surely so."""
    cols, held, other = _held(column, at, label)
    pos, neg = max((label > 0).sum(), 1), max((label <= 0).sum(), 1)
    share = (held + other + 0.5) / (pos + neg + 1)
    z = np.abs(held / pos - other / neg) / np.sqrt(share * (1 - share) * (1 / pos + 1 / neg))
    tells = held / pos > odds * (other + 0.5) / neg
    if against:
        tells |= other / neg > odds * (held + 0.5) / pos
    known = np.flatnonzero(tells & (z > SURE))
    return np.sort(cols[known[np.lexsort((cols[known], -z[known]))[:most]]])


def grouped(cols: np.ndarray, column: np.ndarray, at: np.ndarray, label: np.ndarray, groups: int = KINDS) -> np.ndarray:
    """A group for each of the columns, by the labelled rows that hold them: spherical k-means from far-apart columns."""
    doc = np.repeat(np.arange(len(label)), np.diff(at))
    if not len(cols):
        return np.zeros(0, np.int64)
    i = np.minimum(np.searchsorted(cols, column), len(cols) - 1)
    hit = (cols[i] == column) & (label[doc] > 0)
    rows = np.cumsum(label > 0) - 1
    x = np.zeros((len(cols), int((label > 0).sum())), np.float32)
    x[i[hit], rows[doc[hit]]] = 1
    weight = x.sum(1)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    seeds = [int(np.argmax(weight))]
    while len(seeds) < min(groups, len(cols)):  # frequent, and unlike the seeds so far
        seeds.append(int(np.argmax(weight * (1 - (x @ x[seeds].T).max(1)))))
    centre = x[seeds]
    for _ in range(10):
        own = np.argmax(x @ centre.T, 1)
        centre = np.stack([x[own == k].sum(0) if (own == k).any() else centre[k] for k in range(len(centre))])
        centre /= np.maximum(np.linalg.norm(centre, axis=1, keepdims=True), 1e-9)
    return np.argmax(x @ centre.T, 1)


class Chain:
    """The fitted chain; `oof` has the probabilities, out of fold, that later links learned from, `fold` each row's fold."""

    def __init__(self):
        self.telling = np.zeros(0, np.int64)
        self.models: list[Linear] = []

    @classmethod
    def fit(cls, column, at, label, folds: int = FOLDS) -> Chain:
        out, n = cls(), len(label)
        if not n or not (label > 0).any():
            return out
        out.fold = np.random.default_rng(11).permutation(n) % folds
        doc = np.repeat(np.arange(n), np.diff(at))

        def part(ids: np.ndarray, entries: np.ndarray | None = None):
            mine = np.zeros(n, bool)
            mine[ids] = True
            keep = mine[doc] if entries is None else mine[doc] & entries
            return column[keep], np.append(0, np.cumsum(np.bincount(doc[keep], minlength=n)[ids]))

        out.telling = chosen(column, at, label, against=False)
        group = grouped(out.telling, column, at, label)
        place = np.minimum(np.searchsorted(out.telling, column), max(len(out.telling) - 1, 0))
        tells = out.telling[place] == column if len(out.telling) else np.zeros(len(column), bool)
        weak = np.zeros((n, len(CATEGORIES)))
        for k in range(KINDS):
            hit = np.flatnonzero(tells)[group[place[tells]] == k]
            weak[doc[hit], k] = label[doc[hit]]
        weak[:, -1] = label
        out.oof = np.zeros((n, 0))
        for j, name in enumerate(CATEGORIES):
            # the last link sees no word of the kinds
            last = name == "toxic"
            seen = ~tells if last else None
            before, oof = SCALE * out.oof, np.zeros(n)
            for k in range(folds):
                rest, own = np.flatnonzero(out.fold != k), np.flatnonzero(out.fold == k)
                c, a = part(rest, seen)
                model = Linear(chosen(c, a, label[rest], against=last)).fit(c, a, before[rest], weak[rest, j])
                c, a = part(own, seen)
                oof[own] = model.probability(*model.rows(c, a), len(own), before[own])
            c, a = part(np.arange(n), seen)
            out.models.append(Linear(chosen(c, a, label, against=last)).fit(c, a, before, weak[:, j]))
            out.oof = np.column_stack([out.oof, oof])
        return out

    def score(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities of all categories, and how many telling columns a text holds."""
        column, at = features(texts)
        p = np.zeros((len(texts), 0))
        if not self.models:
            return np.zeros((len(texts), len(CATEGORIES))), np.zeros(len(texts), np.int64)
        for model in self.models:
            p = np.column_stack([p, model.probability(*model.rows(column, at), len(texts), SCALE * p)])
        doc = np.repeat(np.arange(len(texts)), np.diff(at))
        return p, np.bincount(doc[np.isin(column, self.telling)], minlength=len(texts))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE, longest: int = LONGEST) -> Chain:
    """A chain of the labelled rows."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    some = F.broadcast(known.withColumn("k", F.xxhash64("doc_id", F.lit("toxicity"))).orderBy("k", "doc_id").limit(sample))  # at most `sample` rows

    def run(batches):
        import pyarrow as pa

        for b in batches:
            texts = utf8(b.column("text"))
            out = []
            for lo, hi in pieces(texts):
                c, at = features(texts[lo:hi])
                out += [c[i:j].astype(np.uint32).tobytes() for i, j in zip(at, at[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([b.column("k"), b.column("label"), pa.array(out, pa.binary())], ["k", "label", "c"])

    rows = docs.select("doc_id", "text").where(F.coalesce(F.octet_length("text"), F.lit(0)) <= longest).join(some, "doc_id").select("k", "label", "text").mapInArrow(run, "k long, label int, c binary")
    # a repeated id counts once
    rows = rows.groupBy("k").agg(F.min(F.struct("c", "label")).alias("r")).select("k", "r.*").collect()
    rows.sort(key=lambda r: r.k)
    column = np.frombuffer(b"".join(r.c for r in rows), np.uint32).astype(np.int64)
    at = np.append(0, np.cumsum([len(r.c) // 4 for r in rows])).astype(np.int64)
    return Chain.fit(column, at, np.array([r.label for r in rows], np.float64))


def score(docs: DataFrame, chain: Chain, threshold: float = 0.5) -> DataFrame:
    """docs with p_<category>, is_<category> and n_telling."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), "text")
    small = Chain()
    small.telling, small.models = chain.telling, chain.models

    def run(batches):
        import pyarrow as pa

        for b in batches:
            texts = utf8(b.column("text"))
            for lo, hi in pieces(texts):
                p, n = small.score(texts[lo:hi])
                cols = [pa.array(p[:, i], pa.float64()) for i in range(len(CATEGORIES))] + [pa.array(p[:, i] >= threshold, pa.bool_()) for i in range(len(CATEGORIES))]
                yield pa.RecordBatch.from_arrays([b.column("row").slice(lo, hi - lo), *cols, pa.array(n.astype(np.int64), pa.int64())], ["row", *OWN])

    kinds = ", ".join([*[f"p_{c} double" for c in CATEGORIES], *[f"is_{c} boolean" for c in CATEGORIES], "n_telling long"])
    out = rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, {kinds}")
    return out.select(*[F.col("row")[c].alias(c) for c in docs.columns if c not in OWN], *OWN)


def toxicity_query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score(docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select("doc_id", *[f"p_{c}" for c in CATEGORIES], *[F.col(f"is_{c}").cast("int").alias(f"is_{c}") for c in CATEGORIES], "n_telling", F.col("is_toxic").cast("int").alias("predicted"))
