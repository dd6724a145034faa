"""Embedding whitening over an exact integer scatter.

An entry c becomes the integer x = floor(1024 * c) + 100000. Tasks subtract the shift
again, split what is left into limbs of 20 bits and add up sums and cross-products in
Python's integers, so no addition rounds and none overflows. The tasks' totals, cut
into limbs of 62 bits, meet in one aggregation by matrix entry. n * XᵀX - SSᵀ is formed
exactly (a shift changes neither it nor n * x - S); only then it becomes floating point,
correctly rounded, and is decomposed by eigh. Nothing but the matrix, whose size is the
square of the dimensions, reaches the driver.

Cases: a null vector and one with null or non-finite entries are dropped; so are
vectors, empty ones among them, whose length is not the most frequent one (of equally
frequent lengths the longest). Entries beyond 2^61 count as 2^61 with their sign. Rows
that repeat, and rows without vec_id, count and return as often as they occur.
Components whose eigenvalue is below 1e-12 of the trace do not exist: equal vectors, or
a single one, have no component and no rows; an empty table has none. Components of
equal eigenvalues span the same space in any order. Extra columns are ignored.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.shared import written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCALE, SHIFT = 1024, 100_000
#: Rows of one exact product: 2^12 products of two limbs of 20 bits stay below 2^53.
BLOCK, LIMB = 1 << 12, 20
#: Integers beyond this are held at it.
MOST = 1 << 61
#: Bits of a limb that travels, and the share of the trace below which an eigenvalue counts as zero.
WIRE, LEAST = 62, 1e-12


def shifted(entries: np.ndarray) -> np.ndarray:
    """x - SHIFT of double entries, as int64."""
    return np.clip(np.floor(entries * SCALE), -MOST, MOST).astype(np.int64)


def limbs(y: np.ndarray) -> list[np.ndarray]:
    """Signed limbs as float64, least first: y = sum of limb k * 2^(20 k)."""
    out = []
    while True:
        low = y & ((1 << LIMB) - 1)
        y = y >> LIMB
        carry = low >> (LIMB - 1)  # limbs from -2^19 to 2^19 - 1
        out.append((low - (carry << LIMB)).astype(np.float64))
        y = y + carry
        if not y.any():
            return out


def products(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums and cross-products of int64 rows as Python integers, exact."""
    parts = limbs(y)
    sums, cross = np.zeros(y.shape[1], object), np.zeros((y.shape[1], y.shape[1]), object)
    for i, a in enumerate(parts):
        sums += a.sum(0).astype(np.int64).astype(object) << (LIMB * i)
        for j, b in enumerate(parts):
            cross += (a.T @ b).astype(np.int64).astype(object) << (LIMB * (i + j))
    return sums, cross


def finite_vectors(rows: DataFrame, vector: str = "embedding", key: str = "vec_id") -> tuple[DataFrame, int]:
    """vec_id and entries (doubles) of the rows that remain, and their length; a vector of 0 means none do."""
    good = rows.select(F.col(key).alias("vec_id"), F.col(vector).cast("array<double>").alias("entries"))
    odd = F.exists("entries", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    good = good.where(F.col("entries").isNotNull() & ~odd)
    most = good.groupBy(F.size("entries").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    d = most["d"] if most else 0
    return good.where(F.size("entries") == d), d


def matrix_of(column, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


@dataclass
class Scatter:
    """Exact totals of the shifted vectors: their number, sums and cross-products, in Python's integers."""

    n: int
    sums: np.ndarray
    cross: np.ndarray

    def moment(self) -> np.ndarray:
        """n * XᵀX - SSᵀ, exact."""
        return self.n * self.cross - np.multiply.outer(self.sums, self.sums)

    def covariance(self) -> np.ndarray:
        """Divisor n; each entry rounded once."""
        m, over = self.moment(), self.n * self.n
        return np.array([[int(v) / over for v in row] for row in m], np.float64).reshape(m.shape)

    def components(self, most: int) -> tuple[np.ndarray, np.ndarray, float]:
        """Eigenvalues, falling, their unit eigenvectors as columns, and the trace; each vector's largest entry is positive."""
        v = self.covariance()
        trace = float(sum(int(x) for x in np.diag(self.moment())) / (self.n * self.n)) if self.n else 0.0
        if not trace:
            return np.zeros(0), np.zeros((len(v), 0)), trace
        values, vectors = np.linalg.eigh(v)
        keep = np.argsort(-values, kind="stable")[:most]
        keep = keep[values[keep] > LEAST * trace]
        values, vectors = values[keep], vectors[:, keep]
        largest = vectors[np.abs(vectors).argmax(0), np.arange(len(keep))]
        return values, vectors * np.where(largest < 0, -1.0, 1.0), trace


def scatter(good: DataFrame, d: int) -> Scatter:
    """The exact scatter of `finite_vectors`; tasks send their totals by matrix entry."""

    def run(batches):
        import pyarrow as pa

        n, sums, cross = 0, np.zeros(d, object), np.zeros((d, d), object)
        for b in batches:
            y = shifted(matrix_of(b.column("entries"), d))
            for at in range(0, len(y), BLOCK):
                s, c = products(y[at : at + BLOCK])
                n, sums, cross = n + len(y[at : at + BLOCK]), sums + s, cross + c
        if n:
            out = [(-1, 0, 0, n)]
            for i in range(d):
                entries = [(-1, sums[i]), *((j, cross[i, j]) for j in range(i + 1))]
                for j, v in entries:
                    sign, v, k = (-1 if v < 0 else 1), abs(int(v)), 0
                    while v:
                        out.append((i, j, k, sign * (v & ((1 << WIRE) - 1))))
                        v, k = v >> WIRE, k + 1
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True)], ["i", "j", "k", "v"])

    totals = good.select("entries").mapInArrow(run, "i int, j int, k int, v long").groupBy("i", "j", "k").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
    found = Scatter(0, np.zeros(d, object), np.zeros((d, d), object))
    for i, j, k, v in totals.collect():  # at most d * (d + 3) / 2 entries of a few limbs
        v = int(v) << (WIRE * k)
        if i < 0:
            found.n += v
        elif j < 0:
            found.sums[i] += v
        else:
            found.cross[i, j] += v
            if i != j:
                found.cross[j, i] += v
    return found


def whitened_rows(good: DataFrame, d: int, found: Scatter, values: np.ndarray, vectors: np.ndarray) -> DataFrame:
    """vec_id, deviation (exact, as decimal digits) and the whitened vector of every row."""
    n, sums = found.n, np.array([int(s) for s in found.sums], object)
    weights = vectors / np.sqrt(values)
    near = int(max(map(abs, sums), default=0))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            if not b.num_rows:
                continue
            y = shifted(matrix_of(b.column("entries"), d))
            furthest = n * int(max(abs(int(y.max())), abs(int(y.min())))) + near
            if d * furthest * furthest < 1 << 62:
                far = n * y - sums.astype(np.int64)
                deviation = (far * far).sum(1)
            else:
                far = n * y.astype(object) - sums
                deviation = (far * far).sum(1)
            centred = np.array(far / n, np.float64) if far.dtype != object else np.array([[int(v) / n for v in r] for r in far], np.float64)
            z = centred @ weights
            flat = pa.array(z.reshape(-1))
            ends = pa.array(np.arange(len(z) + 1, dtype=np.int32) * z.shape[1])
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array([str(int(v)) for v in deviation], pa.string()), pa.ListArray.from_arrays(ends, flat)], ["vec_id", "deviation", "z"])

    kind = good.schema["vec_id"].dataType.simpleString()
    return good.mapInArrow(run, f"vec_id {kind}, deviation string, z array<double>")


def whiten(rows: DataFrame, most: int = 8, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """vec_id, component, n, deviation (decimal digits), whitened, explained, identity_error: a row for each vector and component."""
    good, d = finite_vectors(rows, vector, key)
    kind = good.schema["vec_id"].dataType.simpleString()
    none = rows.sparkSession.createDataFrame([], f"vec_id {kind}, component int, n long, deviation string, whitened double, explained double, identity_error double")
    if not d:
        return none
    found = scatter(good, d)
    values, vectors, trace = found.components(most)
    if not len(values):
        return none
    z = written(whitened_rows(good, d, found, values, vectors), "whitening")
    places = [(i, j) for i in range(len(values)) for j in range(i + 1)]
    # covar_pop centres before it multiplies, and merges its tasks' parts
    cov = z.agg(*[F.covar_pop(F.get("z", F.lit(i)), F.get("z", F.lit(j))).alias(f"c{i}_{j}") for i, j in places]).first()
    error = max(abs(c - (i == j)) for (i, j), c in zip(places, cov, strict=True))
    shares = F.array(*[F.lit(float(v / trace)) for v in values])
    out = z.select("vec_id", "deviation", F.posexplode("z").alias("at", "whitened"))
    return out.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(found.n).cast("long").alias("n"), "deviation", "whitened", F.get(shares, F.col("at")).alias("explained"), F.lit(float(error)).alias("identity_error"))


def whitening_query(rows: DataFrame) -> DataFrame:
    """The contract's columns; a deviation beyond 64 bits is null in `deviation` and whole in `deviation_digits`."""
    out = whiten(rows)
    return out.select("vec_id", "component", "n", F.expr("try_cast(deviation AS bigint)").alias("deviation"), "whitened", "explained", "identity_error", F.col("deviation").alias("deviation_digits"))
