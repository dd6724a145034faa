"""Whitening against plain Python integers and fractions."""

import math
from fractions import Fraction

import numpy as np
import pytest

from pairloom.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, n long, component string, z double"


def _brute(vectors):
    """Per row deviation, exact covariance over n."""
    xs = [[math.floor(1024 * float(np.float32(c))) + 100000 for c in v] for v in vectors]
    n, d = len(xs), len(xs[0])
    s = [sum(x[i] for x in xs) for i in range(d)]
    deviation = [sum((n * x[i] - s[i]) ** 2 for i in range(d)) for x in xs]
    mean = [Fraction(v, n) for v in s]
    v = [[float(sum((x[i] - mean[i]) * (x[j] - mean[j]) for x in xs) / n) for j in range(d)] for i in range(d)]
    return xs, mean, deviation, np.array(v)


def _table(spark, rows):
    return spark.createDataFrame([(i, v, 0, 7, "x", 1.0) for i, v in rows], SCHEMA)


@pytest.mark.parametrize(("n", "d", "scale"), [(60, 10, 1.0), (5000, 3, 0.2), (40, 12, 3e7), (9, 20, 1.0)])
def test_against_fractions(spark, n, d, scale):
    r = np.random.default_rng(n)
    vectors = (r.normal(size=(n, d)) * scale * (1 + np.arange(d))).astype(np.float32)
    bad = [(900, None), (901, [float("nan")] * d), (902, [float("inf")] + [0.0] * (d - 1)), (903, [None] + [1.0] * (d - 1)), (904, []), (905, [1.0] * (d + 1))]
    table = _table(spark, [*((i, v.tolist()) for i, v in enumerate(vectors)), *bad]).repartition(3)
    xs, mean, deviation, cov = _brute(vectors.tolist())
    values, axes = np.linalg.eigh(cov)
    top = np.argsort(-values)[:8]
    top = top[values[top] > 1e-12 * np.trace(cov)]
    got = whitening.whitening_query(table).collect()
    assert len(got) == n * len(top) and {g.vec_id for g in got} == set(range(n))
    centred = np.array([[float(x - m) for x, m in zip(row, mean)] for row in xs])
    z = centred @ axes[:, top] / np.sqrt(values[top])
    mine = np.zeros_like(z)
    for g in got:
        mine[g.vec_id, g.component - 1] = g.whitened
        assert int(g.deviation_digits) == deviation[g.vec_id] and g.deviation in (None, deviation[g.vec_id]) and (g.deviation is None) == (deviation[g.vec_id] >= 1 << 63)
        assert g.n == n and g.identity_error < 1e-6
        assert abs(g.explained - values[top][g.component - 1] / np.trace(cov)) < 1e-9
    assert np.allclose(mine * np.sign((mine * z).sum(0)), z, atol=1e-5)


def test_scatter_is_exact_beyond_floats(spark):
    vectors = [[1e15, -3.0, 1e30], [1e15 + 2, 5.5, -1e30], [7.25, 1e17, 0.1]]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    found = whitening.scatter(*whitening.finite_vectors(rows))
    held = [[max(-whitening.MOST, min(whitening.MOST, math.floor(Fraction(c) * 1024))) for c in v] for v in vectors]
    assert found.n == 3
    assert [int(s) for s in found.sums] == [sum(c) for c in zip(*held)]
    assert [[int(c) for c in row] for row in found.cross] == [[sum(v[i] * v[j] for v in held) for j in range(3)] for i in range(3)]


def test_repeats_and_missing_ids(spark):
    vectors = [[1.0, 2.0], [1.0, 2.0], [0.5, -1.0], [0.25, 4.0]]
    got = whitening.whitening_query(_table(spark, [(1, vectors[0]), (1, vectors[1]), (None, vectors[2]), (4, vectors[3])])).collect()
    assert sorted((g.vec_id or -1, g.component) for g in got) == [(-1, 1), (-1, 2), (1, 1), (1, 1), (1, 2), (1, 2), (4, 1), (4, 2)]
    assert {g.deviation for g in got if g.vec_id == 1} == {_brute(vectors)[2][0]}


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [])], [(1, [0.5, 0.5])], [(1, [0.5, 0.5]), (2, [0.5, 0.5])]])
def test_no_component(spark, rows):
    out = whitening.whitening_query(_table(spark, rows))
    assert out.count() == 0
    assert out.columns[:7] == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
