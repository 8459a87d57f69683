"""Whitening by block products against a dense eigendecomposition."""

import math
from fractions import Fraction

import numpy as np
import pytest

from sparkmill.llm import op12_whitening as op12


def table(spark, vectors):
    return spark.createDataFrame([(i, v, 7) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, component int").repartition(3)


def usable(v, size):
    return v is not None and len(v) == size and all(c is not None and math.isfinite(c) for c in v)


def brute(vectors, size):
    x = {i: tuple(math.floor(64 * c) + 1_000_000 for c in v) for i, v in enumerate(vectors) if usable(v, size)}
    fit = sorted(set(x.values()))
    n, s = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centred = {k: np.array([float(Fraction(n * a - b, n)) for a, b in zip(k, s, strict=True)]) for k in fit}
    c = np.array([centred[k] for k in fit])
    value, vector = np.linalg.eigh(c.T @ c / n)
    return x, n, s, centred, value[::-1], vector[:, ::-1], np.trace(c.T @ c / n)


@pytest.mark.parametrize("size", [3, 20, 64])
def test_against_a_dense_eigendecomposition(spark, size):
    rng = np.random.default_rng(size)
    spread = np.linspace(3, 0.4, size)
    vectors = (rng.standard_normal((300, size)) * spread).tolist()
    vectors += [vectors[0]] * 200 + [None, [], [None] + [1.0] * (size - 1), [math.nan] * size, [math.inf] + [0.0] * (size - 1), [1.0] * (size + 1), [1e300] + [0.0] * (size - 1)]
    x, n, s, centred, value, vector, trace = brute(vectors[:-1], size)
    got = op12.whitened(table(spark, vectors)).collect()
    k = min(16, size)
    assert len(got) == len(x) * k
    by = {(r["vec_id"], r["component"]): r for r in got}
    sign = {}
    for (i, c), r in by.items():
        assert r["n"] == n and r["deviation"] == sum((n * a - b) ** 2 for a, b in zip(x[i], s, strict=True))
        want = centred[x[i]] @ vector[:, c - 1] / math.sqrt(value[c - 1])
        if abs(want) > 1e-3:
            sign.setdefault(c, np.sign(want) * np.sign(r["whitened"]))
        assert abs(r["whitened"] * sign.get(c, 1) - want) < 1e-9 or abs(want) <= 1e-3
        assert abs(r["explained"] / (value[c - 1] / trace) - 1) < 1e-12
        assert r["identity_error"] < 1e-10


def test_certified_where_the_block_is_small(spark):
    """300 dimensions: the block spans a part of the space only, so rounds are needed."""
    rng = np.random.default_rng(1)
    c = rng.standard_normal((900, 300)) * np.linspace(2, 0.2, 300)
    c -= c.mean(axis=0)
    v = c.T @ c / len(c)
    seen = []
    x, value, residual, rounds = op12.lobpcg(lambda b: seen.append(b.shape[1]) or v @ b, 300, 16)
    want = np.linalg.eigvalsh(v)[::-1][:16]
    assert np.allclose(value, want, rtol=1e-12) and residual <= op12.CERTIFIED and rounds > 3
    assert np.abs(x.T @ x - np.eye(16)).max() < 1e-13 and max(seen) <= 2 * (16 + op12.GUARD)


def test_degenerate_tables(spark):
    assert op12.whitened(table(spark, [])).count() == 0
    assert op12.whitened(table(spark, [None, [], [math.nan]])).count() == 0
    assert op12.whitened(table(spark, [[1.0, 2.0]] * 5)).count() == 0
    flat = op12.whitened(table(spark, [[float(i), 2.0 * i, 0.0] for i in range(9)])).collect()
    assert len(flat) == 9 and {r["component"] for r in flat} == {1} and abs(flat[0]["explained"] - 1) < 1e-12
    large = op12.whitened(table(spark, [[2.0**50, 0.0], [-(2.0**50), 1.0], [0.0, 0.5]])).collect()
    assert {r["deviation"] for r in large} == {None, 0}  # the last is the mean
    assert all(np.isfinite(r["whitened"]) for r in large)
