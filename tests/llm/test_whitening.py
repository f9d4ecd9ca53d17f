"""Whitening by Jacobi-Davidson against NumPy's eigenvectors."""

from __future__ import annotations

import math

import numpy as np
import pytest

from corpusloom.llm import whitening

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, k=8):
    x = np.array([[math.floor(1024 * float(c)) + 100_000 for c in np.float32(v)] for _, v in rows], object)
    n, sums = len(x), x.sum(axis=0)
    exact = x * n - sums
    centred = exact.astype(float) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    return (exact * exact).sum(axis=1), centred @ (vectors / np.sqrt(values)), values / (centred**2).sum() * n, n


def random_rows(n, dim, seed=0):
    rng = np.random.default_rng(seed)
    vectors = rng.standard_normal((n, dim)) @ np.diag(np.linspace(2, 0.3, dim)) / 4
    return [(i, v.tolist()) for i, v in enumerate(vectors.astype(np.float32))]


@pytest.mark.parametrize(("n", "dim"), [(300, 20), (900, 64), (40, 3), (30, 100)])
def test_whitening(spark, n, dim):
    rows = random_rows(n, dim)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = whitening.whiten(df).toPandas().sort_values(["vec_id", "component"])
    deviations, whitened, explained, _ = brute(rows)
    k = min(8, dim)
    assert len(got) == n * k and (got.n == n).all() and got.identity_error.max() <= 1e-9 and got.identity_error.nunique() == 1
    found = got.whitened.to_numpy().reshape(n, k)
    signs = np.sign((found * whitened).sum(axis=0))
    assert np.abs(found * signs - whitened).max() < 1e-8
    assert np.allclose(got.explained.to_numpy().reshape(n, k), explained, rtol=1e-10)
    assert got.deviation.tolist() == [d for d in deviations for _ in range(k)]


def test_odd_rows(spark):
    """What takes no part, rows that repeat, a null id, entries so large that longs do not hold the sums."""
    nan, inf = float("nan"), float("inf")
    good = random_rows(60, 4, 1) + [(None, [0.5, 0.25, 0.0, 1.0]), (3, [1.0, 2.0, 3.0, -4.0]), (3, [1.0, 2.0, 3.0, -4.0])]
    odd = [(90, None), (91, [nan, 1.0, 1.0, 1.0]), (92, [inf, 1.0, 1.0, 1.0]), (93, [None, 1.0, 1.0, 1.0]), (94, [1.0]), (95, []), (96, [1e30, 1.0, 1.0, 1.0])]
    df = spark.createDataFrame(good + odd, SCHEMA).selectExpr("*", "1 AS n", "'x' AS component", "2 AS x", "3 AS ids")
    got = whitening.whiten(df).toPandas()
    deviations, _, _, n = brute(good)
    assert n == 63 and set(got.n) == {63} and len(got) == 63 * 4
    assert sorted(got.deviation) == sorted(d for d in deviations for _ in range(4))
    assert got.vec_id.isna().sum() == 4 and (got.vec_id == 3).sum() == 12

    large = good[:60] + [(i, [2.0**40 * (i % 7), 1.0, 2.0**30, float(i)]) for i in range(200, 260)]
    got = whitening.whiten(spark.createDataFrame(large, SCHEMA)).toPandas()
    deviations, *_ = brute(large)
    assert got.deviation.isna().any() or max(deviations) < 1 << 63
    told = {d for d in got.deviation.dropna().astype(int)}
    assert told <= set(deviations) and len(got) == 120 * got.component.max()


def test_nothing_to_whiten(spark):
    def count(rows):
        return whitening.whiten(spark.createDataFrame(rows, SCHEMA)).count()

    assert count([]) == 0
    assert count([(1, [1.0, 2.0])]) == 0
    assert count([(i, [1.0, 2.0]) for i in range(9)]) == 0
    assert count([(1, []), (2, None)]) == 0
    assert count([(i, [float(i), 2.0 * i]) for i in range(9)]) == 9  # one direction only


@pytest.mark.parametrize("dim", [1, 2, 9, 40, 120])
def test_leading_pairs(dim):
    """Residuals in double precision, also with equal, zero and far-apart eigenvalues."""
    rng = np.random.default_rng(dim)
    base = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
    for spectrum in (np.linspace(1, 2, dim), np.r_[np.ones(dim // 2), np.zeros(dim - dim // 2)] + 0.0, np.logspace(0, -9, dim)):
        matrix = (base * spectrum) @ base.T
        matrix = (matrix + matrix.T) / 2
        if not matrix.any():
            continue
        values, vectors = whitening.leading(lambda v: matrix @ v, dim, 8)
        top = np.abs(spectrum).max()
        assert np.abs(values - np.sort(spectrum)[::-1][:8]).max() < 1e-12 * top
        assert np.linalg.norm(matrix @ vectors - vectors * values, axis=0).max() < 1e-12 * top
        assert np.abs(vectors.T @ vectors - np.eye(vectors.shape[1])).max() < 1e-12


def test_the_matrix_is_never_formed():
    """Only products with a few columns at a time are asked for, far fewer passes than dimensions."""
    rng = np.random.default_rng(3)
    factor = rng.standard_normal((500, 400)) * np.logspace(0, -2, 400)
    widths = []

    def product(v):
        widths.append(v.shape[1])
        return factor.T @ (factor @ v)

    whitening.leading(product, 400, 8)
    assert max(widths) <= 32 and len(widths) < 100
