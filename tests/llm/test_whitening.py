"""Whitening against NumPy's own eigenvectors."""

import numpy as np
import pytest

from riverine.llm.whitening import leading_components, polar_factor, whiten

DATA = "/root/testdata/sf0.01"


@pytest.mark.parametrize("d", [1, 2, 3, 7, 40])
def test_components(d):
    rng = np.random.default_rng(d)
    b = rng.standard_normal((d, d)) * np.exp(2 * rng.standard_normal(d))
    a = b @ b.T
    e, v = leading_components(a, 16)
    want, basis = np.linalg.eigh(a)
    k = min(16, d)
    assert np.allclose(e, want[::-1][:k], rtol=1e-10, atol=1e-13 * want[-1]) and np.allclose(v.T @ v, np.eye(k), atol=1e-13)
    assert np.allclose(np.abs((v * basis[:, ::-1][:, :k]).sum(axis=0)), 1, atol=1e-8)


@pytest.mark.parametrize("a", [np.eye(5) * 3, np.zeros((4, 4)), np.diag([1.0, 2, 3]), np.ones((4, 4)), np.diag([5.0, 5, 1, 1, 3]), np.zeros((0, 0)), np.diag([1.0, 0, -1])])
def test_ties_and_shifts_at_eigenvalues(a):
    e, v = leading_components(a, 16)
    assert np.allclose(e, np.sort(np.linalg.eigvalsh(a))[::-1], atol=1e-13) and np.allclose(a @ v, v * e, atol=1e-13) and np.allclose(v.T @ v, np.eye(len(a)), atol=1e-13)


def test_polar_factor():
    b = np.random.default_rng(0).standard_normal((9, 9))
    a = b + b.T
    e, v = np.linalg.eigh(a)
    assert np.allclose(polar_factor(a), v @ np.diag(np.sign(e)) @ v.T, atol=1e-12)


def check(rows, got, k):
    """rows: (id, vector) that should remain; got: result rows."""
    x = np.array([[int(np.floor(64 * float(c))) + 1000000 for c in v] for _, v in rows], np.int64)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    centred = fit - s / n
    cov = centred.T @ centred / n
    e, v = np.linalg.eigh(cov)
    e, v = e[::-1][:k], v[:, ::-1][:, :k]
    assert len(got) == len(rows) * k and {r.component for r in got} == set(range(1, k + 1))
    by = {}
    for r in got:
        by.setdefault((r.vec_id, r.deviation), {}).setdefault(r.component, r)
        assert r.n == n and abs(r.explained - e[r.component - 1] / np.trace(cov)) < 1e-4 * r.explained and r.identity_error < 1e-4
    white = (x - s / n) @ v / np.sqrt(e)
    signs = np.ones(k)
    mine = np.array([[by[i, int(((n * y - s) ** 2).sum())][c + 1].whitened for c in range(k)] for (i, _), y in zip(rows, x, strict=True)])
    signs = np.sign((mine * white).sum(axis=0))
    assert np.allclose(mine * signs, white, atol=1e-7)


def test_given_table(spark):
    df = spark.read.parquet(f"{DATA}/embeddings.parquet")
    check([(r.vec_id, r.embedding) for r in df.collect()], whiten(df).collect(), 16)


def test_odd_rows(spark):
    rng = np.random.default_rng(5)
    good = [(i, [float(c) for c in rng.normal(size=3) * [3, 2, 1]]) for i in range(30)] + [(None, [1.0, 2.0, 3.0]), (3, [0.5, 0.25, 9.0]), (3, [0.5, 0.25, 9.0])]
    bad = [(90, None), (91, []), (92, [1.0, None, 2.0]), (93, [1.0, float("nan"), 2.0]), (94, [1.0, float("inf"), 2.0]), (95, [1.0, 2.0]), (96, [float("-inf")] * 3)]
    df = spark.createDataFrame([(i, v, 7, "x") for i, v in good + bad], "vec_id long, embedding array<double>, n int, x string")
    check(good, whiten(df).collect(), 3)
    assert whiten(df.limit(0)).collect() == [] and whiten(df.where("vec_id BETWEEN 90 AND 94")).collect() == []


def test_no_variance(spark):
    rows = whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>")).collect()
    assert len(rows) == 4 and all(r.whitened is None and r.explained == 0 and r.deviation == 0 and r.n == 1 and r.identity_error == 0 for r in rows)
    flat = whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 4.0])], "vec_id long, embedding array<double>")).collect()
    assert sorted((r.vec_id, r.component, r.whitened and round(abs(r.whitened), 9), round(r.explained, 9)) for r in flat if r.component == 1) == [(1, 1, 1.0, 1.0), (2, 1, 1.0, 1.0)]
    assert all(r.whitened is None for r in flat if r.component == 2)


def test_large_integers(spark):
    """Products beyond 64 bits are added up exactly; deviations beyond them are null."""
    big = 2.0**30
    rows = whiten(spark.createDataFrame([(1, [big, 0.0]), (2, [-big, 0.5]), (3, [0.0, 0.25])], "vec_id long, embedding array<double>")).collect()
    first = {r.vec_id: r for r in rows if r.component == 1}
    assert abs(abs(first[1].whitened) - 1.5**0.5) < 1e-9 and abs(first[3].whitened) < 1e-6 and first[1].deviation is None
