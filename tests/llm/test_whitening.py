import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from clusterscope.llm import whitening

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, k=16):
    ok = [(i, [math.floor(64 * float(v)) + 1000000 for v in x]) for i, x in rows
          if x and all(v is not None and math.isfinite(v) for v in x)]
    fit = sorted({tuple(x) for _, x in ok})
    n, dim = len(fit), len(fit[0])
    s = [sum(c) for c in zip(*fit)]
    y = np.array([[float(Fraction(a * n - b, n)) for a, b in zip(x, s)] for x in fit])
    e, v = np.linalg.eigh(y.T @ y / n)
    e, v = e[::-1], v[:, ::-1]
    k = min(k, int((e > 1e-13 * e[0]).sum()))
    out = {}
    for i, x in ok:
        c = np.array([float(Fraction(a * n - b, n)) for a, b in zip(x, s)])
        w = c @ v[:, :k] / np.sqrt(e[:k])
        for j in range(k):
            out.setdefault(i, []).append((j + 1, n, sum((n * a - b) ** 2 for a, b in zip(x, s)), w[j], e[j] / e.sum()))
    return out


def hold(df, expected):
    got = df.collect()
    assert df.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert len(got) == sum(len(v) for v in expected.values())
    sign = {}
    for r in sorted(got, key=lambda r: -abs(r.whitened)):          # one sign per component, for all rows
        _, n, deviation, w, explained = next(e for e in expected[r.vec_id] if e[0] == r.component)
        flip = sign.setdefault(r.component, 1 if w * r.whitened > 0 else -1)
        assert (r.n, r.deviation) == (n, deviation)
        assert r.whitened == pytest.approx(flip * w, abs=1e-9) and r.explained == pytest.approx(explained, rel=1e-10)
        assert r.identity_error < 1e-10


def test_against_a_dense_eigensolver(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 24)) @ rng.normal(size=(24, 24)) * np.linspace(2, .05, 24)
    x[100:230] = x[100]                                            # a third are copies; the fit list has them once
    rows = [(i, [float(np.float32(v)) for v in r]) for i, r in enumerate(x)]
    bad = [(900, None), (901, []), (902, [float("nan")] * 24), (903, [float("inf")] * 24), (904, [1.0, None] * 12), (905, [1.0] * 7)]
    df = spark.createDataFrame(rows + bad, SCHEMA).withColumn("n", F.lit("x")).withColumn("x", F.lit(0)).repartition(5)
    hold(whitening.whitened(df), brute(rows))


def test_fewer_dimensions_than_components_and_flat_directions(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(a), float(b), 2.0]) for i, (a, b) in enumerate(rng.normal(size=(60, 2)))]
    hold(whitening.whitened(spark.createDataFrame(rows, SCHEMA)), brute(rows))


def test_no_variance_and_no_rows(spark):
    assert whitening.whitened(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], SCHEMA)).count() == 0
    assert whitening.whitened(spark.createDataFrame([], SCHEMA)).count() == 0
    assert whitening.whitened(spark.createDataFrame([(1, None)], SCHEMA)).count() == 0


def test_huge_entries_are_clipped_and_deviations_beyond_a_long_are_null(spark):
    rows = [(1, [1e300, 1.0]), (2, [-1e300, 2.0]), (3, [1e300, 1.0]), (None, [0.0, 5.0])]
    got = whitening.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r.n for r in got} == {3} and {r.vec_id for r in got} == {1, 2, 3, None}
    assert {r.deviation for r in got if r.vec_id == 1} == {None}
    assert [r.whitened for r in got if r.vec_id == 1] == [r.whitened for r in got if r.vec_id == 3]


@pytest.mark.parametrize("dim,k,decay", [(64, 16, 0.0), (64, 16, 0.1), (200, 8, 0.02), (3, 16, 0.5), (40, 16, 2.0)])
def test_eigensolver_reaches_rounding_level(dim, k, decay):
    rng = np.random.default_rng(dim)
    x = rng.normal(size=(1000, dim)) * np.exp(-decay * np.arange(dim))
    a = x.T @ x / len(x)
    values, vectors = whitening.jacobi_davidson(lambda q: a @ q, dim, k)
    assert np.allclose(values, np.linalg.eigvalsh(a)[::-1][:k], rtol=0, atol=1e-13 * values[0])
    assert np.linalg.norm(a @ vectors - vectors * values, axis=0).max() < 1e-12 * values[0]
    assert np.allclose(vectors.T @ vectors, np.eye(len(values)), atol=1e-12)


def test_equal_eigenvalues():
    values, vectors = whitening.jacobi_davidson(lambda q: q * 2.0, 30, 5)
    assert np.allclose(values, 2.0) and np.allclose(vectors.T @ vectors, np.eye(5))
