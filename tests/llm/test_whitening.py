"""Embedding whitening against whole-number covariances and a dense eigenvalue routine."""

import math
from fractions import Fraction

import numpy as np
import pytest
from seqcurate.llm import whitening
from seqcurate.llm.queries import QUERIES

NAN, INF = math.nan, math.inf


def plain(vectors):
    """x, exact deviations, eigenvalues and vectors of the covariance of whole numbers."""
    x = [[math.floor(64 * c) + 1000000 for c in v] for v in vectors]
    n, sums = len(x), [sum(col) for col in zip(*x)]
    exact = [[n * c - s for c, s in zip(row, sums)] for row in x]
    centred = np.array([[float(Fraction(c, n)) for c in row] for row in exact])
    values, basis = np.linalg.eigh(centred.T @ centred / n)
    return [sum(c * c for c in row) for row in exact], centred, values[::-1], basis[:, ::-1]


def compare_rows(rows, ids, vectors, most=32):
    deviations, centred, values, basis = plain(vectors)
    count = min(most, int((values > whitening.ZERO * values[0]).sum()))
    assert len(rows) == len(ids) * count
    by_row = {}
    for r in rows:
        by_row.setdefault(r.vec_id, {})[r.component] = r
    gaps = np.abs(values[:count, None] - values[None, :]) + np.eye(len(values))[:count] * values[0]
    alone = gaps.min(1) > 1e-5 * values[0]
    signs = {}
    for i, (vec_id, deviation) in enumerate(zip(ids, deviations)):
        for k in range(count):
            r = by_row[vec_id][k + 1]
            assert r.n == len(ids) and r.deviation == deviation and r.identity_error <= 1e-4
            assert r.explained == pytest.approx(values[k] / values.sum(), rel=1e-9)
            want = centred[i] @ basis[:, k] / math.sqrt(values[k])
            if alone[k]:
                if abs(want) > 1e-3:
                    signs.setdefault(k, math.copysign(1, want * r.whitened))
                assert r.whitened == pytest.approx(signs.get(k, 1) * want, abs=1e-6)


def test_given_table(spark, sf_dir):
    given = spark.read.parquet(f"{sf_dir}/embeddings.parquet").orderBy("vec_id").collect()
    rows = QUERIES["op11_feast_whitening"](spark, sf_dir).collect()
    compare_rows(rows, [r.vec_id for r in given], [r.embedding for r in given])


def test_odd_rows(spark):
    kind = "vec_id long, embedding array<float>, n int, component string, x string, deviation string"
    good = [[0.1, -2.0, 3.5], [1.0, 1.0, 1.0], [-0.015625, 0.0, 7.25], [1.0, 1.0, 1.0], [5.0, -5.0, 0.5]]
    odd = [None, [], [NAN, 1.0, 1.0], [1.0, INF, 1.0], [1.0, None, 1.0], [1.0, 2.0], [1.0, 2.0, 3.0, 4.0], [1e30, 1.0, 1.0]]
    rows = [(k, v) for k, v in enumerate(good)] + [(100 + k, v) for k, v in enumerate(odd)]
    frame = spark.createDataFrame([(*r, 1, "c", "x", "d") for r in rows], kind)
    compare_rows(whitening.whiten(frame).collect(), list(range(5)), good)
    assert whitening.whiten(frame.limit(0)).collect() == []
    same = spark.createDataFrame([(1, [1.0, 2.0]), (None, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert whitening.whiten(same).collect() == []
    twice = spark.createDataFrame([(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [3.0, 2.0])], "vec_id long, embedding array<double>")
    got = whitening.whiten(twice).collect()
    assert len(got) == 3 and {r.component for r in got} == {1} and got[0].explained == pytest.approx(1.0)


def test_large_numbers_stay_exact(spark):
    vectors = [[2.0**32, 1.0], [-(2.0**32), 3.0], [2.0**31 + 0.5, -2.0]] * 3
    frame = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")
    got = {r.vec_id: r.deviation for r in whitening.whiten(frame).collect()}
    want = plain(vectors)[0]
    assert got == {k: (v if v < 1 << 63 else None) for k, v in enumerate(want)}


def _spread(values, seed=0):
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))[0]
    return q @ np.diag(values) @ q.T


@pytest.mark.parametrize(
    "values",
    [[1.0] * 64, 10.0 ** -np.arange(30), [3, 3, 3, 2, 2, 1, 0, 0], [5.0] * 30 + [5 - 1e-9] * 10 + list(np.linspace(1, 2, 24)), np.arange(1, 100), [2.0], [0.0] * 4],
    ids=["equal", "falling", "singular", "clusters", "even", "one", "zero"],
)
def test_eigenvectors(values):
    matrix = _spread(np.array(values, float))
    matrix = (matrix + matrix.T) / 2
    got, vectors = whitening.eigen(matrix)
    want = np.linalg.eigh(matrix)[0][::-1]
    count = int((want > whitening.ZERO * max(want[0], 1e-300)).sum())
    assert len(got) == min(32, count)
    assert np.abs(got - want[: len(got)]).max(initial=0) <= 1e-13 * want[0]
    assert np.abs(vectors.T @ vectors - np.eye(len(got))).max(initial=0) < 1e-13
    assert np.linalg.norm(matrix @ vectors - vectors * got, axis=0).max(initial=0) <= 1e-13 * want[0]


def test_inertia_counts():
    matrix = _spread(np.array([9.0, 4, 4, 1, 0, -2]))
    assert whitening.inertia(whitening.tridiagonal(matrix), np.array([-3, -1, 0.5, 2, 5, 10])).tolist() == [0, 1, 2, 3, 5, 6]
