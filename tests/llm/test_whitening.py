import os
from collections import defaultdict

import numpy as np
import pytest

from tidewatch.llm import whitening

SF = "/root/testdata/sf0.001"


def plain(vectors):
    """x, exact deviations, eigenvalues (falling) and eigenvectors (rows) by numpy's own solver."""
    x = np.floor(1024 * np.asarray(vectors, float)).astype(np.int64) + 100_000
    n, s = len(x), x.sum(axis=0)
    deviation = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, s, strict=True)) for row in x]
    c = x - s / n
    e, u = np.linalg.eigh(c.T @ c / n)
    return c, deviation, e[::-1], u.T[::-1]


@pytest.mark.skipif(not os.path.isdir(SF), reason="tables are not here")
def test_query_against_a_dense_solver(spark):
    given = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect() if r.embedding is not None and all(v is not None and np.isfinite(v) for v in r.embedding)]
    c, deviation, e, u = plain([v for _, v in given])
    found = defaultdict(dict)
    for r in whitening.op13_whitening(spark, SF).collect():
        found[r.vec_id][r.component] = r
    assert set(found) == {i for i, _ in given} and all(sorted(v) == list(range(1, 9)) for v in found.values())
    want = c @ u[:8].T / np.sqrt(e[:8])
    got = np.array([[found[i][k].whitened for k in range(1, 9)] for i, _ in given])
    sign = np.sign((want * got).sum(axis=0))
    assert np.abs(got * sign - want).max() < 1e-8
    assert [found[i][1].deviation for i, _ in given] == deviation
    one = found[given[0][0]]
    assert np.allclose([one[k].explained for k in range(1, 9)], e[:8] / e.sum(), rtol=1e-10)
    assert one[1].n == len(given) and one[1].identity_error < 1e-10


@pytest.mark.parametrize("seed", range(6))
def test_eigenpairs_against_a_dense_solver(seed):
    rng = np.random.default_rng(seed)
    d = int(rng.integers(2, 80))
    q, _ = np.linalg.qr(rng.standard_normal((d, d)))
    e = np.sort(10.0 ** rng.uniform(-6 if seed % 2 else 0, 6, d))[::-1]
    if seed == 2:
        e[3 : min(d, 12)] = e[3 if d > 3 else 0]  # ties across the eighth place
    v = q * e @ q.T
    v = (v + v.T) / 2
    values, vectors = whitening.eigenpairs(v, 8)
    k = min(8, d)
    assert len(values) == k and np.allclose(values, np.sort(np.linalg.eigvalsh(v))[::-1][:k], rtol=1e-9, atol=1e-12 * e[0])
    assert np.abs(vectors @ vectors.T - np.eye(k)).max() < 1e-7
    assert np.linalg.norm(v @ vectors.T - vectors.T * values, axis=0).max() < 1e-11 * e[0]


def test_inertia_counts():
    rng = np.random.default_rng(5)
    for _ in range(30):
        a = rng.standard_normal((20, 20))
        a = a + a.T
        e = np.linalg.eigvalsh(a)
        for shift in rng.uniform(-8, 8, 5):
            assert whitening.above(a, shift) == (e > shift).sum()
    assert whitening.above(np.array([[0.0, 1.0], [1.0, 0.0]]), 0.0) == 1
    assert whitening.above(np.zeros((3, 3)), 0.0) == 0


def test_a_missed_eigenvalue_is_an_error():
    with pytest.raises(ArithmeticError):
        whitening.feast(np.diag([5.0, 4.0, 1.0]), 3.0, 6.0, 3)


def test_low_rank_and_equal_rows(spark):
    rows = [(i, [float(i), 2.0 * i, 1.0]) for i in range(20)] + [(None, [0.0, 0.0, 1.0]), (3, [3.0, 6.0, 1.0])]
    found = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert len(found) == 3 * 22
    assert all((r.whitened is None) == (r.component > 1) for r in found)
    assert {round(r.explained, 9) for r in found if r.component == 1} == {1.0} and {r.explained for r in found if r.component > 1} == {0.0}
    equal = whitening.whiten(spark.createDataFrame([(1, [1.5, 2.5]), (2, [1.5, 2.5])], "vec_id long, embedding array<float>")).collect()
    assert [(r.deviation, r.whitened, r.explained, r.identity_error) for r in equal] == [(0, None, None, None)] * 4


def test_odd_rows(spark):
    rows = [(1, [1.0, 2.0], 1), (2, None, 1), (3, [1.0, None], 1), (4, [float("nan"), 1.0], 1), (5, [float("inf"), 1.0], 1), (6, [3.0, -4.0], 1), (7, [1.0], 1), (8, [1e300, 0.0], 1), (1, [1.0, 2.0], 2), (None, [0.0, 0.1], 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n int")
    found = whitening.whiten(df).collect()
    assert sorted((r.vec_id is None, r.vec_id or 0, r.component) for r in found) == [(False, 1, 1), (False, 1, 1), (False, 1, 2), (False, 1, 2), (False, 6, 1), (False, 6, 2), (True, 0, 1), (True, 0, 2)]
    assert all(r.n == 4 for r in found)
    assert whitening.whiten(df.limit(0)).collect() == [] and whitening.whiten(df.where("vec_id = 2")).collect() == []
    big = whitening.whiten(spark.createDataFrame([(1, [1e12]), (2, [-1e12])], "vec_id long, embedding array<double>")).collect()
    assert [r.deviation for r in big] == [None, None] and [round(abs(r.whitened), 9) for r in big] == [1.0, 1.0]
