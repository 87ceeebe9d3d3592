"""Whitening against a dense solution, and its eigen solver against the library's."""

import numpy as np
import pytest

from lotweave.llm import whitening
from lotweave.llm.eigen import leading

SCHEMA = "vec_id bigint, embedding array<float>, label int, x string, i int, v double"


def answer(spark, rows, most=16):
    df = spark.createDataFrame([(i, None if e is None else [None if c is None else float(c) for c in e], 0, "x", 1, 2.0) for i, e in rows], SCHEMA)
    got = whitening.whiten(df, most)
    assert got.dtypes == [("vec_id", "bigint"), ("component", "int"), ("n", "bigint"), ("deviation", "bigint"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double")]
    return got.collect()


def dense(vectors):
    x = np.floor(64 * np.array(np.array(vectors, np.float32), np.float64)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    centred = (n * fit - s) / n
    values, columns = np.linalg.eigh(centred.T @ centred / n)
    return x, n, s, values[::-1], columns[:, ::-1]


def test_whitening_equals_dense(spark):
    r = np.random.default_rng(3)
    vectors = (r.normal(size=(400, 24)) * np.linspace(3, 0.5, 24)).tolist()
    vectors += vectors[:100] * 2  # copies weigh once
    x, n, s, values, columns = dense(vectors)
    got = answer(spark, list(enumerate(vectors)))
    assert len(got) == 16 * len(vectors)
    table = {(g.vec_id, g.component): g for g in got}
    for j in range(16):
        mine = np.array([table[i, j + 1].whitened for i in range(len(vectors))])
        other = ((n * x - s) / n) @ columns[:, j] / np.sqrt(values[j])
        assert np.allclose(mine, np.copysign(1, mine @ other) * other, atol=1e-9)
        assert abs(table[0, j + 1].explained - values[j] / values.sum()) < 1e-12
    assert all(g.n == n and g.identity_error < 1e-9 for g in got)
    assert {g.vec_id: g.deviation for g in got} == {i: int(((n * x[i] - s) ** 2).sum()) for i in range(len(vectors))}


def test_odd_rows(spark):
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [0.0, 5.0]), (3, None), (4, [None, 1.0]), (5, [float("nan"), 1.0]), (6, [float("-inf"), 1.0]), (7, []),
            (8, [1.0, 2.0, 3.0]), (9, [3.0, 2.0, 1.5]), (10, [2.0, -7.0])]
    got = answer(spark, rows)
    assert sorted((g.vec_id or -1, g.component) for g in got) == [(-1, 1), (-1, 2), (1, 1), (1, 1), (1, 2), (1, 2), (8, 1), (9, 1), (10, 1), (10, 2)]
    assert {g.n for g in got if g.vec_id in (8, 9)} == {2} and {g.n for g in got if g.vec_id == 1} == {3}
    assert answer(spark, []) == [] and answer(spark, [(1, [1.0, 1.0])] * 3) == []
    far = answer(spark, [(1, [3e38, 0.0]), (2, [0.0, 1.0]), (3, [-3e38, 1.0])])
    assert {g.deviation for g in far if g.vec_id == 1} == {None}


@pytest.mark.parametrize("matrix", [
    np.diag([3.0, 3.0, 3.0, 1.0, 1.0]), np.zeros((4, 4)), np.ones((6, 6)), np.array([[2.0]]), np.array([[2.0, 1.0], [1.0, 2.0]]),
    np.cov(np.random.default_rng(0).normal(size=(200, 50)).T), 1e12 * np.eye(7) + np.ones((7, 7)),
    np.diag(2 * np.ones(40)) + np.diag(-np.ones(39), 1) + np.diag(-np.ones(39), -1)])
def test_leading_eigenpairs(matrix):
    values, columns = leading(matrix, 16)
    k = len(values)
    scale = max(np.abs(matrix).max(), 1e-300)
    assert np.allclose(values, np.linalg.eigvalsh(matrix)[::-1][:k], atol=1e-13 * scale * len(matrix))
    assert np.abs(columns.T @ columns - np.eye(k)).max() < 1e-12
    assert np.abs(matrix @ columns - columns * values).max() < 1e-12 * scale * len(matrix)
