"""Embedding links against all pairs."""

import math

import numpy as np
import pytest

from lotweave.llm import embedding_links
from lotweave.llm.cross_polytope import hadamard

SCHEMA = "vec_id bigint, embedding array<float>, label int, node int, ball string, key double, copies int"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if e is None else [None if c is None else float(c) for c in e], l, 1, "x", 0.5, 9) for i, e, l in rows], SCHEMA)


def brute(rows, cosine=0.93):
    def good(e, l, i):
        return i is not None and l is not None and e is not None and all(c is not None and math.isfinite(c) for c in e) and any(c != 0 for c in e)

    n = len(rows)
    unit = {k: np.array(np.array(e, np.float32), np.float64) / np.linalg.norm(np.array(np.array(e, np.float32), np.float64)) for k, (i, e, l) in enumerate(rows) if good(e, l, i)}
    links = [[] for _ in range(n)]
    for a in unit:
        for b in unit:
            if a != b and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= cosine:
                links[a].append(b)
    out = []
    for k in range(n):
        seen, todo = {k}, [k]
        while todo:
            for b in links[todo.pop()]:
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        least = rows[k][0] if len(seen) == 1 else min(rows[s][0] for s in seen)
        out.append((rows[k][0], len(links[k]), least, rows[k][0] == least))
    return sorted(out, key=repr)


def answer(spark, rows, **more):
    got = embedding_links.near_classes(frame(spark, rows), **more)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    return sorted([tuple(r) for r in got.collect()], key=repr)


def clustered(seed, noises=(0.05, 0.2, 0.35), size=40, d=32):
    """Tight and loose groups, exact copies, and strangers."""
    r = np.random.default_rng(seed)
    rows = []
    for g, noise in enumerate(noises):
        centre = r.normal(size=d)
        centre /= np.linalg.norm(centre)
        for _ in range(size):
            e = centre + noise * r.normal(size=d) / math.sqrt(d)
            rows.append((len(rows), e * r.uniform(0.5, 3), g % 2))
    rows += [(1000 + k, rows[3][1], 0) for k in range(30)]
    rows += [(2000 + k, r.normal(size=d), k % 3) for k in range(200)]
    return rows


@pytest.mark.parametrize("tile", [8, 2048])
def test_links_equal_all_pairs(spark, tile):
    rows = clustered(5)
    assert answer(spark, rows, tile=tile) == brute(rows)  # four tables would be needed to miss none by chance; this seed misses none


def test_recall_at_the_threshold(spark):
    """Pairs at exactly the least cosine in 64 dimensions, the hardest to find: at least 0.97 of them."""
    r = np.random.default_rng(1)
    rows = []
    for k in range(500):
        x, z = r.normal(size=(2, 64))
        x /= np.linalg.norm(x)
        z -= (z @ x) * x
        z /= np.linalg.norm(z)
        rows += [(2 * k, x, 0), (2 * k + 1, 0.931 * x + math.sqrt(1 - 0.931 ** 2) * z, 0)]
    got = answer(spark, rows)
    assert sum(n for _, n, _, _ in got) >= 0.97 * 1000
    truth = {i: n for i, n, _, _ in brute(rows)}
    assert all(n <= truth[i] for i, n, _, _ in got)


def test_odd_rows(spark):
    one = [1.0, 2.0, 0.0]
    rows = [(1, one, 0), (1, one, 0), (2, [2.0, 4.0, 0.0], 0), (3, one, None), (None, one, 0), (4, None, 0), (5, [0.0, 0.0, 0.0], 0), (6, [1.0, None, 1.0], 0),
            (7, [float("nan"), 1.0, 1.0], 0), (8, [float("inf"), 1.0, 1.0], 0), (9, [], 0), (10, [1.0, 2.0], 0), (11, [-1.0, -2.0, 0.0], 0), (12, [-0.0, 0.0, 1.0], 1),
            (13, [0.0, -0.0, 1.0], 1), (14, [1e-30, 2e-30, 0.0], 0), (15, one, 7)]
    assert answer(spark, rows) == brute(rows)
    assert answer(spark, []) == []


def test_hadamard_keeps_length():
    x = np.random.default_rng(2).normal(size=(5, 16))
    y = hadamard(x)
    assert np.allclose(np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1))
    assert np.allclose(hadamard(y), x)
