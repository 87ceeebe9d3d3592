"""Cutting stock by column generation: few patterns for any number of pieces.

The master program has one row per piece class, so its size depends on the sequence length alone.
Its dual prices go to an unbounded knapsack, whose best filling is the next pattern.
"""

from __future__ import annotations

import numpy as np


def knapsack(value: np.ndarray, capacity: int) -> list[tuple[float, dict[int, int]]]:
    """For each size of positive value, the best filling of ``capacity`` that holds it: its value and counts."""
    sizes = np.flatnonzero(value > 0) + 1
    gain = value[sizes - 1]
    best, last, root = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64), np.zeros(capacity + 1, np.int64)
    fits = np.searchsorted(sizes, np.arange(capacity + 1), side="right")
    for w in range(1, capacity + 1):
        best[w], root[w] = best[w - 1], root[w - 1]  # root: the filled weight that a weight without its own piece falls back to
        if fits[w]:
            total = best[w - sizes[:fits[w]]] + gain[:fits[w]]
            k = total.argmax()
            if total[k] > best[w]:
                best[w], last[w], root[w] = total[k], sizes[k], w
    found = []
    last, root = last.tolist(), root.tolist()
    for size, own in zip(sizes.tolist(), gain, strict=True):
        taken, w = {size: 1}, root[capacity - size]
        while w > 0:
            taken[last[w]] = taken.get(last[w], 0) + 1
            w = root[w - last[w]]
        found.append((float(own + best[capacity - size]), taken))
    return found


def _times(matrix: np.ndarray, vector: np.ndarray) -> np.ndarray:
    """A product in this thread alone; matrices this small lose by being shared out."""
    return np.einsum("ij,j->i", matrix, vector)


def solve(demand: np.ndarray, capacity: int, gap: float = 1e-3, pivots: int = 4_000) -> list[tuple[dict[int, int], float]]:
    """Patterns and how often each is used (fractional): sizes 1..len(demand), each demand met exactly.

    Revised simplex. Columns found by pricing stay in a pool, which is searched before the next
    knapsack. It stops when the dual bound proves the answer within ``gap`` of the least; stopping
    at ``pivots`` leaves a dearer but valid answer.
    """
    sizes = np.flatnonzero(demand) + 1
    m = len(sizes)
    if not m:
        return []
    row = {int(s): i for i, s in enumerate(sizes)}
    # a slight, fixed disturbance of the demands keeps equal ratios from cycling
    need = demand[sizes - 1] + 1e-3 * (1 + np.arange(m) * 0.6180339887 % 1)
    counts = np.array([capacity // s for s in sizes], float)
    patterns = [{int(s): capacity // int(s)} for s in sizes]
    columns = np.diag(counts)
    inverse, used = np.diag(1 / counts), need / counts
    pool: list[dict[int, int]] = []
    table = np.zeros((0, m))
    for turn in range(pivots):
        price = inverse.sum(axis=0)
        k = int(np.argmax(worth)) if len(worth := _times(table, price)) else -1
        if k < 0 or worth[k] <= 1 + gap:
            value = np.zeros(capacity)
            value[sizes - 1] = price
            fresh = [(v, taken) for v, taken in knapsack(value, capacity) if v > 1 + gap]
            if not fresh:
                break
            pool = [pool[i] for i in np.flatnonzero(worth > 0.98)] + [taken for _, taken in fresh]
            table = np.zeros((len(pool), m))
            for i, taken in enumerate(pool):
                for size, n in taken.items():
                    table[i, row[size]] = n
            k = int(np.argmax(_times(table, price)))
        step = _times(inverse, table[k])
        up = step > 1e-9
        if not up.any():
            break
        ratio = np.where(up, used / np.where(up, step, 1), np.inf)
        out = int(np.argmin(ratio))
        least = ratio[out]
        patterns[out], columns[:, out] = pool[k], table[k]
        inverse[out] /= step[out]
        step[out] = 0
        inverse -= np.outer(step, inverse[out])
        used = used - step * least
        used[out] = least
        if turn % 500 == 499:  # a Newton step takes out what rounding has put in
            inverse = 2 * inverse - np.einsum("ij,jk->ik", inverse, np.einsum("ij,jk->ik", columns, inverse))
            used = _times(inverse, need)
    return [(p, float(max(u, 0))) for p, u in zip(patterns, used, strict=True)]


def rounded(demand: np.ndarray, capacity: int, least_fill: float = 0.0) -> tuple[list[tuple[dict[int, int], int]], np.ndarray]:
    """Whole-number uses of the patterns, and the demand they leave.

    Without ``least_fill`` the rest is bounded by patterns and capacity alone; with it, the pieces of patterns
    that fill a smaller share of a sequence are left too.
    """
    found = [f for f in solve(demand, capacity) if sum(s * k for s, k in f[0].items()) >= least_fill * capacity]
    left = demand.astype(np.int64).copy()
    uses = []
    for pattern, use in sorted(found, key=lambda f: -f[1]):
        n = min([int(use + 1e-6), *(int(left[s - 1]) // k for s, k in pattern.items())])
        for s, k in pattern.items():
            left[s - 1] -= n * k
        uses.append([pattern, n, use - int(use + 1e-6)])
    # once more for the largest fractions while the rest still holds the whole pattern, if it fills the sequence
    for entry in sorted(uses, key=lambda u: -u[2]):
        pattern = entry[0]
        if sum(s * k for s, k in pattern.items()) >= 0.99 * capacity and all(left[s - 1] >= k for s, k in pattern.items()):
            entry[1] += 1
            for s, k in pattern.items():
                left[s - 1] -= k
    return [(p, n) for p, n, _ in uses if n], left
