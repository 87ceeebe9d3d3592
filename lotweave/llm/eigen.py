"""Leading eigenpairs of a symmetric matrix: Householder reduction to three diagonals, bisection by
Sturm counts, inverse iteration with reorthogonalisation inside clusters of close eigenvalues."""

from __future__ import annotations

import numpy as np

EPS = np.finfo(np.float64).eps
#: Eigenvalues closer than this share of the norm are one cluster.
CLOSE = 1e-3


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(diagonal, off-diagonal, reflectors) with Q' M Q three-diagonal; Q is the product of I - 2 u u'."""
    m = np.array(matrix, np.float64)
    n = len(m)
    reflectors = []
    for k in range(n - 2):
        x = m[k + 1:, k].copy()
        scale = np.abs(x[1:]).max(initial=0.0)
        u = np.zeros_like(x)
        if scale > 0:
            scale = max(scale, abs(x[0]))
            x /= scale
            x[0] += np.copysign(np.linalg.norm(x), x[0])
            u = x / np.linalg.norm(x)
            block = m[k + 1:, k + 1:]
            p = block @ u
            w = p - (u @ p) * u
            block -= 2 * (np.outer(u, w) + np.outer(w, u))
            first = m[k + 1:, k] - 2 * u * (u @ m[k + 1:, k])
            m[k + 1:, k] = first
            m[k, k + 1:] = first
        reflectors.append(u)
    return np.diag(m).copy(), np.diag(m, -1).copy(), reflectors


def count_below(diagonal: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many eigenvalues lie below each of ``at``: negative pivots of T - at I."""
    least = np.finfo(np.float64).tiny / EPS
    pivot = np.ones_like(at)
    below = np.zeros(len(at), np.int64)
    for i, d in enumerate(diagonal):
        pivot = d - at - (off[i - 1] ** 2 / pivot if i else 0.0)
        pivot = np.where(np.abs(pivot) < least, -least, pivot)
        below += pivot < 0
    return below


def leading_values(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` largest eigenvalues, falling, by bisection of a Gershgorin interval."""
    n = len(diagonal)
    reach = np.zeros(n)
    reach[:-1] += np.abs(off)
    reach[1:] += np.abs(off)
    spread = max(np.abs(diagonal).max() + reach.max(), np.finfo(np.float64).tiny)
    low, high = np.full(k, (diagonal - reach).min() - EPS * spread), np.full(k, (diagonal + reach).max() + EPS * spread)
    want = n - np.arange(k)  # the j-th largest has n - j eigenvalues at or below it
    for _ in range(200):
        mid = 0.5 * (low + high)
        if ((mid <= low) | (mid >= high) | (high - low <= 2 * EPS * np.abs(mid))).all():
            break
        under = count_below(diagonal, off, mid) >= want
        high, low = np.where(under, mid, high), np.where(under, low, mid)
    return 0.5 * (low + high)


def _solver(diagonal: np.ndarray, off: np.ndarray, at: float, least: float):
    """Solves (T - at I) x = b by elimination with row exchanges."""
    n = len(diagonal)
    d, u1, u2 = (diagonal - at).tolist(), [*off.tolist(), 0.0], [0.0] * n
    swap, factor = [False] * n, [0.0] * n
    for i in range(n - 1):
        low = float(off[i])
        if abs(low) > abs(d[i]):
            swap[i] = True
            factor[i] = d[i] / low
            d[i], old = low, u1[i]
            u1[i], u2[i] = d[i + 1], u1[i + 1]
            d[i + 1], u1[i + 1] = old - factor[i] * u1[i], -factor[i] * u2[i]
        else:
            if abs(d[i]) < least:
                d[i] = least
            factor[i] = low / d[i]
            d[i + 1] -= factor[i] * u1[i]
    if abs(d[n - 1]) < least:
        d[n - 1] = least

    def solve(b: np.ndarray) -> np.ndarray:
        x = b.tolist()
        for i in range(n - 1):
            if swap[i]:
                x[i], x[i + 1] = x[i + 1], x[i]
            x[i + 1] -= factor[i] * x[i]
        for i in range(n - 1, -1, -1):
            rest = x[i]
            if i + 1 < n:
                rest -= u1[i] * x[i + 1]
            if i + 2 < n:
                rest -= u2[i] * x[i + 2]
            x[i] = rest / d[i]
        return np.array(x)

    return solve


def vectors(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors of T, one a column, for falling ``values``."""
    n, norm = len(diagonal), max(np.abs(diagonal).max(), np.abs(off).max(initial=0.0), np.finfo(np.float64).tiny)
    found = np.zeros((n, len(values)))
    random = np.random.default_rng(7)
    cluster, shift = 0, np.inf
    for j, value in enumerate(values):
        if j and values[j - 1] - value > CLOSE * norm:
            cluster = j
        shift = min(value, shift - 4 * EPS * norm) if j > cluster else value  # equal values get shifts of their own
        solve = _solver(diagonal, off, shift, EPS * norm)
        x = random.standard_normal(n)
        for _ in range(5):
            x = solve(x / np.abs(x).max())
            x /= np.abs(x).max()
            for _ in range(2):  # twice is enough
                for i in range(cluster, j):
                    x -= (found[:, i] @ x) * found[:, i]
            x /= np.linalg.norm(x)
        found[:, j] = x
    return found


def leading(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues, falling, and their unit eigenvectors as columns."""
    n = len(matrix)
    k = min(k, n)
    scale = float(np.abs(matrix).max())
    if not scale:
        return np.zeros(k), np.eye(n)[:, :k]
    diagonal, off, reflectors = tridiagonal(matrix / scale)
    values = leading_values(diagonal, off, k)
    columns = vectors(diagonal, off, values)
    for step in range(len(reflectors) - 1, -1, -1):
        u = reflectors[step]
        columns[step + 1:] -= 2 * np.outer(u, u @ columns[step + 1:])
    return values * scale, columns
