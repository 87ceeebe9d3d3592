"""Cross-polytope hash codes: pseudo-random rotations by signs and fast Hadamard transforms, and their probes.

A vector is rotated by three rounds of random signs and a Hadamard transform; its code is the largest
coordinate with its sign. ``functions`` codes make a table's key. A vector is filed in ``probes`` keys
of a table, those whose coordinates lie least below the largest ones, and two vectors meet in a table
when they share a key.
"""

from __future__ import annotations

import itertools

import numpy as np

from lotweave.llm.common import mix


def hadamard(rows: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of every row; the width is a power of two."""
    count, width = rows.shape
    out, step = rows, 1
    while step < width:
        pairs = out.reshape(count, -1, 2, step)
        out = np.concatenate((pairs[:, :, :1] + pairs[:, :, 1:], pairs[:, :, :1] - pairs[:, :, 1:]), axis=2).reshape(count, width)
        step *= 2
    return out / np.sqrt(width)


class Hasher:
    """Keys of vectors of one dimension: ``tables`` tables of ``probes`` keys each."""

    def __init__(self, dimension: int, functions: int, tables: int, probes: int):
        self.width = 1 << max(1, (dimension - 1).bit_length())
        self.tables, self.functions, self.probes = tables, functions, probes
        random = np.random.default_rng([11, dimension, functions])
        self.signs = random.integers(0, 2, (tables, functions, 3, self.width)) * 2.0 - 1.0
        self.top = min(self.width, max(2, min(4, probes)))
        self.choices = np.array(list(itertools.product(range(self.top), repeat=functions)))

    def keys(self, unit: np.ndarray) -> np.ndarray:
        """(rows, tables, probes) 64-bit keys; the first of a table is the vector's own."""
        padded = np.zeros((len(unit), self.width))
        padded[:, :unit.shape[1]] = unit
        return np.stack([self._table(padded, t) for t in range(self.tables)], axis=1)

    def _table(self, padded: np.ndarray, t: int) -> np.ndarray:
        cost = np.zeros((len(padded), len(self.choices)))
        code = np.full((len(padded), len(self.choices)), t + 1, np.uint64)
        for f in range(self.functions):
            turned = padded
            for signs in self.signs[t, f]:
                turned = hadamard(turned * signs)
            size = np.abs(turned)
            best = np.argsort(-size, axis=1, kind="stable")[:, :self.top]
            behind = (size.max(axis=1, keepdims=True) - np.take_along_axis(size, best, 1)) ** 2
            vertex = (2 * best + (np.take_along_axis(turned, best, 1) < 0)).astype(np.uint64)
            cost += behind[:, self.choices[:, f]]
            code = code * np.uint64(2 * self.width) + vertex[:, self.choices[:, f]]
        first = np.argsort(cost, axis=1, kind="stable")[:, :self.probes]
        return mix(np.take_along_axis(code, first, 1) + np.uint64(self.width) * np.uint64(0x9E3779B97F4A7C15))
