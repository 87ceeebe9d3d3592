"""Sparse matrices as compressed rows, built by hand, and their product by rows.

A matrix is ``Csr(ptr, col, width)``: row ``i`` has ones in the columns ``col[ptr[i]:ptr[i + 1]]``.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np


class Csr(NamedTuple):
    ptr: np.ndarray
    col: np.ndarray
    width: int


def from_lengths(lengths: np.ndarray, width: int) -> Csr:
    """Incidence of consecutive runs: row ``i`` owns the next ``lengths[i]`` columns."""
    ptr = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=ptr[1:])
    return Csr(ptr, np.arange(ptr[-1], dtype=np.int64), width)


def from_column(col: np.ndarray, width: int) -> Csr:
    """One 1 a row, in the column ``col[i]``."""
    return Csr(np.arange(len(col) + 1, dtype=np.int64), col.astype(np.int64), width)


def transpose(m: Csr) -> Csr:
    """Rows become columns by a counting sort over the columns."""
    rows = np.repeat(np.arange(len(m.ptr) - 1, dtype=np.int64), np.diff(m.ptr))
    ptr = np.zeros(m.width + 1, np.int64)
    np.cumsum(np.bincount(m.col, minlength=m.width), out=ptr[1:])
    return Csr(ptr, rows[np.argsort(m.col, kind="stable")], len(m.ptr) - 1)


def multiply(left: Csr, right: Csr) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, value) of the product's non-zero entries, in row order.

    Gustavson's rule: row ``i`` of the product is the sum of the rows ``k`` of ``right`` over the
    columns ``k`` of row ``i`` of ``left``. The rows are laid one after another and equal columns of
    a row are added up.
    """
    sizes = np.diff(right.ptr)[left.col]
    total = int(sizes.sum())
    ends = np.cumsum(sizes)
    at = np.arange(total, dtype=np.int64) + np.repeat(right.ptr[left.col] - (ends - sizes), sizes)
    row = np.repeat(np.repeat(np.arange(len(left.ptr) - 1, dtype=np.int64), np.diff(left.ptr)), sizes)
    key = row * max(1, right.width) + right.col[at]
    if total and (key[1:] < key[:-1]).any():
        key = np.sort(key, kind="stable")
    head = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if total else np.zeros(0, np.int64)
    value = np.diff(np.concatenate((head, [total])))
    return key[head] // max(1, right.width), key[head] % max(1, right.width), value
