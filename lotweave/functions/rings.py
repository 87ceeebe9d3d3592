"""Whether an edge of a ring crosses another one, for rings with many corners."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BooleanType

LEAF = 64  # edges that are compared pair by pair


def _turns(a, b, p):
    """Sign of the turn from a to b to p, by broadcasting."""
    return np.sign((b[..., 0] - a[..., 0]) * (p[..., 1] - a[..., 1]) - (b[..., 1] - a[..., 1]) * (p[..., 0] - a[..., 0]))


def _pair_crosses(a, b) -> bool:
    """Whether two of the edges a-b cross in a point inside both; blocks keep the memory bounded."""
    for at in range(0, len(a), 256):
        p, q = a[at:at + 256, None], b[at:at + 256, None]
        r, s = a[None, at:], b[None, at:]
        if ((_turns(p, q, r) * _turns(p, q, s) < 0) & (_turns(r, s, p) * _turns(r, s, q) < 0)).any():
            return True
    return False


def _meets(a, b, low, high):
    """Edges that may meet the box from ``low`` to ``high``: their boxes overlap and it does not lie beside their line."""
    near = ((np.minimum(a, b) <= high) & (np.maximum(a, b) >= low)).all(axis=1)
    along = b - a
    middle, half = (low + high) / 2, (high - low) / 2
    apart = np.abs(along[:, 0] * (middle[1] - a[:, 1]) - along[:, 1] * (middle[0] - a[:, 0]))
    reach = np.abs(along[:, 0]) * half[1] + np.abs(along[:, 1]) * half[0]
    slack = 1e-9 * (np.abs(along).sum(axis=1) * (np.abs(middle).sum() + np.abs(a).sum(axis=1)) + 1e-300)
    return near & (apart <= reach + slack)


def ring_crosses(points: np.ndarray) -> bool:
    """Whether two edges of the ring (n x 2, last point equal to the first) cross properly.

    The plane is halved at the median of the edges' middles again and again; both edges of a crossing
    meet the part that holds their common point, so only edges of one part are compared. Parts that
    halving does not thin out (edges through one spot) are compared as they are.
    """
    a, b = points[:-1], points[1:]
    if len(a) < 2:
        return False
    parts = [(np.arange(len(a)), points.min(axis=0), points.max(axis=0))]
    while parts:
        rows, low, high = parts.pop()
        if len(rows) > LEAF:
            best = None
            middles = np.clip((a[rows] + b[rows]) / 2, low, high)
            for axis in (0, 1):
                cut = np.median(middles[:, axis])
                top, bottom = high.copy(), low.copy()
                top[axis] = bottom[axis] = cut
                under, over = rows[_meets(a[rows], b[rows], low, top)], rows[_meets(a[rows], b[rows], bottom, high)]
                if best is None or max(len(under), len(over)) < max(len(best[0][0]), len(best[1][0])):
                    best = (under, low, top), (over, bottom, high)
            if max(len(best[0][0]), len(best[1][0])) <= 0.9 * len(rows):
                parts.extend(best)
                continue
        if _pair_crosses(a[rows], b[rows]):
            return True
    return False


@pandas_udf(BooleanType())
def any_ring_crosses(rings: pd.Series) -> pd.Series:
    """For rings as flat arrays x, y, x, y, ...: whether one of them crosses itself. Null where no rings are given."""
    def crossed(shape):
        return None if shape is None else any(ring_crosses(np.asarray(r, dtype=float).reshape(-1, 2)) for r in shape)

    return rings.map(crossed, na_action=None).astype(object)


# A deterministic call would be merged into filters above it, where Spark 4.1 failed to plan the Python step.
any_ring_crosses = any_ring_crosses.asNondeterministic()
