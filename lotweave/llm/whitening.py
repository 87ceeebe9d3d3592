"""Whitening of embeddings: projection on the leading components of the covariance, scaled to unit variance.

The entries are put on a grid of 1/64, so sums are exact integers. The fit list (each distinct vector
once) is a written table; its sums and its covariance, centred before multiplying, are added up by
task and then by Spark, one row a matrix entry, so the driver sees d sums and d * d entries whatever
the number of vectors. The components are found there (``eigen``) and sent to the tasks that project.

Defined results. Rows whose vector is null or holds a null or non-finite entry are dropped. Vectors
of different lengths are whitened apart, each length by its own fit list; the empty vector has no
components and no rows. Components whose eigenvalue is below 1e-12 of the largest have no scale and
are not returned, so a list of equal vectors gives no rows. Repeated rows count once in the fit and
are all returned. Entries beyond 2^34 count as 2^34. ``deviation`` is null where it exceeds a long.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotweave.llm.common import list_column, written
from lotweave.llm.eigen import leading

#: Grid steps a unit, and the number that keeps the grid's values above zero.
GRID, SHIFT = 64, 1_000_000
LARGEST = float(1 << 34)
NO_SCALE = 1e-12


def gridded(vectors: DataFrame) -> DataFrame:
    """(vec_id, x array<bigint>) of rows whose vector is whole and finite."""
    whole = F.col("embedding").isNotNull() & F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    inside = lambda c: F.greatest(F.least(c.cast("double"), F.lit(LARGEST)), F.lit(-LARGEST))
    x = F.transform("embedding", lambda c: F.floor(inside(c) * GRID).cast("bigint") + SHIFT)
    return vectors.filter(whole).select(F.col("vec_id").cast("bigint"), x.alias("x"))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, d)


def _added(rows: DataFrame, d: int, width: int, kind: str, part) -> np.ndarray:
    """Sum over all rows of ``part(matrix)``, an array (height, width): each task adds its own, Spark the tasks'."""
    def run(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                one = part(_matrix(batch.column(0), d))
                total = one if total is None else total + one
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), list_column(list(total), pa.int64() if kind == "bigint" else pa.float64())],
                                             names=["i", "v"])

    parts = rows.select("x").mapInArrow(run, f"i int, v array<{kind}>").select("i", F.posexplode("v").alias("j", "v"))
    got = parts.groupBy("i", "j").agg(F.sum("v").alias("v")).collect()  # height * width entries
    out = np.zeros((max((r["i"] for r in got), default=-1) + 1, width), np.int64 if kind == "bigint" else np.float64)
    for r in got:
        out[r["i"], r["j"]] = r["v"]
    return out


class Fit:
    """Number of distinct vectors, their sums, and the components with their scales."""

    def __init__(self, listed: DataFrame, d: int, most: int):
        sums = _added(listed, d, d + 1, "bigint", lambda x: np.concatenate((x.sum(axis=0), [len(x)]))[None, :])[0]
        self.n, self.sums = int(sums[d]), sums[:d]
        n, s = self.n, self.sums
        covariance = _added(listed, d, d, "double", lambda x: _product((x * n - s) / n)) / n
        values, columns = leading((covariance + covariance.T) / 2, most)
        keep = values > NO_SCALE * max(values[0], 0.0)
        self.values, self.columns = values[keep], columns[:, keep]
        self.scaled = self.columns / np.sqrt(self.values)
        trace = float(np.trace(covariance))
        self.explained = self.values / trace if trace > 0 else self.values
        k, scaled = len(self.values), self.scaled
        self.identity_error = 0.0
        if k:
            after = _added(listed, d, k, "double", lambda x: _product(((x * n - s) / n) @ scaled)) / n
            self.identity_error = float(np.abs(after - np.eye(k)).max())


def _product(centred: np.ndarray) -> np.ndarray:
    return centred.T @ centred


OUT = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


def _project(rows: DataFrame, fit: Fit, d: int) -> DataFrame:
    n, s, scaled, explained, error = fit.n, fit.sums, fit.scaled, fit.explained, fit.identity_error
    k = scaled.shape[1]

    def run(batches):
        for batch in batches:
            size = batch.num_rows
            if not size:
                continue
            off = _matrix(batch.column(1), d) * n - s
            far = (off.astype(np.float64) ** 2).sum(axis=1) > 9.2e18
            deviation = pa.array((off * off).sum(axis=1), mask=far)
            white = (off / n) @ scaled
            rows_at = pa.array(np.repeat(np.arange(size), k))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(rows_at), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), size)), pa.array(np.full(size * k, n)),
                 deviation.take(rows_at), pa.array(white.ravel()), pa.array(np.tile(explained, size)), pa.array(np.full(size * k, error))],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.select("vec_id", "x").mapInArrow(run, OUT)


def whiten(vectors: DataFrame, most: int = 16) -> DataFrame:
    """One row per vector and component up to ``most``: see the module for the columns' rules."""
    rows = gridded(vectors)
    listed = written(rows.select("x").distinct(), "fit-list")
    out = rows.sparkSession.createDataFrame([], OUT)
    # one round a vector length; a table of embeddings has one
    for d in sorted(r["d"] for r in listed.select(F.size("x").alias("d")).distinct().collect()):
        if not d:
            continue
        same = F.size("x") == d
        fit = Fit(listed.filter(same), d, most)
        if len(fit.values):
            out = out.unionByName(_project(rows.filter(same), fit, d))
    return out
