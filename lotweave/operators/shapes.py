"""New shapes from parcels: buffers, subdivision, grid overlay and Voronoi regions.

All work is in metric coordinates; numpy runs per row or per bounded tile.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotweave.functions import geometry as g
from lotweave.operators.spatial import extent, with_box

BUFFERED_ROWS = 2000  # parcels whose buffers are made together
CELLS = 256  # cells of a parcel that one row of a subdivision holds
RING_ARRAYS = pa.list_(pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))))
POLYGON = f"array<array<array<{g.POINT}>>>"


def small_batches(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in the same order, at most ``rows`` to a batch."""
    for whole in batches:
        for at in range(0, whole.num_rows, rows):
            yield whole.slice(at, rows)


def _ring(points: np.ndarray) -> list[list[list[dict]]]:
    closed = points if len(points) and (points[0] == points[-1]).all() else np.vstack([points, points[:1]])
    return [[[{"x": float(x), "y": float(y)} for x, y in closed]]]


def _open_ring(geom) -> np.ndarray:
    """Counter-clockwise corners of the outer ring without the closing point."""
    r = np.array([[p["x"], p["y"]] for p in geom[0][0]], dtype=float)
    r = r[:-1] if (r[0] == r[-1]).all() else r
    x, y = r[:, 0], r[:, 1]
    return r if (x * np.roll(y, -1) - np.roll(x, -1) * y).sum() >= 0 else r[::-1]


def _counter_clockwise(r: np.ndarray) -> np.ndarray:
    """Open rings (rings x corners x 2), those drawn clockwise turned round."""
    x, y = np.ascontiguousarray(r[..., 0]), np.ascontiguousarray(r[..., 1])
    turned = ~((x * np.roll(y, -1, axis=1) - np.roll(x, -1, axis=1) * y).sum(axis=1) >= 0)
    return np.where(turned[:, None, None], r[:, ::-1], r)


def _convex(r: np.ndarray) -> np.ndarray:
    e = np.roll(r, -1, axis=1) - r
    n = np.roll(e, -1, axis=1)
    return (e[..., 0] * n[..., 1] - e[..., 1] * n[..., 0] >= -1e-9).all(axis=1)


def buffered_rings(corners: np.ndarray, distance: float, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Closed outlines of convex rings (rings x corners x 2) grown by ``distance``, behind each other, and their sizes.

    Each corner arc has ``steps`` parts per quarter turn.
    """
    rings, per_ring = corners.shape[:2]
    e = np.roll(corners, -1, axis=1) - corners
    out = np.arctan2(-e[..., 0], e[..., 1])  # outward normal angle of each edge
    a = np.roll(out, 1, axis=1)
    turn = (out - a) % (2 * math.pi)
    n = np.maximum(1, np.ceil(turn / (math.pi / 2) * steps)).astype(np.int64).reshape(-1)
    ends = np.cumsum(n + 1)
    step = np.arange(ends[-1]) - np.repeat(ends - (n + 1), n + 1)
    wide = lambda v: np.repeat(v.reshape(-1), n + 1)
    t = wide(a) + wide(turn) * step / wide(n)
    points = np.column_stack([wide(corners[..., 0]) + distance * np.cos(t), wide(corners[..., 1]) + distance * np.sin(t)])
    last = ends[per_ring - 1::per_ring]
    first = np.concatenate([[0], last[:-1]])
    open_ends = (points[first] != points[last - 1]).any(axis=1)
    return np.insert(points, last[open_ends], points[first[open_ends]], axis=0), last - first + open_ends


def _single_rings(geom: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of shapes with one ring of at least four points, where each ring begins in the points, and its size; and the points."""
    rows, parts = np.arange(len(geom)), geom
    for _ in range(2):  # polygons of a shape, then rings of a polygon
        one = pc.fill_null(pc.equal(pc.list_value_length(parts), 1), False)
        rows, parts = rows[one.to_numpy(zero_copy_only=False)], parts.filter(one).flatten()
    enough = pc.fill_null(pc.greater_equal(pc.list_value_length(parts), 4), False)
    rows, parts = rows[enough.to_numpy(zero_copy_only=False)], parts.filter(enough)
    points = np.column_stack([c.to_numpy(zero_copy_only=False) for c in parts.flatten().flatten()]).reshape(-1, 2).astype(float)
    return rows, pc.list_value_length(parts).to_numpy(zero_copy_only=False), points


def _ring_arrays(points: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Shapes of one ring each, as nested lists of points."""
    flat = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(points[:, i])) for i in (0, 1)], ["x", "y"])
    rings = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), flat)
    each = pa.array(np.arange(len(sizes) + 1, dtype=np.int32))
    return pa.ListArray.from_arrays(each, pa.ListArray.from_arrays(each, rings))


def buffer_zones(parcels: DataFrame, distance: float = 50.0, units: str = "meters", steps: int = 16, key: str = "parcel_id") -> tuple[DataFrame, DataFrame]:
    """(buffers, rejects): grown outlines of convex single-ring parcels in metric coordinates.

    Other shapes go to the rejects table. Rings with equally many corners are worked on together.
    """
    if distance <= 0:
        raise ValueError("distance must be greater than zero")
    rows = parcels.select(key, g.mercator(F.col("geom")).alias("geom"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, BUFFERED_ROWS):
            keys = batch.column(0)
            at, sizes, points = _single_rings(batch.column(1))
            starts = np.cumsum(sizes) - sizes
            corners = sizes - (points[starts] == points[starts + sizes - 1]).all(axis=1)
            rejected = np.ones(batch.num_rows, dtype=bool)
            for m in np.unique(corners):
                own = np.flatnonzero(corners == m)
                r = _counter_clockwise(points[starts[own][:, None] + np.arange(m)])
                good = _convex(r)
                if good.any():
                    rejected[at[own[good]]] = False
                    yield pa.RecordBatch.from_arrays([keys.take(pa.array(at[own[good]])), _ring_arrays(*buffered_rings(r[good], distance, steps))], names=[key, "geom"])
            if rejected.any():
                lost = keys.filter(pa.array(rejected))
                yield pa.RecordBatch.from_arrays([lost, pa.nulls(len(lost), RING_ARRAYS)], names=[key, "geom"])

    made = rows.mapInArrow(run, f"{key} {parcels.schema[key].dataType.simpleString()}, geom {POLYGON}")
    done = made.filter(F.col("geom").isNotNull()).withColumn("buffer_distance", F.lit(float(distance))).withColumn("buffer_units", F.lit(units))
    return done, made.filter(F.col("geom").isNull()).select(key)


def _beyond(pts: list, axis: int, bound: float, keep_low: bool) -> list:
    """Part of an open ring on one side of a line, corner by corner."""
    out = []
    inside = [(p[axis] <= bound) if keep_low else (p[axis] >= bound) for p in pts]
    for i, (b, b_in) in enumerate(zip(pts, inside)):
        if inside[i - 1] != b_in:
            a = pts[i - 1]
            share = (bound - a[axis]) / (b[axis] - a[axis])
            out.append((a[0] + (b[0] - a[0]) * share, a[1] + (b[1] - a[1]) * share))
        if b_in:
            out.append(b)
    return out


def _between(pts: list, axis: int, low: float, high: float) -> list:
    return _beyond(_beyond(pts, axis, low, False), axis, high, True)


def _area(pts) -> float:
    if len(pts) < 3:
        return 0.0
    if len(pts) < 8:  # a plain loop, which numpy also adds in this order
        x0, y0 = pts[0]
        at = [(float(x) - float(x0), float(y) - float(y0)) for x, y in pts]
        return abs(sum(x * at[(i + 1) % len(at)][1] - at[(i + 1) % len(at)][0] * y for i, (x, y) in enumerate(at))) / 2
    x, y = (np.array(pts) - np.array(pts[0])).T
    return abs(float((x * np.roll(y, -1) - np.roll(x, -1) * y).sum())) / 2


def _closed(pts: list) -> list[dict]:
    return [{"x": x, "y": y} for x, y in (pts if pts[0] == pts[-1] else [*pts, pts[0]])]


def subdivide(parcels: DataFrame, target_area: float = 1000.0, min_area: float = 100.0, key: str = "parcel_id") -> DataFrame:
    """Parcels below the target stay whole; others are cut by an n x n grid over their box.

    Blocks of a parcel's cells are exploded in Spark and each clipped on its own; a block clips a column of
    its cells once. ``k`` numbers the kept cells of a parcel from the lower left.
    """
    if target_area <= 0 or min_area <= 0:
        raise ValueError("areas must be greater than zero")
    if min_area > target_area:
        raise ValueError("min_area cannot exceed target_area")
    m = parcels.select(key, g.mercator(F.col("geom")).alias("geom"))
    m = m.withColumn("area", g.planar_area(F.col("geom"))).withColumn("b", g.bounds(F.col("geom")))
    whole = m.filter(F.col("area") < target_area).select(
        key, "geom", "area", F.lit(None).cast("string").alias("subdivision_id"), F.lit(None).cast(m.schema[key].dataType).alias("parent_id"))
    n = F.greatest(F.lit(1), F.floor(F.sqrt(F.col("area") / target_area)).cast("int"))
    cut = m.filter(F.col("area") >= target_area).withColumn("n", n)
    # a row per parcel and block of at most CELLS cells, numbered like the cells
    blocks = cut.withColumn("at", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n").cast("bigint") * F.col("n") - 1, F.lit(CELLS).cast("bigint"))))
    rows = blocks.select(key, "geom", "n", "at", *[F.col(f"b.{e}").alias(e) for e in ("xmin", "ymin", "xmax", "ymax")])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keys, ks, geoms, areas = [], [], [], []
            for own, geom, n, at, xmin, ymin, xmax, ymax in zip(*[pdf[c] for c in (key, "geom", "n", "at", "xmin", "ymin", "xmax", "ymax")]):
                rings = [[[tuple(p) for p in _open_ring([[r]]).tolist()] for r in poly] for poly in geom]
                n, at = int(n), int(at)
                cw, ch, strips = (xmax - xmin) / n, (ymax - ymin) / n, {}
                for k in range(at, min(at + CELLS, n * n)):
                    i, j = divmod(k, n)
                    if j not in strips:
                        x0 = xmin + j * cw
                        strips[j] = [[_between(r, 0, x0, x0 + cw) for r in poly] for poly in rings]
                    y0 = ymin + i * ch
                    polygons, total = [], 0.0
                    for poly in strips[j]:
                        parts = [_between(r, 1, y0, y0 + ch) for r in poly]
                        if _area(parts[0]) > 0:
                            kept_rings = [r for r in parts if _area(r) > 0]
                            polygons.append([_closed(r) for r in kept_rings])
                            total += _area(parts[0]) - sum(_area(r) for r in kept_rings[1:])
                    keys.append(own), ks.append(k), geoms.append(polygons or None), areas.append(total)
                if len(keys) >= 4 * CELLS:
                    yield pd.DataFrame({key: keys, "k": ks, "geom": geoms, "area": areas})
                    keys, ks, geoms, areas = [], [], [], []
            if keys:
                yield pd.DataFrame({key: keys, "k": ks, "geom": geoms, "area": areas})

    clipped = rows.mapInPandas(run, f"{key} {m.schema[key].dataType.simpleString()}, k int, geom {POLYGON}, area double")
    pieces = clipped.filter(F.col("area") >= min_area).select(
        key, "geom", "area", F.concat_ws("_", F.col(key).cast("string"), F.col("k").cast("string")).alias("subdivision_id"), F.col(key).alias("parent_id"))
    return whole.unionByName(pieces)


def grid_overlay(parcels: DataFrame, cell_size: float = 100.0) -> DataFrame:
    """Cells of a grid over the total bounds that intersect a parcel: (gx, gy, geom), metric coordinates.

    Each parcel proposes the cells its box covers; a cell is kept when one exact test holds.
    """
    if cell_size <= 0:
        raise ValueError("cell_size must be greater than zero")
    m = parcels.select(g.mercator(F.col("geom")).alias("geom"))
    total = extent(m).select(F.struct("*").alias("t"))
    boxed = with_box(m).filter(F.col("box").isNotNull()).crossJoin(F.broadcast(total))

    def span(axis: str) -> Column:
        low = F.ceil((F.col(f"box.{axis}min") - F.col(f"t.{axis}min")) / cell_size) - 1
        high = F.floor((F.col(f"box.{axis}max") - F.col(f"t.{axis}min")) / cell_size)
        last = F.ceil((F.col(f"t.{axis}max") - F.col(f"t.{axis}min")) / cell_size) - 1
        return F.sequence(F.greatest(low, F.lit(0)), F.greatest(F.least(high, last), F.greatest(low, F.lit(0))))

    cand = boxed.withColumn("gx", F.explode(span("x"))).withColumn("gy", F.explode(span("y")))
    x0, y0 = F.col("t.xmin") + F.col("gx") * cell_size, F.col("t.ymin") + F.col("gy") * cell_size
    cand = cand.withColumn("cell", g.rectangle(x0, y0, x0 + cell_size, y0 + cell_size))
    hit = cand.filter(F.col("boxy") | g.intersects(F.col("geom"), F.col("cell")))
    return hit.groupBy("gx", "gy").agg(F.any_value("cell").alias("geom"))


def number_cells(cells: DataFrame) -> DataFrame:
    """cell_id 0, 1, 2, ... column by column, without sorting all cells in one task."""
    from lotweave.operators.prefix import running_sum

    one = cells.withColumn("_one", F.lit(1)).withColumn("_all", F.lit(0))
    return running_sum(one, ["_all"], "gx", "_one", "_n", tiebreak=["gy"]).withColumn(
        "cell_id", F.col("_n") - 1).drop("_one", "_all", "_n")


# ---- Voronoi -----------------------------------------------------------------------------

def _half_plane(poly: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Part of a convex polygon nearer to p than to q."""
    normal, mid = q - p, (p + q) / 2
    side = (poly - mid) @ normal
    out = []
    for i in range(len(poly)):
        a, b, sa, sb = poly[i - 1], poly[i], side[i - 1], side[i]
        if (sa <= 0) != (sb <= 0):
            out.append(a + (b - a) * (sa / (sa - sb)))
        if sb <= 0:
            out.append(b)
    return np.array(out).reshape(-1, 2)


def _regions(pdf: pd.DataFrame, box: tuple[float, float, float, float]) -> tuple[list, list, list]:
    """Regions of a tile's open points against all points of the tile and its halo.

    Also the distance up to which other points could still cut each region, and the points that cut it.
    """
    pts, names = pdf[["x", "y"]].to_numpy(), pdf["spot"].to_numpy()
    frame = np.array([[box[0], box[1]], [box[2], box[1]], [box[2], box[3]], [box[0], box[3]]], dtype=float)
    shapes, reach, cutters = [], [], []
    for i in np.nonzero(pdf["own"].to_numpy())[0]:
        d = np.hypot(*(pts - pts[i]).T)
        poly, cut = frame, []
        for j in np.argsort(d):
            if d[j] == 0:
                continue
            if d[j] > 2 * np.hypot(*(poly - pts[i]).T).max():
                break
            smaller = _half_plane(poly, pts[i], pts[j])
            if len(smaller) != len(poly) or not np.array_equal(smaller, poly):
                cut.append(names[j])
            poly = smaller
        shapes.append(poly)
        reach.append(2 * np.hypot(*(poly - pts[i]).T).max())
        cutters.append(cut)
    return shapes, reach, cutters


def _first_edge(spots: DataFrame, edge: float, most: int) -> float:
    """Shrink the tile edge until no tile holds more than ``most`` points."""
    while True:
        tiles = spots.groupBy(F.floor(F.col("x") / edge), F.floor(F.col("y") / edge)).count()
        if (tiles.agg(F.max("count")).first()[0] or 0) <= most or edge < 1e-6:
            return edge
        edge /= 4


def voronoi(parcels: DataFrame, key: str = "parcel_id", per_tile: int = 256, most: int = 2048) -> DataFrame:
    """(key, geom, area) nearest-centroid regions inside the total bounds, metric coordinates.

    Points are cut into square tiles, each seeing its eight neighbour tiles. A region is final
    when no point outside that view can reach it. The rest go to the next round with tiles four
    times as wide. A finished point stays in view there only if an unfinished one cut its region,
    so the inside of a dense town leaves the work early and tiles stay small. Points that
    coincide share one region.
    """
    from lotweave.session import cut_lineage

    m = parcels.select(key, g.mercator(F.col("geom")).alias("geom"))
    total = extent(m).first()
    if total is None or total["xmin"] is None:
        return m.select(key, "geom", F.lit(0.0).alias("area"))
    c = g.centroid(F.col("geom"))
    pts = m.filter(F.col("geom").isNotNull()).select(key, c["x"].alias("x"), c["y"].alias("y"))
    kind = f"array<{parcels.schema[key].dataType.simpleString()}>"
    sites = cut_lineage(pts.groupBy("x", "y").agg(F.min(key).alias("spot")).select(
        "spot", "x", "y", F.lit(True).alias("open"), F.array().cast(kind).alias("cutters")))
    box = (total["xmin"], total["ymin"], total["xmax"], total["ymax"])
    widest = max(box[2] - box[0], box[3] - box[1])
    start = math.sqrt(max((box[2] - box[0]) * (box[3] - box[1]), 1e-9) * per_tile / max(sites.count(), 1))
    edge, done = _first_edge(sites, start, most), None
    while True:
        last = edge >= widest
        found = cut_lineage(_tile_regions(sites, edge, box, last))
        final = found.filter("final").select("spot", "geom", "area")
        done = final if done is None else done.unionByName(final)
        still_open = found.filter(~F.col("final")).select("spot")
        if last or still_open.isEmpty():
            break
        fresh = found.select("spot", "final", F.col("cutters").alias("_cut"))
        state = sites.join(fresh, "spot", "left").select(
            "spot", "x", "y", (F.col("open") & ~F.coalesce("final", F.lit(True))).alias("open"),
            F.coalesce("_cut", "cutters").alias("cutters"))
        touching = (state.filter(~F.col("open")).select(F.col("spot").alias("near"), F.explode("cutters").alias("spot"))
                    .join(still_open, "spot", "left_semi").select(F.col("near").alias("spot")))
        keep = still_open.unionAll(touching).distinct()
        sites = cut_lineage(state.join(keep, "spot", "left_semi"))
        edge *= 4
    located = pts.join(pts.groupBy("x", "y").agg(F.min(key).alias("spot")), ["x", "y"]).select(key, "spot")
    return located.join(done, "spot").drop("spot")


def _tile_regions(sites: DataFrame, edge: float, box, last: bool) -> DataFrame:
    tile = lambda a: F.floor(F.col(a) / edge)
    tiled = sites.select("spot", "x", "y", "open", tile("x").alias("hx"), tile("y").alias("hy"))
    wanted = tiled.filter("open").select(F.col("hx").alias("tx"), F.col("hy").alias("ty")).distinct()
    near = (tiled.withColumn("tx", F.explode(F.sequence(F.col("hx") - 1, F.col("hx") + 1)))
            .withColumn("ty", F.explode(F.sequence(F.col("hy") - 1, F.col("hy") + 1)))
            .join(wanted, ["tx", "ty"], "left_semi")
            .withColumn("own", F.col("open") & (F.col("tx") == F.col("hx")) & (F.col("ty") == F.col("hy"))))
    kind = sites.schema["spot"].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        shapes, reach, cutters = _regions(pdf, box)
        mine = pdf[pdf["own"]]
        tx, ty = float(pdf["tx"].iloc[0]) * edge, float(pdf["ty"].iloc[0]) * edge
        room = np.minimum.reduce([
            mine["x"] - (tx - edge), mine["y"] - (ty - edge), tx + 2 * edge - mine["x"], ty + 2 * edge - mine["y"]])
        return pd.DataFrame({
            "spot": mine["spot"], "geom": [_ring(s) if len(s) else None for s in shapes], "area": [_area(s) for s in shapes],
            "final": np.array(reach) <= np.array(room) if not last else np.ones(len(mine), dtype=bool), "cutters": cutters})

    return near.groupBy("tx", "ty").applyInPandas(
        run, f"spot {kind}, geom {POLYGON}, area double, final boolean, cutters array<{kind}>")
