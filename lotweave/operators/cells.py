"""Spatial joins turned into equi-joins on grid cells.

Two layouts are used:

* ``box_pairs`` files every shape under a cell of its own size class (powers of four) and lets
  the other side look it up at each size class in use. A downtown of tiny parcels therefore
  never lands in the cells sized for rural ones, and a county-wide polygon is filed once or a
  few times instead of once per small cell. Layers that do not overlap keep a bounded number
  of shapes per cell, whatever the density.
* ``radius_pairs`` uses one cell size near the radius; the left point sits in one cell and the
  right point is copied to the cells its radius box covers.

Each pair is produced in exactly one cell (the one holding the lower left corner of the overlap
of the two boxes), so no distinct is needed.

A cell that holds more than ``LEAF`` rows of a side is crowded, whatever the input's size. Its denser
side is cut by a quadtree grown from counts: a node over ``LEAF`` rows is quartered, down to ``DEPTH``
levels; what lies on one spot is cut by a hash of the row. Each leaf knows the bounds of its rows, and
a row of the other side is copied to the leaves whose bounds meet its box. The equi-join then runs on
(cell, leaf), so no task holds more than ``LEAF`` rows of the denser side of a key. The shapes with
their boxes are written to the shared folder first, so boxes are computed once.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotweave.session import cut_lineage

FINEST_CLASS = -24  # smallest cell edge is 4 * 2**-24 coordinate units
METRES_PER_DEGREE = math.pi * 6_371_000.0 / 180.0


EDGES = ("xmin", "ymin", "xmax", "ymax")
LEAF = 2048  # rows of the denser side that meet under one key
DEPTH = 8  # a crowded cell has at most 4**DEPTH spots
FEW_SHAPES = 10_000  # rows of a side, each with its shape, that are broadcast
MOST_BROADCAST = 200_000  # cells, spots or leaves that are broadcast, each some 80 bytes; more are shuffled


def _size_class(xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    """Even exponent k with box extent <= 2**k."""
    extent = F.greatest(xmax - xmin, ymax - ymin, F.lit(2.0 ** FINEST_CLASS))
    return (F.ceil(F.log2(extent) / 2) * 2).cast("int")


def _prefixed(df: DataFrame, box: str, side: str) -> DataFrame:
    """Columns renamed to ``side_name``, the box as four plain columns, and the size class.

    Rows stay flat until the pairs are found: Spark prunes plain columns through the cell
    explosion, and a row without a box explodes to nothing.
    """
    edges = {f"{side}_{e}_": F.col(box)[e] for e in EDGES}
    flat = df.select(*[F.col(c).alias(f"{side}_{c}") for c in df.columns], *[c.alias(n) for n, c in edges.items()])
    return flat.withColumn(f"{side}_class_", _size_class(*[F.col(n) for n in edges]))


def _renamed(df: DataFrame, old: str, new: str) -> DataFrame:
    return df.toDF(*[new + c[len(old):] for c in df.columns])


# ---------------------------------------------------------------- crowded cells

def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= MOST_BROADCAST else df


def _equi(home: DataFrame, probe: DataFrame, keys: list[str]) -> DataFrame:
    """Equi-join that broadcasts a side only when its rows were counted and are few.

    Spark guesses a side's size from the compressed file under it and does not see the copies of an
    explosion, so left to itself it collects millions of rows on the driver.
    """
    if home.count() <= FEW_SHAPES:
        return F.broadcast(home).join(probe, keys)
    if probe.count() <= FEW_SHAPES:
        return home.join(F.broadcast(probe), keys)
    return home.hint("merge").join(probe.hint("merge"), keys)


def _hashable(df: DataFrame, keys: list[str]) -> list[Column]:
    return [F.col(f.name) for f in df.schema.fields if f.name not in keys and "map<" not in f.dataType.simpleString()]


def _spot(u: Column, v: Column) -> Column:
    """Morton code of a place in a cell, in cell units; places outside count as on the border."""
    side = 1 << DEPTH
    code = F.lit(0).cast("bigint")
    for name, shift in ((u, 0), (v, 1)):
        at = F.least(F.greatest(F.floor(name * side), F.lit(0)), F.lit(side - 1)).cast("bigint")
        for bit in range(DEPTH):
            code = code.bitwiseOR(F.shiftleft(F.shiftright(at, bit).bitwiseAND(F.lit(1)), 2 * bit + shift))
    return code


def quadtree(dense: DataFrame, keys: list[str], leaf: int = LEAF) -> tuple[DataFrame, DataFrame]:
    """(spots, leaves) of crowded cells. ``dense`` has the cell ``keys``, ``spot`` and a box u0, v0, u1, v1.

    ``spots`` says to which node (``level``, ``node``) a spot belongs and into how many ``blocks`` that
    node is cut; ``leaves`` has each node once, with the bounds of its rows.
    """
    bounds = [F.min("u0").alias("u0"), F.min("v0").alias("v0"), F.max("u1").alias("u1"), F.max("v1").alias("v1")]
    fine = cut_lineage(dense.groupBy(*keys, "spot").agg(F.count(F.lit(1)).alias("rows"), *bounds))
    levels = F.explode(F.sequence(F.lit(0), F.lit(DEPTH))).alias("level")
    up = fine.select("*", levels).withColumn("node", F.expr(f"shiftright(spot, 2 * ({DEPTH} - level))"))
    nodes = up.groupBy(*keys, "level", "node").agg(F.sum("rows").alias("held"), *bounds)
    fits = F.min(F.when(F.col("held") <= leaf, F.col("level")))
    own = up.select(*keys, "spot", "level", "node").join(nodes.select(*keys, "level", "node", "held"), [*keys, "level", "node"])
    own = own.groupBy(*keys, "spot").agg(F.coalesce(fits, F.lit(DEPTH)).alias("level")).withColumn("node", F.expr(f"shiftright(spot, 2 * ({DEPTH} - level))"))
    sized = nodes.withColumn("blocks", F.ceil(F.col("held") / leaf).cast("int")).drop("held")
    spots = cut_lineage(own.join(sized.select(*keys, "level", "node", "blocks"), [*keys, "level", "node"]))
    leaves = cut_lineage(spots.select(*keys, "level", "node").distinct().join(sized, [*keys, "level", "node"]))
    return spots, leaves


def cell_join(home: DataFrame, probe: DataFrame, keys: list[str], leaf: int | None = None) -> DataFrame:
    """Equi-join on the cell ``keys``; crowded cells are cut by a quadtree.

    Both sides carry their box in cell units: ``h_u0``, ``h_v0``, ``h_u1``, ``h_v1`` and ``p_...``.
    A pair whose boxes do not meet may be left out, so a test for that has to follow.
    """
    leaf = leaf or LEAF
    h, p = (df.groupBy(*keys).agg(F.count(F.lit(1)).alias(n)) for df, n in ((home, "_h"), (probe, "_p")))
    crowded = cut_lineage(h.hint("merge").join(p.hint("merge"), keys).filter(F.greatest("_h", "_p") > leaf).select(*keys, (F.col("_h") >= F.col("_p")).alias("_home")))
    cells = crowded.count()
    if not cells:
        return _equi(home, probe, keys)
    crowded = _small(crowded, cells)
    out = _equi(home.join(crowded, keys, "left_anti"), probe.join(crowded, keys, "left_anti"), keys)
    names = out.columns
    for dense, other, d, o, which in ((home, probe, "h", "p", F.col("_home")), (probe, home, "p", "h", ~F.col("_home"))):
        cut = crowded.filter(which).select(*keys)
        spot = _spot(F.col(f"{d}_u0"), F.col(f"{d}_v0"))
        rows = dense.join(cut, keys, "left_semi").withColumn("spot", spot)
        spots, leaves = quadtree(rows.select(*keys, "spot", *[F.col(f"{d}_{c}").alias(c) for c in ("u0", "v0", "u1", "v1")]), keys, leaf)
        rows = rows.join(_small(spots, spots.count()), [*keys, "spot"]).drop("spot")
        rows = rows.withColumn("block", F.pmod(F.xxhash64(*_hashable(dense, keys)), F.col("blocks")).cast("int")).drop("blocks")
        meets = F.lit(True)
        for axis in ("u", "v"):
            meets = meets & (F.col(f"{axis}0") <= F.col(f"{o}_{axis}1")) & (F.col(f"{axis}1") >= F.col(f"{o}_{axis}0"))
        copies = other.join(_small(leaves, leaves.count()), keys).filter(meets).drop("u0", "v0", "u1", "v1")
        copies = copies.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
        out = out.unionByName(rows.hint("merge").join(copies.hint("merge"), [*keys, "level", "node", "block"]).select(*names))
    return out


# ---------------------------------------------------------------- boxes


def _spread(df: DataFrame, klass: Column, side: str) -> DataFrame:
    """One row per cell of class ``klass`` the box touches."""
    sized = df.withColumn("_k", klass).withColumn("_edge", F.pow(F.lit(2.0), F.col("_k")))
    for axis in ("x", "y"):
        low = F.floor(F.col(f"{side}_{axis}min_") / F.col("_edge"))
        high = F.floor(F.col(f"{side}_{axis}max_") / F.col("_edge"))
        sized = sized.withColumn(f"_c{axis}", F.explode(F.sequence(low, high)))
    for axis, name in (("x", "u"), ("y", "v")):
        for end, n in (("min", 0), ("max", 1)):
            sized = sized.withColumn(f"{side}_{name}{n}", F.col(f"{side}_{axis}{end}_") / F.col("_edge") - F.col(f"_c{axis}"))
    return sized


def _match(home: DataFrame, probe: DataFrame) -> DataFrame:
    """Join filed shapes (``h_``) with probing shapes (``p_``) on class and cell."""
    keys = ["_k", "_cx", "_cy"]
    c = F.col
    overlap = ((c("h_xmin_") <= c("p_xmax_")) & (c("p_xmin_") <= c("h_xmax_"))
               & (c("h_ymin_") <= c("p_ymax_")) & (c("p_ymin_") <= c("h_ymax_")))
    first_cell = ((c("_cx") == F.floor(F.greatest("h_xmin_", "p_xmin_") / c("_edge")))
                  & (c("_cy") == F.floor(F.greatest("h_ymin_", "p_ymin_") / c("_edge"))))
    return cell_join(home, probe.drop("_edge"), keys).filter(overlap & first_cell)


def _probes(df: DataFrame, classes: DataFrame, strict: bool) -> DataFrame:
    """Copies of each row for every filed size class at or above (strict: above) its own."""
    own = F.col("p_class_")
    levels = F.filter("_classes", lambda k: (k > own) if strict else (k >= own))
    # one aggregate row of at most a few dozen integers
    probing = df.crossJoin(F.broadcast(classes)).withColumn("_at", F.explode(levels)).drop("_classes")
    return _spread(probing, F.col("_at"), "p").drop("_at")


def _filed(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    classes = df.agg(F.collect_set("h_class_").alias("_classes"))
    return _spread(df, F.col("h_class_"), "h"), classes


def _row(df: DataFrame, side: str) -> Column:
    return F.struct(*[F.col(f"{side}_{c}").alias(c) for c in df.columns])


def box_pairs(left: DataFrame, right: DataFrame, box: str = "box", written: bool = False) -> DataFrame:
    """All (l, r) pairs whose boxes overlap, each once; ``l`` and ``r`` are row structs.

    ``written``: the sides were written already, so their boxes are not computed twice.
    """
    keep = (lambda df: df) if written else cut_lineage
    l, r = keep(_prefixed(left, box, "h")), keep(_prefixed(right, box, "h"))
    right_home, right_classes = _filed(r)
    left_home, left_classes = _filed(l)
    small_left = _match(right_home, _probes(_renamed(l, "h", "p"), right_classes, strict=False))
    small_right = _match(left_home, _probes(_renamed(r, "h", "p"), left_classes, strict=True))
    return small_left.select(_row(left, "p").alias("l"), _row(right, "h").alias("r")).unionAll(
        small_right.select(_row(left, "h").alias("l"), _row(right, "p").alias("r")))


def self_box_pairs(df: DataFrame, order: str, box: str = "box", written: bool = False) -> DataFrame:
    """Unordered pairs of one table with overlapping boxes; ``l`` has the smaller ``order``."""
    flat = _prefixed(df, box, "h")
    flat = flat if written else cut_lineage(flat)
    home, classes = _filed(flat)
    found = _match(home, _probes(_renamed(flat, "h", "p"), classes, strict=False))
    h, p = F.col(f"h_{order}"), F.col(f"p_{order}")
    once = ((F.col("h_class_") != F.col("p_class_")) & (h != p)) | (h < p)
    first, second = F.when(h < p, _row(df, "h")).otherwise(_row(df, "p")), F.when(h < p, _row(df, "p")).otherwise(_row(df, "h"))
    return found.filter(once).select(first.alias("l"), second.alias("r"))


def radius_pairs(left: DataFrame, right: DataFrame, radius_m: float, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """(l, r, distance_m) for points within ``radius_m``; longitudes wrap at 180 degrees."""
    from lotweave.functions.geometry import haversine_m

    step = radius_m * 1.0001 / METRES_PER_DEGREE
    columns = max(1, int(360.0 / step))
    edge = 360.0 / columns
    a = (cut_lineage(left.select(*[F.col(c).alias(f"h_{c}") for c in left.columns]))
         .withColumn("_gx", F.floor((F.col(f"h_{lon}") + 180.0) / edge)).withColumn("_cx", F.pmod(F.col("_gx"), F.lit(columns)))
         .withColumn("_cy", F.floor(F.col(f"h_{lat}") / edge)))
    for n in "01":
        a = a.withColumn(f"h_u{n}", (F.col(f"h_{lon}") + 180.0) / edge - F.col("_gx")).withColumn(f"h_v{n}", F.col(f"h_{lat}") / edge - F.col("_cy"))
    a = a.drop("_gx")
    b = cut_lineage(right.select(*[F.col(c).alias(f"p_{c}") for c in right.columns]))
    x, y = F.col(f"p_{lon}"), F.col(f"p_{lat}")
    tallest = F.least(F.abs(y) + step, F.lit(90.0))
    reach = F.least(F.lit(step) / F.greatest(F.cos(F.radians(tallest)), F.lit(1e-9)), F.lit(179.999))
    low = F.floor((x - reach + 180.0) / edge)
    high = F.least(F.floor((x + reach + 180.0) / edge), low + columns - 1)
    b = (b.withColumn("_cy", F.explode(F.sequence(F.floor((y - step) / edge), F.floor((y + step) / edge))))
         .withColumn("_gx", F.explode(F.sequence(low, high)))
         .withColumn("_cx", F.pmod(F.col("_gx"), F.lit(columns)))
         .withColumn("p_u0", (x - reach + 180.0) / edge - F.col("_gx")).withColumn("p_u1", (x + reach + 180.0) / edge - F.col("_gx"))
         .withColumn("p_v0", (y - step) / edge - F.col("_cy")).withColumn("p_v1", (y + step) / edge - F.col("_cy")).drop("_gx"))
    distance = haversine_m(F.col(f"h_{lon}"), F.col(f"h_{lat}"), x, y)
    near = F.abs(F.col(f"h_{lat}") - y) <= step
    return (cell_join(a, b, ["_cx", "_cy"]).filter(near).withColumn("distance_m", distance).filter(F.col("distance_m") <= radius_m)
            .select(_row(left, "h").alias("l"), _row(right, "p").alias("r"), "distance_m"))
