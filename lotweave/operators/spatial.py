"""Spatial joins between parcels, hazard and zoning layers, and among parcels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotweave.functions import geometry as g
from lotweave.functions import vocab
from lotweave.operators.cells import box_pairs, radius_pairs, self_box_pairs
from lotweave.session import cut_lineage

HAZARD_LAYERS = ("has_flood", "has_fault", "has_liquefaction", "is_fire_zone", "is_steep", "in_esa", "in_mscp")


def with_box(df: DataFrame, geom: str = "geom") -> DataFrame:
    """Add ``box`` (null without geometry) and ``boxy`` (the shape equals its box)."""
    return df.withColumn("box", g.bounds(F.col(geom))).withColumn("boxy", g.is_box(F.col(geom)))


def _exact_intersects(l: Column, r: Column) -> Column:
    """Two axis-aligned boxes that overlap always intersect; other shapes need the full test."""
    return (l["boxy"] & r["boxy"]) | g.intersects(l["geom"], r["geom"])


def all_boxes(*layers: DataFrame) -> bool:
    """Whether every shape equals its box, so that comparing boxes is exact."""
    return all(layer.filter("NOT boxy").isEmpty() for layer in layers)


def intersecting(left: DataFrame, right: DataFrame) -> DataFrame:
    """(l, r) row pairs whose geometries intersect."""
    left, right = cut_lineage(with_box(left)), cut_lineage(with_box(right))
    pairs = box_pairs(left, right, written=True)
    return pairs if all_boxes(left, right) else pairs.filter(_exact_intersects(F.col("l"), F.col("r")))


def extent(df: DataFrame) -> DataFrame:
    """One row: total bounds of a layer."""
    box = g.bounds(F.col("geom"))
    return df.select(box.alias("b")).agg(
        F.min("b.xmin").alias("xmin"), F.min("b.ymin").alias("ymin"),
        F.max("b.xmax").alias("xmax"), F.max("b.ymax").alias("ymax"))


def clip_to_extent(layer: DataFrame, parcels: DataFrame) -> DataFrame:
    """Layer rows whose box meets the parcels' total bounds (a one-row range filter)."""
    total = extent(parcels).select(F.struct("*").alias("_t"))
    box, t = F.col("_b"), F.col("_t")
    meets = ((box["xmin"] <= t["xmax"]) & (box["xmax"] >= t["xmin"])
             & (box["ymin"] <= t["ymax"]) & (box["ymax"] >= t["ymin"]))
    return (layer.withColumn("_b", g.bounds(F.col("geom"))).crossJoin(F.broadcast(total))
            .filter(meets).drop("_b", "_t"))


def hazard_flags(parcels: DataFrame, hazards: DataFrame, key: str = "pos",
                 layers: Sequence[str] = HAZARD_LAYERS) -> DataFrame:
    """Parcels with one 0/1 column per layer, all layers in one pass.

    ``hazards`` is the union of the layers with their name in ``layer``; a layer without rows
    gives 0 everywhere.
    """
    hit = intersecting(parcels.select(key, "geom"), clip_to_extent(hazards, parcels).select("layer", "geom"))
    flags = hit.groupBy(F.col(f"l.{key}").alias(key)).agg(*[
        F.max((F.col("r.layer") == name).cast("tinyint")).alias(name) for name in layers])
    return parcels.join(flags, key, "left").fillna(0, list(layers))


def first_per_column(parcels: DataFrame, layer: DataFrame, columns: Mapping[str, str], key: str = "pos") -> DataFrame:
    """Left spatial join; per parcel and column the first non-null value by layer row number.

    Columns are picked independently, so one output row can mix two layer rows. ``layer`` has
    ``rn`` (its row number); ``columns`` maps layer column to output column.
    """
    return first_per_layer(parcels, [(layer, columns)], key)


def first_per_layer(parcels: DataFrame, layers: Sequence[tuple[DataFrame, Mapping[str, str]]], key: str = "pos") -> DataFrame:
    """:func:`first_per_column` for several layers in one spatial join over their union."""
    outs = [o for _, columns in layers for o in columns.values()]
    tagged = None
    for i, (layer, columns) in enumerate(layers):
        filled = {o: F.col(s) for s, o in columns.items()}
        rows = layer.select("rn", "geom", F.lit(i).alias("layer"), *[filled.get(o, F.lit(None)).alias(o) for o in outs])
        tagged = rows if tagged is None else tagged.unionByName(rows)
    hit = intersecting(parcels.select(key, "geom"), tagged)
    picked = hit.groupBy(F.col(f"l.{key}").alias(key)).agg(*[
        F.min_by(F.col(f"r.{o}"), F.when(F.col(f"r.{o}").isNotNull(), F.col("r.rn"))).alias(o) for o in outs])
    return parcels.join(picked, key, "left")


def adjacency(parcels: DataFrame, predicate: str = "touches", order: str = "pos") -> DataFrame:
    """Edges (a, b) with a < b; rows without geometry have none."""
    if predicate not in ("touches", "intersects"):
        raise ValueError("predicate must be touches or intersects")
    flat = cut_lineage(with_box(parcels.select(order, "geom")))
    pairs, plain = self_box_pairs(flat, order, written=True), all_boxes(flat)
    l, r = F.col("l"), F.col("r")
    if predicate == "intersects":
        test = F.lit(True) if plain else _exact_intersects(l, r)
    else:
        both = l["boxy"] & r["boxy"]
        a, b = l["box"], r["box"]
        edge_only = ((a["xmin"] == b["xmax"]) | (a["xmax"] == b["xmin"])
                     | (a["ymin"] == b["ymax"]) | (a["ymax"] == b["ymin"]))
        test = edge_only if plain else F.when(both, edge_only).otherwise(g.touches(l["geom"], r["geom"]))
    return pairs.filter(test).select(l[order].alias("a"), r[order].alias("b"))


def neighbour_lists(edges: DataFrame, parcels: DataFrame, order: str = "pos") -> DataFrame:
    """Every parcel with its sorted neighbour positions (empty when it has none)."""
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    lists = both.groupBy("a").agg(F.sort_array(F.collect_set("b")).alias("neighbours"))
    return parcels.select(order).join(lists, F.col(order) == F.col("a"), "left").select(
        order, F.coalesce("neighbours", F.array().cast("array<bigint>")).alias("neighbours"))


def neighbour_pairs(parcels: DataFrame, radius_m: float | None, order: str = "pos", key: str = "parcel_id", within: str | None = None) -> DataFrame:
    """Unique (left_id, right_id, distance_m) with centroids within the radius, left first in order.

    With ``within`` only pairs that agree in that column, which comes first.
    """
    own = [within] if within else []
    try:
        radius = float(radius_m)
    except (TypeError, ValueError):
        radius = 0.0
    pts = parcels.select(order, key, "lon", "lat", *own)
    if not radius > 0.0:
        return pts.filter(F.lit(False)).select(
            *own, F.col(key).alias("left_id"), F.col(key).alias("right_id"), F.lit(0.0).alias("distance_m"))
    agree = F.col(f"l.{within}").eqNullSafe(F.col(f"r.{within}")) if within else F.lit(True)
    return (radius_pairs(pts, pts, radius).filter((F.col(f"l.{order}") < F.col(f"r.{order}")) & agree)
            .select(*[F.col(f"l.{c}").alias(c) for c in own], F.col(f"l.{key}").alias("left_id"), F.col(f"r.{key}").alias("right_id"), "distance_m"))


def nearby(centres: DataFrame, parcels: DataFrame, radius_m: float) -> DataFrame:
    """(centre_id, parcel_id, distance_m rounded to mm) within the radius, the centre itself included."""
    if not 0 < radius_m <= 5000:
        raise ValueError("radius_m must be in (0, 5000]")
    pairs = radius_pairs(parcels.select("parcel_id", "lon", "lat"), centres.select("parcel_id", "lon", "lat"), radius_m)
    return pairs.select(F.col("r.parcel_id").alias("centre_id"), F.col("l.parcel_id").alias("parcel_id"),
                        F.round("distance_m", 3).alias("distance_m"))


def box_select(features: DataFrame, xmin: float, ymin: float, xmax: float, ymax: float) -> DataFrame:
    """Features whose bounding box meets the selection box; edges count."""
    b = g.bounds(F.col("geom"))
    return features.filter((b["xmin"] <= xmax) & (b["xmax"] >= xmin) & (b["ymin"] <= ymax) & (b["ymax"] >= ymin))


def in_viewport(features: DataFrame, xmin: float, ymin: float, xmax: float, ymax: float) -> DataFrame:
    """Features with any vertex of the first ring inside the bounds."""
    ring = F.get(F.get(F.col("geom"), F.lit(0)), F.lit(0))
    return features.filter(F.exists(ring, lambda p: p["x"].between(xmin, xmax) & p["y"].between(ymin, ymax)))


def hazard_any(fields_flag, names: Sequence[str] = vocab.METRIC_HAZARD_FLAGS) -> Column:
    return F.greatest(*[fields_flag(n) for n in names]) == 1
