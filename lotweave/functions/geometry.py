"""Geometry as nested arrays: polygons > rings > points (x, y).

Points and lines use the same nesting (one part, one open "ring"), so every measure and
predicate below works on the flattened segment list.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from lotweave.functions.rings import any_ring_crosses

POINT = "struct<x:double,y:double>"
GEOM_TYPE = f"array<array<array<{POINT}>>>"
EARTH_RADIUS_M = 6_371_000.0  # haversine sphere
MERCATOR_RADIUS_M = 6_378_137.0
AUTHALIC_RADIUS_M = 6_371_007.180918
WGS84_E = 0.0818191908426215
SMALL_RING = 64


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once; worth it inside array expressions, which are not compiled."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def rectangle(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Closed five-point polygon, counter-clockwise from the lower left corner."""
    return F.array(F.array(F.array(point(x0, y0), point(x1, y0), point(x1, y1), point(x0, y1), point(x0, y0))))


def from_coordinates(kind: Column, coords: Column) -> Column:
    """Geometry of a GeoJSON type and the text of its coordinates; null when unreadable."""
    def read(depth: int) -> Column:
        return F.from_json(coords, "array<" * depth + "double" + ">" * depth)

    def pt(p: Column) -> Column:
        return F.struct(F.get(p, 0).alias("x"), F.get(p, 1).alias("y"))

    def ring(r: Column) -> Column:
        return F.transform(r, pt)

    parsed = (
        F.when(kind == "Polygon", F.array(F.transform(read(3), ring)))
        .when(kind == "MultiPolygon", F.transform(read(4), lambda poly: F.transform(poly, ring)))
        .when(kind == "LineString", F.array(F.array(ring(read(2)))))
        .when(kind == "MultiLineString", F.transform(read(3), lambda line: F.array(ring(line))))
        .when(kind == "Point", F.array(F.array(F.array(pt(read(1))))))
        .when(kind == "MultiPoint", F.transform(read(2), lambda p: F.array(F.array(pt(p)))))
    )
    return let(parsed, lambda found: F.when(
        F.size(F.filter(vertices(found), lambda p: p["x"].isNotNull() & p["y"].isNotNull())) > 0, found))


def repair(geom: Column, geom_type: Column) -> Column:
    """Drop repeated neighbours and points with a missing part; close polygon rings."""
    def clean(r: Column) -> Column:
        whole = F.filter(r, lambda p: p["x"].isNotNull() & p["y"].isNotNull())
        return let(whole, lambda full: F.filter(full, lambda p, i: (i == 0) | (p != F.get(full, i - 1))))

    def close(r: Column) -> Column:
        open_ring = polygonal & (F.size(r) >= 3) & (F.get(r, F.lit(0)) != F.element_at(r, -1))
        return F.when(open_ring, F.concat(r, F.slice(r, 1, 1))).otherwise(r)

    polygonal = geom_type.isin("Polygon", "MultiPolygon")
    return F.transform(geom, lambda poly: F.transform(poly, lambda r: let(clean(r), close)))


def to_geojson(geom: Column, geom_type: Column) -> Column:
    """GeoJSON text of a Polygon, MultiPolygon or Point geometry."""
    coords = F.transform(geom, lambda poly: F.transform(poly, lambda r: F.transform(
        r, lambda p: F.array(p["x"], p["y"]))))
    head = F.concat(F.lit('{"type":"'), geom_type, F.lit('","coordinates":'))
    first = F.get(coords, F.lit(0))
    body = (F.when(geom_type == "Polygon", F.to_json(first))
            .when(geom_type == "Point", F.to_json(F.get(F.get(first, F.lit(0)), F.lit(0))))
            .otherwise(F.to_json(coords)))
    return F.concat(head, body, F.lit("}"))


def vertices(geom: Column) -> Column:
    return F.flatten(F.flatten(geom))


def _ring_segments(ring: Column) -> Column:
    def of(r: Column) -> Column:
        pairs = F.zip_with(
            F.slice(r, 1, F.size(r) - 1), F.slice(r, 2, F.size(r) - 1),
            lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")))
        alone = F.transform(r, lambda p: F.struct(
            p["x"].alias("x1"), p["y"].alias("y1"), p["x"].alias("x2"), p["y"].alias("y2")))
        return F.when(F.size(r) > 1, pairs).otherwise(alone)

    return let(ring, of)


def segments(geom: Column) -> Column:
    """All edges; a lone point gives one zero-length edge."""
    return F.flatten(F.transform(F.flatten(geom), _ring_segments))


def self_crossing(geom: Column, geom_type: Column) -> Column:
    """Whether two edges of one polygon ring cross; such a ring has no single inside.

    Small rings are compared edge by edge in the JVM; shapes with a ring beyond ``SMALL_RING``
    corners go to :mod:`lotweave.functions.rings`, which halves the plane and does not compare all pairs.
    Give the result a column of its own before filtering by it; a Python step inside a filter over
    parsed geometry is not always planned.
    """
    def crossed(ring: Column) -> Column:
        return let(_ring_segments(ring), lambda edges: F.exists(
            F.transform(edges, lambda p, i: F.exists(F.slice(edges, i + 2, F.size(edges)), lambda q: _cross_properly(p, q))), lambda hit: hit))

    rings = F.flatten(geom)
    large = F.exists(rings, lambda r: F.size(r) > SMALL_RING)
    flat = F.transform(rings, lambda r: F.flatten(F.transform(r, lambda p: F.array(p["x"], p["y"]))))
    polygonal = geom_type.isin("Polygon", "MultiPolygon")
    in_task = any_ring_crosses(F.when(polygonal & large, flat))
    return polygonal & F.coalesce(in_task, F.exists(F.filter(rings, lambda r: F.size(r) <= SMALL_RING), crossed), F.lit(False))


def bounds(geom: Column) -> Column:
    """Struct (xmin, ymin, xmax, ymax) over the finite vertices; null when there are none."""
    inf = float("inf")

    def corner(x0, y0, x1, y1) -> Column:
        return F.struct(x0.alias("xmin"), y0.alias("ymin"), x1.alias("xmax"), y1.alias("ymax"))

    def widen(b: Column, p: Column) -> Column:
        grown = corner(F.least(b["xmin"], p["x"]), F.least(b["ymin"], p["y"]), F.greatest(b["xmax"], p["x"]), F.greatest(b["ymax"], p["y"]))
        return F.when((F.abs(p["x"]) < inf) & (F.abs(p["y"]) < inf), grown).otherwise(b)

    return F.aggregate(vertices(geom), corner(F.lit(inf), F.lit(inf), F.lit(-inf), F.lit(-inf)), widen,
                       lambda b: F.when(b["xmin"] <= b["xmax"], b))


def mercator(geom: Column) -> Column:
    """EPSG:4326 to EPSG:3857."""
    return _each_point(geom, lambda p: point(
        F.radians(p["x"]) * MERCATOR_RADIUS_M,
        F.log(F.tan(F.lit(math.pi / 4) + F.radians(p["y"]) / 2)) * MERCATOR_RADIUS_M))


def unmercator(geom: Column) -> Column:
    """EPSG:3857 to EPSG:4326."""
    return _each_point(geom, lambda p: point(
        F.degrees(p["x"] / MERCATOR_RADIUS_M),
        F.degrees(F.atan(F.exp(p["y"] / MERCATOR_RADIUS_M)) * 2 - math.pi / 2)))


def _each_point(geom: Column, change) -> Column:
    return F.transform(geom, lambda poly: F.transform(poly, lambda r: F.transform(r, change)))


def _sum(items: Column, term) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda acc, s: acc + term(s))


def _ring_terms(r: Column) -> Column:
    """(double area, x moment, y moment) of a ring, relative to its first point."""
    def sums(origin: Column) -> Column:
        moved = F.transform(r, lambda p: point(p["x"] - origin["x"], p["y"] - origin["y"]))
        zero = F.struct(*[F.lit(0.0).alias(n) for n in ("twice", "mx", "my")])

        def add(acc: Column, s: Column) -> Column:
            return let(s["x1"] * s["y2"] - s["x2"] * s["y1"], lambda c: F.struct(
                (acc["twice"] + c).alias("twice"), (acc["mx"] + (s["x1"] + s["x2"]) * c).alias("mx"),
                (acc["my"] + (s["y1"] + s["y2"]) * c).alias("my")))

        return F.aggregate(_ring_segments(moved), zero, add, lambda t: F.struct(
            t["twice"].alias("twice"), t["mx"].alias("mx"), t["my"].alias("my"), origin["x"].alias("ox"), origin["y"].alias("oy")))

    return let(F.get(r, F.lit(0)), sums)


def _signed_rings(geom: Column) -> Column:
    """Outer rings count positive and holes negative, whatever their drawn direction."""
    def of_polygon(poly: Column) -> Column:
        return F.transform(poly, lambda r, i: F.struct(
            _ring_terms(r).alias("t"), F.when(i == 0, F.lit(1.0)).otherwise(-1.0).alias("role")))
    return F.flatten(F.transform(geom, of_polygon))


def _rings_area(rings: Column) -> Column:
    return _sum(rings, lambda r: r["role"] * F.abs(r["t"]["twice"]) / 2)


def planar_area(geom: Column) -> Column:
    return _rings_area(_signed_rings(geom))


def planar_length(geom: Column) -> Column:
    return _sum(segments(geom), lambda s: F.sqrt((s["x2"] - s["x1"]) ** 2 + (s["y2"] - s["y1"]) ** 2))


def centroid(geom: Column) -> Column:
    """Area centroid; length-weighted for lines; vertex mean for points and degenerate shapes."""
    def moment(axis: str, offset: str):
        def term(r: Column) -> Column:
            t = r["t"]
            sign = F.when(t["twice"] < 0, -1.0).otherwise(1.0)
            return r["role"] * sign * (t[axis] / 6 + t[offset] * t["twice"] / 2)
        return term

    def of_area(rings: Column) -> Column:
        return let(_rings_area(rings), lambda area: F.when(area > 0, point(
            _sum(rings, moment("mx", "ox")) / area, _sum(rings, moment("my", "oy")) / area)))

    def of_length(edges: Column) -> Column:
        seg_len = lambda s: F.sqrt((s["x2"] - s["x1"]) ** 2 + (s["y2"] - s["y1"]) ** 2)
        return let(_sum(edges, seg_len), lambda length: F.when(length > 0, point(
            _sum(edges, lambda s: seg_len(s) * (s["x1"] + s["x2"]) / 2) / length,
            _sum(edges, lambda s: seg_len(s) * (s["y1"] + s["y2"]) / 2) / length)))

    def of_points(pts: Column) -> Column:
        return point(_sum(pts, lambda p: p["x"]) / F.size(pts), _sum(pts, lambda p: p["y"]) / F.size(pts))

    usable = F.when(F.size(vertices(geom)) > 0, geom)
    return F.coalesce(let(_signed_rings(usable), of_area), let(segments(usable), of_length), let(vertices(usable), of_points))


def vertex_mean(geom: Column) -> Column:
    """Mean of the first ring's points, the closing point included; (0, 0) when empty."""
    r = F.get(F.get(geom, F.lit(0)), F.lit(0))
    size = F.coalesce(F.size(r), F.lit(0))
    return F.when(size > 0, point(_sum(r, lambda p: p["x"]) / size, _sum(r, lambda p: p["y"]) / size)).otherwise(
        point(F.lit(0.0), F.lit(0.0)))


def _authalic_sine(lat: Column) -> Column:
    e = WGS84_E

    def q(s):
        return (1 - e * e) * (s / (1 - e * e * s * s)) - (1 - e * e) / (2 * e) * F.log((1 - e * s) / (1 + e * s))

    at_pole = (1 - e * e) * (1 / (1 - e * e)) - (1 - e * e) / (2 * e) * math.log((1 - e) / (1 + e))
    return q(F.sin(F.radians(lat))) / at_pole


def geodesic_area(geom: Column) -> Column:
    """Area in m2 on the sphere of equal area.

    Edges are straight in the equal-area projection; for parcels (edges of a few km) this is
    within one part per million of the ellipsoid area.
    """
    def ring_area(r: Column) -> Column:
        edges = F.transform(_ring_segments(r), lambda s: F.struct(
            (F.radians(s["x2"] - s["x1"])).alias("dx"),
            _authalic_sine(s["y1"]).alias("s1"), _authalic_sine(s["y2"]).alias("s2")))
        return F.abs(_sum(edges, lambda s: s["dx"] * (s["s1"] + s["s2"]) / 2)) * AUTHALIC_RADIUS_M ** 2

    per_polygon = F.transform(geom, lambda poly: _sum(
        F.transform(poly, lambda r, i: F.when(i == 0, ring_area(r)).otherwise(-ring_area(r))), lambda v: v))
    return _sum(per_polygon, lambda v: v)


def haversine_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    a = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return F.atan2(F.sqrt(a), F.sqrt(1 - a)) * (2 * EARTH_RADIUS_M)


def plausible_lonlat(lon: Column, lat: Column) -> Column:
    ok = (F.abs(lon) <= 180) & (F.abs(lat) <= 90) & ~F.isnan(lon) & ~F.isnan(lat)
    return F.coalesce(ok, F.lit(False))


# ---- predicates --------------------------------------------------------------------------

def _turn(ax, ay, bx, by, cx, cy) -> Column:
    return (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)


def _within_span(s: Column, x: Column, y: Column) -> Column:
    return ((x >= F.least(s["x1"], s["x2"])) & (x <= F.greatest(s["x1"], s["x2"]))
            & (y >= F.least(s["y1"], s["y2"])) & (y <= F.greatest(s["y1"], s["y2"])))


def _turns(p: Column, q: Column) -> tuple[Column, Column, Column, Column]:
    return (
        _turn(q["x1"], q["y1"], q["x2"], q["y2"], p["x1"], p["y1"]),
        _turn(q["x1"], q["y1"], q["x2"], q["y2"], p["x2"], p["y2"]),
        _turn(p["x1"], p["y1"], p["x2"], p["y2"], q["x1"], q["y1"]),
        _turn(p["x1"], p["y1"], p["x2"], p["y2"], q["x2"], q["y2"]))


def _cross_properly(p: Column, q: Column) -> Column:
    d1, d2, d3, d4 = _turns(p, q)
    return (d1 * d2 < 0) & (d3 * d4 < 0)


def _meet(p: Column, q: Column) -> Column:
    turns = F.struct(*[d.alias(f"d{i}") for i, d in enumerate(_turns(p, q), 1)])
    return let(turns, lambda t: ((t["d1"] * t["d2"] < 0) & (t["d3"] * t["d4"] < 0))
               | ((t["d1"] == 0) & _within_span(q, p["x1"], p["y1"])) | ((t["d2"] == 0) & _within_span(q, p["x2"], p["y2"]))
               | ((t["d3"] == 0) & _within_span(p, q["x1"], q["y1"])) | ((t["d4"] == 0) & _within_span(p, q["x2"], q["y2"])))


def _on_edge(edges: Column, x: Column, y: Column) -> Column:
    return F.exists(edges, lambda s: (_turn(s["x1"], s["y1"], s["x2"], s["y2"], x, y) == 0) & _within_span(s, x, y))


def _crossings(edges: Column, x: Column, y: Column) -> Column:
    crossed = F.filter(edges, lambda s: ((s["y1"] > y) != (s["y2"] > y))
                       & (x < (s["x2"] - s["x1"]) * (y - s["y1"]) / (s["y2"] - s["y1"]) + s["x1"]))
    return F.size(crossed)


def _inside(edges: Column, polygonal: Column, x: Column, y: Column) -> Column:
    return polygonal & (_crossings(edges, x, y) % 2 == 1)


def _strictly_inside(edges: Column, polygonal: Column, x: Column, y: Column) -> Column:
    return _inside(edges, polygonal, x, y) & ~_on_edge(edges, x, y)


def _polygonal(geom: Column) -> Column:
    r = F.get(F.get(geom, F.lit(0)), F.lit(0))
    return (F.size(r) >= 4) & (F.get(r, F.lit(0)) == F.element_at(r, -1))


def _interior_point(edges: Column) -> Column:
    """A point strictly inside: the middle of the first span on a scan line between two vertex heights."""
    heights = F.slice(F.array_sort(F.array_distinct(F.transform(edges, lambda s: s["y1"]))), 1, 2)

    def on_line(y: Column) -> Column:
        xs = F.slice(F.array_sort(F.transform(
            F.filter(edges, lambda s: (s["y1"] > y) != (s["y2"] > y)),
            lambda s: (s["x2"] - s["x1"]) * (y - s["y1"]) / (s["y2"] - s["y1"]) + s["x1"])), 1, 2)
        return let(xs, lambda x: point((F.get(x, F.lit(0)) + F.get(x, F.lit(1))) / 2, y))

    return let(let(heights, lambda h: (F.get(h, F.lit(0)) + F.get(h, F.lit(1))) / 2), on_line)


def _first_points(geom: Column) -> Column:
    return F.transform(F.flatten(geom), lambda r: F.get(r, F.lit(0)))


def _both(a: Column, b: Column, test) -> Column:
    """Run ``test`` on the edges, polygon marks and start points of two shapes, each computed once."""
    parts = F.struct(segments(a).alias("ea"), segments(b).alias("eb"), _polygonal(a).alias("pa"), _polygonal(b).alias("pb"),
                     _first_points(a).alias("fa"), _first_points(b).alias("fb"))
    return F.coalesce(let(parts, test), F.lit(False))


def _parts_intersect(t: Column) -> Column:
    return (F.exists(t["ea"], lambda p: F.exists(t["eb"], lambda q: _meet(p, q)))
            | F.exists(t["fa"], lambda v: _inside(t["eb"], t["pb"], v["x"], v["y"]))
            | F.exists(t["fb"], lambda v: _inside(t["ea"], t["pa"], v["x"], v["y"])))


def intersects(a: Column, b: Column) -> Column:
    """Any edges meet, or one shape lies inside the other."""
    return _both(a, b, _parts_intersect)


def touches(a: Column, b: Column) -> Column:
    """Boundaries meet and interiors do not overlap."""
    def pokes_in(edges: Column, other: Column, other_polygonal: Column) -> Column:
        return F.exists(edges, lambda s: _strictly_inside(other, other_polygonal, s["x1"], s["y1"])
                        | _strictly_inside(other, other_polygonal, (s["x1"] + s["x2"]) / 2, (s["y1"] + s["y2"]) / 2))

    def core_inside(edges: Column, own_polygonal: Column, other: Column, other_polygonal: Column) -> Column:
        return own_polygonal & F.coalesce(let(_interior_point(edges), lambda c: _strictly_inside(
            other, other_polygonal, c["x"], c["y"])), F.lit(False))

    def test(t: Column) -> Column:
        ea, eb, pa, pb = t["ea"], t["eb"], t["pa"], t["pb"]
        overlap = (F.exists(ea, lambda p: F.exists(eb, lambda q: _cross_properly(p, q)))
                   | pokes_in(ea, eb, pb) | pokes_in(eb, ea, pa)
                   | core_inside(ea, pa, eb, pb) | core_inside(eb, pb, ea, pa))
        return _parts_intersect(t) & ~overlap

    return _both(a, b, test)


def is_box(geom: Column) -> Column:
    """One ring whose edges run along the axes and fill the bounding box."""
    r = F.get(F.get(geom, F.lit(0)), F.lit(0))
    straight = F.forall(segments(geom), lambda s: (s["x1"] == s["x2"]) | (s["y1"] == s["y2"]))
    return (F.size(geom) == 1) & (F.size(F.get(geom, F.lit(0))) == 1) & (F.size(r) == 5) & straight
