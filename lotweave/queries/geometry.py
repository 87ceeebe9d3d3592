"""Geometry measures and derived shapes."""

from __future__ import annotations

from pyspark.sql import functions as F

from lotweave.functions import geometry as g
from lotweave.operators import shapes
from lotweave.operators.spatial import clip_to_extent, extent
from lotweave.queries.registry import query
from lotweave.sources.geojson import centroid_lonlat, invalid_features, parse_features

MX = "radians({0}) * 6378137e0"
MY = "ln(tan(pi() / 4 + radians({0}) / 2)) * 6378137e0"


def _geojson(d):
    """Parcels as GeoJSON text: polygons (every second one a bow-tie), points, lines, multi-polygons and unreadable rows by turns."""
    return d.sql("""
SELECT pos, concat('{{"type":"Feature","id":"', cast(pos AS string), '","properties":{{"k":', cast(pos % 9 AS string), '}},"geometry":',
  CASE pos % 6 WHEN 0 THEN concat('{{"type":"Point","coordinates":[', cast(lon AS string), ',', cast(lat AS string), ']}}')
    WHEN 1 THEN concat('{{"type":"LineString","coordinates":[[', cast(x0 AS string), ',', cast(y0 AS string), '],[', cast(x1 AS string), ',', cast(y0 AS string), ']]}}')
    WHEN 2 THEN concat('{{"type":"MultiPolygon","coordinates":[[[[', cast(x0 AS string), ',', cast(y0 AS string), '],[', cast(x1 AS string), ',', cast(y0 AS string), '],[',
      cast(x1 AS string), ',', cast(y1 AS string), '],[', cast(x0 AS string), ',', cast(y1 AS string), '],[', cast(x0 AS string), ',', cast(y0 AS string), ']]]]}}')
    WHEN 3 THEN 'null' WHEN 4 THEN '{{"type":"Polygon","coordinates":"bad"}}'
    ELSE concat('{{"type":"Polygon","coordinates":[[[', cast(x0 AS string), ',', cast(y0 AS string), '],[', cast(x0 AS string), ',', cast(y0 AS string), '],[', cast(x1 AS string), ',', cast(y0 AS string), '],[',
      cast(CASE WHEN pos % 12 = 11 THEN x0 ELSE x1 END AS string), ',', cast(y1 AS string), '],[', cast(CASE WHEN pos % 12 = 11 THEN x1 ELSE x0 END AS string), ',', cast(y1 AS string), ']]]}}') END, '}}') AS value FROM {lots}""")


@query("g01_parse_and_repair", """
SELECT cast(pos AS string) AS feature_id, CASE pos % 6 WHEN 0 THEN 'Point' WHEN 1 THEN 'LineString' WHEN 2 THEN 'MultiPolygon' WHEN 3 THEN NULL ELSE 'Polygon' END AS geom_type,
  CASE pos % 6 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 5 WHEN 5 THEN 5 END AS points, pos % 6 = 4 OR pos % 12 = 11 AS rejected, cast(pos % 9 AS string) AS k FROM {lots}""")
def _(d):
    f = parse_features(_geojson(d))
    bad = invalid_features(f).select("feature_id", F.lit(True).alias("rejected"))
    return f.join(bad, "feature_id", "left").select(
        "feature_id", "geom_type", F.size(g.vertices(F.col("geom"))).alias("points"), F.coalesce("rejected", F.lit(False)).alias("rejected"), F.col("props")["k"].alias("k"))


@query("g02_reprojection", f"""
SELECT pos, round({MX.format('x0')}, 3) AS mx, round({MY.format('y0')}, 3) AS my, round(x0, 6) AS back_x, round(y0, 6) AS back_y FROM {{lots}}""")
def _(d):
    p = d.parcels.withColumn("m", g.mercator(F.col("geom")))
    p = p.withColumn("b", g.unmercator(F.col("m")))
    first = lambda c: F.get(F.get(F.get(F.col(c), F.lit(0)), F.lit(0)), F.lit(0))
    return p.select("pos", F.round(first("m")["x"], 3).alias("mx"), F.round(first("m")["y"], 3).alias("my"), first("b")["x"].alias("back_x"), first("b")["y"].alias("back_y"))


W, H = f"({MX.format('x1')} - {MX.format('x0')})", f"({MY.format('y1')} - {MY.format('y0')})"


@query("g03_planar_measures", f"""
SELECT pos, round({W} * {H}, 2) AS area_m2, round(2 * ({W} + {H}), 3) AS perimeter_m, round(({MX.format('x0')} + {MX.format('x1')}) / 2, 3) AS cx,
  round(({MY.format('y0')} + {MY.format('y1')}) / 2, 3) AS cy FROM {{lots}}""")
def _(d):
    p = d.parcels.withColumn("m", g.mercator(F.col("geom")))
    m = F.col("m")
    return p.select("pos", F.round(g.planar_area(m), 2).alias("area_m2"), F.round(g.planar_length(m), 3).alias("perimeter_m"),
                    F.round(g.centroid(m)["x"], 3).alias("cx"), F.round(g.centroid(m)["y"], 3).alias("cy"))


_E2 = g.WGS84_E ** 2
_Q = (f"((1 - {_E2}e0) * (sin(radians({{0}})) / (1 - {_E2}e0 * sin(radians({{0}})) * sin(radians({{0}})))) - (1 - {_E2}e0) / (2 * {g.WGS84_E}e0) * "
      f"ln((1 - {g.WGS84_E}e0 * sin(radians({{0}}))) / (1 + {g.WGS84_E}e0 * sin(radians({{0}})))))")
_POLE = f"((1 - {_E2}e0) * (1 / (1 - {_E2}e0)) - (1 - {_E2}e0) / (2 * {g.WGS84_E}e0) * ln((1 - {g.WGS84_E}e0) / (1 + {g.WGS84_E}e0)))"


GEODESIC = f"radians(x1 - x0) * ({_Q.format('y1')} - {_Q.format('y0')}) / {_POLE} * {g.AUTHALIC_RADIUS_M ** 2!r}"


@query("g04_geodesic_area", f"SELECT pos, round({GEODESIC}, 1) AS area_m2 FROM {{lots}}")
def _(d):
    return d.parcels.select("pos", F.round(g.geodesic_area(F.col("geom")), 1).alias("area_m2"))


@query("g05_bounds_and_clip", """
SELECT h.pos, h.x0 AS xmin, h.y0 AS ymin, h.x1 AS xmax, h.y1 AS ymax, t.a AS total_xmin, t.b AS total_ymin, t.c AS total_xmax, t.d AS total_ymax
FROM {hazards} h CROSS JOIN (SELECT min(x0) a, min(y0) b, max(x1) c, max(y1) d FROM {lots}) t
WHERE h.x0 <= t.c AND h.x1 >= t.a AND h.y0 <= t.d AND h.y1 >= t.b""")
def _(d):
    clipped = clip_to_extent(d.shaped("hazards").select("pos", "geom"), d.parcels)
    box = clipped.withColumn("b", g.bounds(F.col("geom"))).select("pos", "b.*")
    t = extent(d.parcels)
    return box.crossJoin(F.broadcast(t.withColumnsRenamed({c: f"total_{c}" for c in t.columns})))


@query("g06_centroid_extraction", """
SELECT pos, round(CASE WHEN pos % 3 = 0 THEN -117e0 + pos / 1e5 ELSE lon END, 6) AS lon, round(CASE WHEN pos % 3 = 0 THEN 33e0 ELSE lat END, 6) AS lat,
  round((4 * lon + x0) / 5 - (lon - (x0 + x1) / 2) * 4 / 5, 6) AS label_x FROM {lots}""".replace("(4 * lon + x0) / 5 - (lon - (x0 + x1) / 2) * 4 / 5", "(x0 + x1 + x1 + x0 + x0) / 5"))
def _(d):
    nested = F.to_json(F.struct((F.lit(-117.0) + F.col("pos") / 1e5).alias("lon"), F.lit(33.0).alias("lat")))
    props = F.when(F.col("pos") % 3 == 0, F.create_map(F.lit("centroid"), nested)).when(
        F.col("pos") % 3 == 1, F.create_map(F.lit("centroid_x"), F.lit("999"))).otherwise(F.create_map().cast("map<string,string>"))
    out = centroid_lonlat(d.parcels.select("pos", "geom", props.alias("props")))
    return out.select("pos", "lon", "lat", g.vertex_mean(F.col("geom"))["x"].alias("label_x"))


HAVERSINE = "6371000e0 * 2 * atan2(sqrt({a}), sqrt(1 - {a}))"


def haversine_sql(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    a = (f"(sin(radians({lat2} - {lat1}) / 2) * sin(radians({lat2} - {lat1}) / 2) + cos(radians({lat1})) * cos(radians({lat2})) * "
         f"sin(radians({lon2} - {lon1}) / 2) * sin(radians({lon2} - {lon1}) / 2))")
    return HAVERSINE.format(a=a)


@query("g07_haversine_distance", f"SELECT pos, round({haversine_sql('lon', 'lat', '-117e0', '33e0')}, 3) AS metres FROM {{lots}}")
def _(d):
    return d.parcels.select("pos", F.round(g.haversine_m(F.col("lon"), F.col("lat"), F.lit(-117.0), F.lit(33.0)), 3).alias("metres"))


@query("g08_buffer_zones", f"""
SELECT parcel_id, round({W} * {H} + 2 * ({W} + {H}) * 50 + 4 * 16 * 0.5e0 * 50 * 50 * sin(pi() / 32), 1) AS area, 50e0 AS buffer_distance, 'meters' AS buffer_units FROM {{lots}}""")
def _(d):
    made, _rejects = shapes.buffer_zones(d.parcels, 50.0)
    return made.select("parcel_id", F.round(g.planar_area(F.col("geom")), 1).alias("area"), "buffer_distance", "buffer_units")


@query("g09_parcel_subdivision", f"""
SELECT parcel_id, cast(n * n AS bigint) AS pieces, round(a, 0) AS total_area FROM (
  SELECT parcel_id, {W} * {H} AS a, greatest(1, cast(floor(sqrt({W} * {H} / 10000e0)) AS int)) AS n FROM {{lots}}) q""")
def _(d):
    return shapes.subdivide(d.parcels, 10_000.0, 100.0).groupBy("parcel_id").agg(F.count("*").alias("pieces"), F.round(F.sum("area"), 0).alias("total_area"))


@query("g10_grid_overlay")
def _(d):
    return shapes.number_cells(shapes.grid_overlay(d.parcels, 150.0)).select("cell_id", "gx", "gy")


@query("g11_voronoi_regions")
def _(d):
    return shapes.voronoi(d.parcels).select("parcel_id", F.round("area", 0).alias("area"))
