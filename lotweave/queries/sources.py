"""Sources and sinks over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lotweave.functions import vocab
from lotweave.queries.joins import FLAGGED, flagged
from lotweave.queries.registry import query
from lotweave.session import shared_folder
from lotweave.sources import geojson, lookup, sinks
from lotweave.sources.feature_collections import collection_rows


def _folder(spark, name: str) -> str:
    """A fresh folder next to the checkpoints, which all executors reach."""
    import uuid

    return f"{shared_folder(spark)}/lotweave-{name}-{uuid.uuid4().hex}"


@query("s01_load_vector_layer", "SELECT pos, round(x0, 6) AS x0, round(y1, 6) AS y1, 'props' AS k, 3857 AS srid FROM {lots}")
def _(d):
    """Written as GeoJSON lines, read back, reprojected to metres and back; a missing layer is empty."""
    path = _folder(d.spark, "layer") + "/layer"
    rows = d.parcels.select("pos", "parcel_id", "geom")
    sinks.as_features(rows, "pos").write.mode("overwrite").text(path)
    layer = geojson.to_srid(geojson.read_geojson(d.spark, path), 3857)
    missing = geojson.load_layer(d.spark, path + "-absent")
    back = geojson.to_srid(layer, 4326).withColumn("srid", F.lit(3857))
    from lotweave.functions.geometry import bounds

    out = back.unionByName(missing).withColumn("b", bounds(F.col("geom")))
    return out.select(F.col("feature_id").cast("bigint").alias("pos"), F.col("b.xmin").alias("x0"), F.col("b.ymax").alias("y1"), F.lit("props").alias("k"), "srid")


@query("s01_feature_collection", "SELECT pos, parcel_id, round(x0, 6) AS x0, round(y1, 6) AS y1, TRUE AS several_tasks FROM {lots}")
def _(d):
    """Collections of 500 parcels each, written and read back by ranges of a few kilobytes."""
    from lotweave.functions.geometry import bounds

    path = _folder(d.spark, "collections") + "/layer"
    lines = sinks.as_features(d.parcels.select("pos", "parcel_id", "geom"), "pos").withColumn("bucket", F.floor(F.get_json_object("value", "$.id").cast("bigint") / 500))
    whole = lines.groupBy("bucket").agg(F.concat(F.lit('{"type":"FeatureCollection","name":"a {\\"[","bbox":[[1],[{"features":[{}]}]],"features":['),
                                                 F.array_join(F.collect_list("value"), ",\n"), F.lit(']}')).alias("value"))
    whole.write.mode("overwrite").partitionBy("bucket").text(path)
    rows = geojson.parse_features(collection_rows(d.spark, path, 1 << 14).select("pos", "value"))
    tasks = collection_rows(d.spark, path, 1 << 14).select(F.spark_partition_id().alias("task")).distinct().agg((F.count("*") > 1).alias("several_tasks"))
    out = rows.withColumn("b", bounds(F.col("geom"))).crossJoin(F.broadcast(tasks))
    return out.select(F.col("feature_id").cast("bigint").alias("pos"), F.col("props")["parcel_id"].alias("parcel_id"), F.col("b.xmin").alias("x0"), F.col("b.ymax").alias("y1"), "several_tasks")


_RULE = " + ".join(f"{w}e0 * f.{n}" for n, w in vocab.RISK_WEIGHTS.items())


@query("s05_risk_layer_sink", f"""
SELECT l.parcel_id AS apn, least(greatest(({_RULE}) * 100, 0e0), 100e0) AS rule_risk_score, cast(f.has_flood AS int) AS has_flood, cast({len(vocab.RISK_WEIGHTS) + 2} AS int) AS fields
FROM ({FLAGGED}) f JOIN {{lots}} l ON l.pos = f.pos""")
def _(d):
    """Rows of the risk layer after a round trip through GeoJSON text."""
    from lotweave.functions import risk

    path = _folder(d.spark, "risk") + "/risk"
    rows = flagged(d).withColumn("rule_risk_score", risk.rule_risk_score({n: F.col(n) for n in vocab.RISK_WEIGHTS})).withColumnRenamed("parcel_id", "APN")
    sinks.write_features(sinks.risk_layer(rows), path)
    back = geojson.read_geojson(d.spark, path)
    p = F.col("props")
    return back.select(p["APN"].alias("apn"), p["rule_risk_score"].cast("double").alias("rule_risk_score"), p["has_flood"].cast("int").alias("has_flood"), F.size("props").alias("fields"))


@query("s06_zoning_layer_sink", "SELECT parcel_id AS \"APN\", jurisdiction AS \"JURISDICTION\", zoning_code AS \"ZONING_CODE\", gp AS \"GP_LAND_USE\" FROM {props}")
def _(d):
    rows = d.shaped("props").select(F.col("parcel_id").alias("APN"), F.col("jurisdiction").alias("JURISDICTION"), F.col("zoning_code").alias("ZONING_CODE"), F.col("gp").alias("GP_LAND_USE"), "risk", "geom")
    return sinks.zoning_layer(rows).drop("geom")


@query("s07_unified_sink", "SELECT pos, coalesce(gp, 'UNKNOWN') AS zone FROM {props}")
def _(d):
    path = _folder(d.spark, "unified") + "/unified"
    rows = d.view("props").select("pos", F.col("parcel_id").alias("APN"), F.col("gp").alias("ZONING_CODE"), F.col("jurisdiction").alias("JURISDICTION"))
    sinks.write_unified(sinks.unified(rows), path)
    return d.spark.read.parquet(path).select("pos", F.col("ZONING_CODE").alias("zone"))


@query("s08_scored_features", """
SELECT feature_id, zoning_code AS zone, round(CASE WHEN pos % 2 = 0 THEN 0.25e0 ELSE green END, 6) AS green, CASE WHEN pos % 2 = 0 THEN 0.75e0 END AS residential FROM {props} WHERE feature_id IS NOT NULL""")
def _(d):
    scores = d.view("props").filter("pos % 2 = 0").select(F.col("feature_id").alias("parcel_id"), F.lit(0.25).alias("green"), F.lit(0.75).alias("residential"))
    out = sinks.scored_features(d.features, scores.filter("parcel_id is not null"))
    p = F.col("props")
    return out.select("feature_id", p["ZONING_CODE"].alias("zone"), p["green"].cast("double").alias("green"), p["residential"].cast("double").alias("residential"))


@query("s09_metrics_sink", "SELECT round(avg(l_quantity), 6) AS rmse, round(avg(l_discount), 6) AS r2, count(*) AS test_size FROM {lineitem}")
def _(d):
    path = _folder(d.spark, "metrics") + "/metrics"
    sinks.write_metrics(d.table("lineitem").agg(F.avg("l_quantity").alias("rmse"), F.avg("l_discount").alias("r2"), F.count("*").alias("test_size")), path)
    return d.spark.read.schema("rmse double, r2 double, test_size bigint").json(path)


RUNS = "SELECT o_orderkey AS id, o_orderpriority AS name, o_custkey % 50 AS user_id, o_orderdate AS created_at, o_orderdate AS updated_at, cast(o_orderkey % 7 AS int) AS np, cast(o_orderkey % 4 AS int) AS nq FROM {orders}"


@query("s11_run_listing", f"SELECT id, name, np AS parcel_count, nq AS plan_count, (SELECT count(*) FROM ({RUNS}) t WHERE user_id = 7) AS total FROM ({RUNS}) r WHERE user_id = 7 ORDER BY updated_at DESC, id DESC LIMIT 20 OFFSET 10")
def _(d):
    items = lambda c: F.transform(F.when(F.col(c) > 0, F.sequence(F.lit(1), F.col(c))).otherwise(F.array().cast("array<int>")), lambda i: i.cast("string"))
    runs = d.sql(RUNS).withColumn("parcels", items("np")).withColumn("plans", items("nq"))
    return lookup.run_listing(runs, 7, 20, 10).drop("created_at", "updated_at")


@query("s14_zone_polygons", """
SELECT pos AS id, concat('{{"type":"Feature","geometry":{{"type":"Polygon","coordinates":[[[', cast(pos AS string), '.0,0.0],[', cast(pos + 2 AS string), '.0,0.0],[', cast(pos + 2 AS string), '.0,3.0],[', cast(pos AS string), '.0,3.0],[',
  cast(pos AS string), '.0,0.0]]]}},"properties":{{"id":', cast(pos AS string), '}}}}') AS feature FROM {lots}""".replace("{{", "{").replace("}}", "}"))
def _(d):
    zones = d.view("lots").select(F.col("pos").alias("id"), F.col("pos").cast("double").alias("x"), F.lit(0.0).alias("y"), F.lit(2.0).alias("width"), F.lit(3.0).alias("height"))
    return geojson.rectangles_to_features(zones).drop("geom")


@query("s14_planning_parameters", """
SELECT pos, round(CASE WHEN pos % 2 = 0 THEN aqi ELSE 60e0 END, 6) AS aqi_mean, round(CASE WHEN pos % 2 = 0 THEN clay END, 6) AS soil_clay_pct FROM {props}""")
def _(d):
    rows = d.sql("SELECT pos, pos % 2 = 0 AS has_own, aqi AS aqi_mean, imperv AS impervious_mean, clay AS soil_clay_pct, sand AS soil_sand_pct FROM {props}")
    return geojson.with_planning_parameters(rows, {"aqi_mean": 60.0}).select("pos", "aqi_mean", "soil_clay_pct")


@query("p38_wgs84_plausibility", """
SELECT CASE WHEN (SELECT bool_and(x0 BETWEEN -180 AND 180 AND x1 BETWEEN -180 AND 180 AND y0 BETWEEN -90 AND 90 AND y1 BETWEEN -90 AND 90) FROM {lots}) THEN 'b' ELSE 'a' END AS plan_id,
  (SELECT bool_and(x0 BETWEEN -180 AND 180 AND x1 BETWEEN -180 AND 180 AND y0 BETWEEN -90 AND 90 AND y1 BETWEEN -90 AND 90) FROM {lots}) AS used_fallback""")
def _(d):
    """A layer whose last parcel alone is metric fails the check, so the lon/lat layer is used."""
    from lotweave.functions.geometry import mercator

    wgs = d.features
    last = wgs.agg(F.max("pos").alias("_last"))
    metric = wgs.crossJoin(F.broadcast(last)).withColumn("geom", F.when(F.col("pos") == F.col("_last"), mercator(F.col("geom"))).otherwise(F.col("geom"))).drop("_last")
    return geojson.resolve_overlay(metric, wgs, "a", "b")
