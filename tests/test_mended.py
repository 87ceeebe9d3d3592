"""Rules that hold for whole layers, several scenarios and any size."""

import pytest
from pyspark.sql import functions as F

from lotweave.functions import landuse
from lotweave.functions.coerce import Fields
from lotweave.operators import compat, spatial
from lotweave.plans import jobs, objectives
from lotweave.sources import geojson, sinks


@pytest.mark.parametrize("listed,want", [('["green", "industrial"]', ["industrial", "green"]), ('[" Residential ", "x"]', ["residential"]), ("green, industrial", ["industrial", "green"]), ("[]", ["residential"]), ('["green"', ["residential"])])
def test_listed_uses_win_over_zoning(spark, listed, want):
    df = spark.createDataFrame([(1, {"allowed_uses": listed, "ZONING_CODE": "RS-1-7"})], "pos bigint, props map<string,string>")
    assert df.select(landuse.planner_allowed_uses(Fields(df)).alias("u")).first().u == want


def test_rings_that_cross_themselves_are_rejected(spark):
    ring = lambda *p: '{"type":"Feature","id":"%s","properties":{},"geometry":{"type":"Polygon","coordinates":[[%s]]}}' % (p[0], ",".join(f"[{x},{y}]" for x, y in p[1:]))
    texts = [ring("bow", (0, 0), (2, 0), (0, 2), (2, 2), (0, 0)), ring("square", (0, 0), (2, 0), (2, 2), (0, 2), (0, 0)), ring("bent", (0, 0), (4, 0), (4, 4), (2, 1), (0, 4), (0, 0))]
    rows = geojson.parse_features(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "pos bigint, value string"))
    assert [r.feature_id for r in geojson.invalid_features(rows).collect()] == ["bow"]


def test_unified_layer_keeps_every_parcel(spark):
    rows = spark.range(50_050).select(F.col("id").cast("string").alias("APN"), F.lit(None).cast("string").alias("ZONING_CODE"))
    assert sinks.unified(rows).filter("ZONING_CODE = 'UNKNOWN'").count() == 50_050


def test_one_bad_coordinate_spoils_a_layer(spark):
    square = [[[(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0)]]]
    far = [[[(0.0, 0.0), (1.0, 0.0), (5000.0, 1.0), (0.0, 0.0)]]]
    kind = "pos bigint, geom array<array<array<struct<x:double,y:double>>>>"
    layer = spark.createDataFrame([(i, square) for i in range(300)], kind)
    assert geojson.plausible_layer(layer).first().ok
    assert not geojson.plausible_layer(layer.unionByName(spark.createDataFrame([(300, far)], kind))).first().ok


def test_a_second_scenario_changes_nothing_in_the_first(spark):
    rows = [(0, 0, "a", 0.0, 0.0), (0, 1, "b", 0.001, 0.0), (1, 2, "c", 0.0, 0.0), (1, 3, "d", 0.001, 0.0), (1, 4, "e", 0.002, 0.0)]
    parcels = spark.createDataFrame(rows, "scenario_id int, pos bigint, parcel_id string, lon double, lat double").withColumn("risk", F.lit(0.1))
    uses = parcels.select("scenario_id", F.lit(0).alias("plan"), "parcel_id", F.lit("green").alias("use"))
    pairs = spatial.neighbour_pairs(parcels, 250.0, within="scenario_id")
    assert sorted((r.left_id, r.right_id) for r in pairs.collect()) == [("a", "b"), ("c", "d"), ("c", "e"), ("d", "e")]
    both = {r.scenario_id: r for r in compat.plan_scores(pairs, uses, parcels).collect()}
    one = compat.plan_scores(pairs.filter("scenario_id = 0").drop("scenario_id"), uses.filter("scenario_id = 0").drop("scenario_id"), parcels.filter("scenario_id = 0").select("parcel_id", "risk")).first()
    assert both[0].score == one.score and both[0].neighbor_pairs_evaluated == 1 and both[1].neighbor_pairs_evaluated == 3
    genes = parcels.select("scenario_id", F.lit(0).alias("plan"), "parcel_id", F.lit(3).alias("use_code"))
    ctx = objectives.Context(keys=("scenario_id", "plan"), pairs=pairs, risks=parcels.select("scenario_id", "parcel_id", "risk"))
    got = {r.scenario_id: r.value for r in objectives.compatibility(1.0)(genes, ctx).collect()}
    assert got[0] == pytest.approx(1 - one.score)
    labelled = genes.withColumn("use_label", F.lit("green"))
    facts = parcels.select("parcel_id", F.lit(10.0).alias("area"), F.lit(False).alias("hazard"))
    assert {r.scenario_id: r.total_parcels for r in objectives.planning_metrics(labelled, facts).collect()} == {0: 2, 1: 3}


def test_empty_stage_is_an_empty_result(spark):
    merged = spark.createDataFrame([], "parcel_id string, residential double, commercial double, industrial double, green double, environmental_risk double")
    picked, assignments = jobs.stage_plans(merged)
    assert picked.count() == 0 and assignments.count() == 0 and "use_label" in assignments.columns
