"""Literal cases of the scalar rules."""

import pytest
from pyspark.sql import functions as F

from lotweave.functions import landuse, risk, text, vocab
from lotweave.functions.coerce import Fields
from lotweave.operators import explain, nearby, scoring
from lotweave.sources.lookup import with_zone_parameters


def one(spark, props, build, feature_id=None):
    df = spark.createDataFrame([(0, feature_id, {k: str(v) for k, v in props.items()})], "pos bigint, feature_id string, props map<string,string>")
    return df.select(build(Fields(df)).alias("x")).first()["x"]


RISK_CASES = [  # props -> planner, proximity, compatibility, explanation, comparison
    ({"risk_score_norm": 0.4}, 0.4, None, 0.4, None, 0.4),
    ({"environmental_risk": 1.7}, 1.0, 0.017, 0.017, 0.017, 0.017),
    ({"xgb_risk_score": 40, "rule_risk_score": 90}, 0.4, 0.4, 0.4, 0.4, 0.4),
    ({"rule_risk_score": 250}, 1.0, 1.0, 1.0, None, None),
    ({"xgb_risk_score": -5}, 0.0, 0.0, 0.0, None, None),
    ({"xgb_risk_score": "bad", "rule_risk_score": 60}, 0.0, 0.6, 0.0, 0.6, 0.6),
    ({"xgb_risk_score": "NaN", "rule_risk_score": "inf"}, 0.0, None, 0.0, None, None),
    ({}, 0.0, None, 0.0, None, None),
]


@pytest.mark.parametrize("props,planner,prox,compat,expl,comp", RISK_CASES)
def test_risk_normalisers_side_by_side(spark, props, planner, prox, compat, expl, comp):
    got = (one(spark, props, risk.planner_risk), one(spark, props, risk.proximity_risk), one(spark, props, risk.compatibility_risk),
           one(spark, props, lambda f: risk.strict_risk(f, vocab.RISK_KEYS_EXPLANATION)),
           one(spark, props, lambda f: risk.strict_risk(f, vocab.RISK_KEYS_COMPARISON)))
    for g, want in zip(got, (planner, prox, compat, expl, comp)):
        assert g == (want if want is None else pytest.approx(want))


def test_staged_numbers_keep_case_apart(spark):
    df = spark.createDataFrame([({"environmental_risk": "5", "ENVIRONMENTAL_RISK": "80"},)], "props map<string,string>")
    staged = risk.staged(df)
    f = Fields(staged)
    row = staged.select(f.num("environmental_risk").alias("a"), f.num("ENVIRONMENTAL_RISK").alias("b")).first()
    assert (row.a, row.b) == (5.0, 80.0)


@pytest.mark.parametrize("props,want", [
    ({"allowed_uses": "Residential, green"}, ["residential", "green"]),
    ({"ZONING_CODE": "RS-1-7"}, ["residential"]),
    ({"GP_LAND_USE": "Mixed Use"}, ["residential", "commercial"]),
    ({"ZONING_CODE": "multi-family farm"}, ["residential", "industrial"]),  # keywords over-match: rm in farm, i- in multi-
    ({}, ["residential", "commercial", "industrial", "green"]),
])
def test_planner_allowed_uses(spark, props, want):
    assert one(spark, props, landuse.planner_allowed_uses) == want


@pytest.mark.parametrize("value,compat,prox,comp,mapped", [
    ("Open Space", "green", "green", "green", "green"),
    ("mixed-use", "commercial", "commercial", "mixed_use", None),
    ("Retail & Housing", "unknown", "residential", "residential", "residential"),
    ("RES", "residential", "residential", "res", "residential"),
    ("  ", "unknown", "unknown", "", None),
])
def test_land_use_normalisers(spark, value, compat, prox, comp, mapped):
    df = spark.createDataFrame([(value,)], "v string")
    row = df.select(landuse.compatibility_use(F.col("v")), landuse.proximity_use(F.col("v")), landuse.comparison_use(F.col("v")), landuse.map_use(F.col("v"))).first()
    assert tuple(row) == (compat, prox, comp, mapped)


def test_rule_risk_attribution_and_counterfactual(spark):
    df = spark.createDataFrame([("p", {"has_flood": "1", "is_steep": "2", "in_esa": "1"})], "parcel_id string, props map<string,string>")
    rows = scoring.explain_risk(df).orderBy("place").collect()
    assert [r.factor for r in rows[:2]] == ["has_flood", "in_esa"] and rows[0].total_rule_score == 30.0 and len(rows) == 7
    change = spark.createDataFrame([("s", "p", 0, 1)], "scenario_id string, parcel_id string, has_flood int, is_fire_zone int")
    c = scoring.counterfactual(df, change).first()
    assert (c.original_score, c.counterfactual_score, c.delta) == (30.0, 20.0, -10.0)


def test_prediction_lookup_then_features_then_neutral(spark):
    parcels = spark.createDataFrame([("A", {}), ("B", {"aqi_mean": "150", "impervious_mean": "100", "soil_clay_pct": "100", "soil_sand_pct": "0"}), ("C", {})],
                                    "parcel_id string, props map<string,string>")
    table = spark.createDataFrame([("A", 40.0)], "apn string, risk_raw double")
    got = {r.parcel_id: r for r in scoring.predict_suitability(parcels, table).collect()}
    assert got["A"].environmental_risk == pytest.approx(0.4) and got["A"].residential == pytest.approx(0.4)
    assert got["B"].environmental_risk == pytest.approx(1.0) and got["B"].green == 1.0
    assert got["C"].environmental_risk == 0.0 and got["C"].industrial == 0.5


def test_zone_parameters_never_overwrite(spark):
    df = spark.createDataFrame([("CC-3-6", 12.0), ("XX", None)], "ZONING_CODE string, MAX_HEIGHT double")
    a, b = with_zone_parameters(df).orderBy("ZONING_CODE").collect()
    assert (a.MAX_HEIGHT, a.MAX_FAR, a.MIN_LOT_SIZE) == (12.0, 3.0, None) and b.MAX_HEIGHT is None


def test_text_rules(spark):
    df = spark.createDataFrame([("see §131.0422 and Section 4100", "county_rules.pdf", "CC-3-6", "RS-1-7")], "t string, n string, c string, r string")
    row = df.select(text.section_number(F.col("t")), text.document_jurisdiction(F.col("n"), F.col("t")), text.zone_category(F.col("c")), text.zone_category(F.col("r")),
                    text.routes(F.lit("Why is the flood danger high? Suggest a layout"))).first()
    assert row[0] == "131.0422" and row[1] == "San Diego County" and row[2] == "Unknown" and row[3] == "Residential"
    assert row[4] == ["explain_risk", "analyze_environment", "optimize_land_use"]
    raw = "**Question:** x\n**[Unknown, f.pdf]** Height is 30 feet.\n*(note)*"
    assert spark.createDataFrame([(raw,)], "t string").select(text.clean_answer(F.col("t"))).first()[0] == "Height is 30 feet."


def test_mix_from_text(spark):
    df = spark.createDataFrame([("50% green space and 20% residential",), ("surprise me",)], "t string")
    a, b = df.select(*[c.alias(u) for u, c in landuse.mix_from_text(F.col("t")).items()]).collect()
    assert a.green == 0.5 and a.residential == 0.2 and a.commercial == pytest.approx(0.2) and a.industrial == pytest.approx(0.1)
    assert (b.residential, b.commercial, b.industrial, b.green) == (0.4, 0.2, 0.1, 0.3)


def test_explanation_of_high_risk_green_and_weak_residential(spark):
    feats = spark.createDataFrame([("p", {"environmental_risk": "0.8", "has_flood": "1", "ZONING_CODE": "RS-1-7"})], "parcel_id string, props map<string,string>")
    plans = spark.createDataFrame([(0, "p", "green"), (1, "p", "residential")], "plan int, parcel_id string, use string")
    g, r = explain.explain_assignments(plans, feats, {"green": 50, "residential": 50}).orderBy("plan").collect()
    assert g.risk_level == "high" and g.best_use == "green" and any("helps avoid exposing development" in x for x in g.reasons)
    assert any("trade-off" in w for w in r.warnings) and r.rank == 4 and "trade-off" in r.headline and any("100-Year Floodplain" in w for w in r.warnings)
    with pytest.raises(Exception, match="Unsupported assigned use"):
        explain.explain_assignments(spark.createDataFrame([(0, "p", "spaceport")], "plan int, parcel_id string, use string"), feats).collect()


def test_neighbourhood_summary_empty(spark):
    row = nearby.empty_summary(spark.createDataFrame([("x",)], "parcel_id string")).first()
    assert row.dominant_zoning == "Unknown" and row.insight.startswith("Select nearby parcels")
