"""Model training and scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from lotweave.functions import geometry as g
from lotweave.functions import risk, vocab
from lotweave.operators import scoring
from lotweave.queries.joins import flagged
from lotweave.queries.registry import query
from lotweave.session import cut_lineage
from lotweave.sources.sinks import model_columns


def frame(d):
    """Feature frame of the risk model: flags, measures and the rule score."""
    m = g.mercator(F.col("geom"))
    rows = flagged(d).withColumn("m", m).withColumn("c", g.centroid(F.col("m")))
    full = rows.select("pos", "parcel_id", *vocab.RISK_WEIGHTS, g.planar_area(F.col("m")).alias("area_m2"), g.planar_length(F.col("m")).alias("perimeter_m"),
                       F.col("c.x").alias("centroid_x"), F.col("c.y").alias("centroid_y"))
    return cut_lineage(full.withColumn("rule_risk_score", risk.rule_risk_score({n: F.col(n) for n in vocab.RISK_WEIGHTS})))


@query("m01_median_imputation", "SELECT pos, round(coalesce(perimeter, (SELECT quantile_disc(perimeter, 0.5) FROM {props})), 6) AS perimeter_m FROM {props}")
def _(d):
    rows = d.sql("SELECT pos, perimeter FROM {props}")
    return scoring.impute_median(rows, ["perimeter"]).select("pos", F.col("f_perimeter").alias("perimeter_m"))


@query("m02_train_test_split")
def _(d):
    return d.view("lots").select("parcel_id", scoring.train_flag(F.col("parcel_id")).alias("train"))


@query("m03_risk_model_metrics")
def _(d):
    return scoring.train_risk(frame(d), "parcel_id")[1]


@query("m04_risk_model_scores")
def _(d):
    scored, _metrics = scoring.train_risk(frame(d), "parcel_id")
    return scored.select("parcel_id", "rule_risk_score", "xgb_risk_score")


@query("s10_model_columns", """SELECT pos, round(lon, 6) AS "Longitude", round(lat, 6) AS "Latitude", round(sand, 6) AS "SandContent", round(clay, 6) AS "ClayContent", round(aqi, 6) AS "AirQualityIndex", round(imperv, 6) AS "ImperviousSurface" FROM {props}""")
def _(d):
    rows = d.sql("SELECT pos, lon, lat, sand AS soil_sand_pct, clay AS soil_clay_pct, aqi AS aqi_mean, imperv AS impervious_mean FROM {props}")
    return model_columns(rows)
