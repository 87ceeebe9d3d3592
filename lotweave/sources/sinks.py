"""Sinks and the column sets they keep."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotweave.functions import geometry as g
from lotweave.functions import vocab
from lotweave.functions.coerce import blank_to_null

RISK_KEEP = ("rule_risk_score", "xgb_risk_score", "has_flood", "has_fault", "has_liquefaction",
             "is_steep", "is_fire_zone", "in_esa", "in_mscp", "area_m2", "perimeter_m")
ZONING_KEEP = ("JURISDICTION", "ZONING_CODE", "GP_LAND_USE", "MAX_HEIGHT", "MAX_FAR", "MIN_LOT_SIZE")


def _with_key(df: DataFrame, keep: Sequence[str], keys: Sequence[str]) -> list[str]:
    present = [k for k in keys if k in df.columns][:1]
    return present + [c for c in keep if c in df.columns]


def _wgs84(df: DataFrame) -> DataFrame:
    if "srid" not in df.columns:
        return df
    return df.withColumn("geom", F.when(F.col("srid") == 3857, g.unmercator(F.col("geom"))).otherwise(F.col("geom")))


def risk_layer(df: DataFrame) -> DataFrame:
    """Columns of the risk layer: first id column present, scores, flags, measures, WGS84 geometry."""
    keep = _with_key(df, RISK_KEEP, ("APN", "PARCELID", "PARNO", "apn", "parcel_id"))
    return _wgs84(df).select(*keep, "geom")


def zoning_layer(df: DataFrame) -> DataFrame:
    """Columns of the zoning layer; absent ones are skipped."""
    return _wgs84(df).select(*_with_key(df, ZONING_KEEP, ("APN", "PARCELID", "PARNO")), "geom")


def as_features(df: DataFrame, id_column: str | None = None) -> DataFrame:
    """One GeoJSON feature text per row in column ``value``."""
    props = F.to_json(F.struct(*[c for c in df.columns if c not in ("geom", "geom_type", "srid")]))
    kind = F.col("geom_type") if "geom_type" in df.columns else F.lit("Polygon")
    head = F.lit('{"type":"Feature",')
    if id_column:
        own = F.to_json(F.struct(F.col(id_column).cast("string").alias("id")))
        head = F.concat(head, F.regexp_replace(own, r"^\{|\}$", ""), F.lit(","))
    return df.select(F.concat(
        head, F.lit('"geometry":'), F.coalesce(g.to_geojson(F.col("geom"), kind), F.lit("null")),
        F.lit(',"properties":'), props, F.lit("}")).alias("value"))


def write_features(df: DataFrame, path: str) -> None:
    """Newline-delimited GeoJSON, written in parallel."""
    as_features(df).write.mode("overwrite").text(path)


def unified(df: DataFrame) -> DataFrame:
    """Every parcel, unknown zoning spelled out. A smaller layer is the caller's own ``exact_sample``."""
    return df.fillna({"ZONING_CODE": "UNKNOWN"})


def write_unified(df: DataFrame, path: str, by: str = "JURISDICTION") -> None:
    df.write.mode("overwrite").partitionBy(by).parquet(path)


def scored_features(features: DataFrame, predictions: DataFrame) -> DataFrame:
    """Feature props with the scores merged in (scores win); rows without an id are dropped.

    Ids are compared as text, so integer ids get their scores too.
    """
    scores = [c for c in predictions.columns if c != "parcel_id"]
    entries = F.map_from_arrays(F.array(*[F.lit(c) for c in scores]), F.array(*[F.col(c).cast("string") for c in scores]))
    p = predictions.select(F.col("parcel_id").cast("string").alias("_pid"), entries.alias("_scores"))
    kept = features.filter(blank_to_null(F.col("feature_id")).isNotNull())
    joined = kept.join(p, F.col("feature_id").cast("string") == F.col("_pid"), "left")
    base = F.map_filter("props", lambda k, v: F.col("_scores").isNull() | ~F.map_contains_key("_scores", k))
    none = F.create_map().cast("map<string,string>")
    return joined.withColumn("props", F.map_concat(base, F.coalesce("_scores", none))).drop("_pid", "_scores")


def write_metrics(metrics: DataFrame, path: str) -> None:
    """One-row evaluation table (rmse, r2, test_size) as JSON."""
    metrics.select("rmse", "r2", "test_size").coalesce(1).write.mode("overwrite").json(path)


def model_columns(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed(vocab.MODEL_COLUMNS)
