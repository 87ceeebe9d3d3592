"""Feature sources: GeoJSON text, layers, parcel centroids, page tables and plain shapes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lotweave.functions import geometry as g
from lotweave.functions import vocab
from lotweave.functions.coerce import Fields, collapse_first, number, parcel_id
from lotweave.sources.feature_collections import collection_rows

FEATURE_SCHEMA = f"feature_id string, pos bigint, props map<string,string>, geom_type string, geom {g.GEOM_TYPE}, srid int"


class SourceError(ValueError):
    """The input is not usable as a whole."""


def read_geojson(spark: SparkSession, path: str, collection: bool = False, srid: int = 4326) -> DataFrame:
    """Read newline-delimited features, or FeatureCollection files with ``collection=True``.

    Both split over tasks by bytes; ``pos`` grows in file order and has gaps.
    """
    if collection:
        return parse_features(collection_rows(spark, path), srid)
    lines = spark.read.text(path).filter(F.trim("value") != "").withColumn("pos", F.monotonically_increasing_id())
    return parse_features(lines, srid)


def parse_features(rows: DataFrame, srid: int = 4326) -> DataFrame:
    """Feature rows from (value, pos) rows of one GeoJSON feature text each; nested values stay JSON text.

    Texts are cut out one step at a time; in one step Spark would cut them out again wherever they are read.
    """
    raw = F.col("value")
    props = F.from_json(F.get_json_object(raw, "$.properties"), "map<string,string>")
    texts = rows.select(
        F.get_json_object(raw, "$.id").alias("feature_id"), "pos",
        F.coalesce(props, F.create_map().cast("map<string,string>")).alias("props"),
        F.get_json_object(raw, "$.geometry").alias("_geometry"))
    parts = texts.select("feature_id", "pos", "props", F.get_json_object("_geometry", "$.type").alias("geom_type"),
                         F.get_json_object("_geometry", "$.coordinates").alias("_coordinates"))
    kind = F.col("geom_type")
    return parts.select("feature_id", "pos", "props", "geom_type", g.repair(g.from_coordinates(kind, F.col("_coordinates")), kind).alias("geom"),
                        F.lit(srid).alias("srid"))


def load_layer(spark: SparkSession, path: str, srid: int = 4326, fmt: str = "parquet") -> DataFrame:
    """A layer in the asked CRS; a missing path gives an empty layer, a missing CRS is the asked one."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], FEATURE_SCHEMA)
    layer = spark.read.parquet(path) if fmt == "parquet" else read_geojson(spark, path)
    return to_srid(layer, srid)


def to_srid(layer: DataFrame, srid: int) -> DataFrame:
    """Reproject rows whose ``srid`` differs (4326 and 3857)."""
    if srid not in (4326, 3857):
        raise ValueError("srid must be 4326 or 3857")
    own = F.coalesce(F.col("srid"), F.lit(srid)) if "srid" in layer.columns else F.lit(srid)
    moved = F.when(own == srid, F.col("geom")).otherwise(
        g.mercator(F.col("geom")) if srid == 3857 else g.unmercator(F.col("geom")))
    return layer.withColumn("geom", moved).withColumn("srid", F.lit(srid))


def risk_table(features: DataFrame) -> DataFrame:
    """(apn, risk_raw) rows: model score else rule score; rows without key or score dropped.

    A key that occurs twice keeps its first row.
    """
    f = Fields(features)
    apn = F.trim(F.coalesce(F.when(f.get("APN") != "", f.get("APN")), f.get("apn")))
    score = F.coalesce(f.get("xgb_risk_score"), f.get("rule_risk_score"))
    rows = features.select(apn.alias("apn"), score.alias("risk_text"), "pos").filter(
        (F.col("apn") != "") & F.col("risk_text").isNotNull())
    first = collapse_first(rows, ["apn"], "pos")
    return first.select("apn", number(F.col("risk_text")).alias("risk_raw"))


def parcel_centroids(features: DataFrame) -> DataFrame:
    """First valid row per parcel id with lon, lat and props.

    An id is taken by its first row with a usable geometry, later rows are duplicates.
    """
    f = Fields(features)
    centre = g.let(g.centroid(F.col("geom")), lambda c: F.when(g.plausible_lonlat(c["x"], c["y"]), c))
    rows = features.select(parcel_id(f, vocab.ID_ORDER_PROXIMITY).alias("parcel_id"), centre.alias("_c"), "pos", "props")
    rows = rows.select("parcel_id", F.col("_c.x").alias("lon"), F.col("_c.y").alias("lat"), "pos", "props")
    return collapse_first(rows, ["parcel_id"], "pos", F.col("parcel_id").isNotNull() & F.col("lon").isNotNull())


def centroid_quality(features: DataFrame) -> DataFrame:
    """One row: total, invalid, duplicate and usable counts of :func:`parcel_centroids`."""
    f = Fields(features)
    centre = g.centroid(F.col("geom"))
    rows = features.select(
        parcel_id(f, vocab.ID_ORDER_PROXIMITY).alias("parcel_id"),
        g.plausible_lonlat(centre["x"], centre["y"]).alias("ok"))
    per_id = rows.groupBy("parcel_id").agg(F.count("*").alias("n"), F.sum(F.col("ok").cast("bigint")).alias("n_ok"))
    usable = F.col("parcel_id").isNotNull() & (F.col("n_ok") > 0)
    return per_id.agg(
        F.sum("n").alias("total"),
        F.sum(F.when(usable, 1).otherwise(0)).alias("usable"),
        F.sum(F.when(F.col("parcel_id").isNull(), F.col("n")).otherwise(F.col("n") - F.col("n_ok"))).alias("invalid"),
        F.sum(F.when(usable, F.col("n_ok") - 1).otherwise(0)).alias("duplicates"))


def require_usable(centroids: DataFrame) -> DataFrame:
    if centroids.isEmpty():
        raise SourceError("no usable parcel geometries")
    return centroids


def regulation_pages(documents: DataFrame, file: str = "source", order: str = "page_id", text: str = "text") -> DataFrame:
    """(source, page_num, text): pages numbered from 1 inside each document; unreadable text is ''.

    Numbering goes by equal parts of an order index, so a document with most of the pages is not
    sorted in one task. The index holds digests for the texts; a text is written, moves once to meet
    its number, and is written again. Equal rows have numbers in a row, which they share out.
    """
    from lotweave.operators.prefix import running_number
    from lotweave.session import cut_lineage

    whole = [f.name for f in documents.schema if "map<" not in f.dataType.simpleString()]
    marked = cut_lineage(documents.select(file, order, text, F.xxhash64(*whole, F.lit(1)).alias("_tie1"), F.xxhash64(F.lit(2), *whole).alias("_tie2")))
    numbered = running_number(marked.select(file, order, "_tie1", "_tie2"), [file], order, "page_num", ["_tie1", "_tie2"])
    first = numbered.groupBy("_tie1", "_tie2").agg(F.min("page_num").alias("_first"))
    copies = Window.partitionBy("_tie1", "_tie2").orderBy(F.lit(0))
    met = marked.join(first, ["_tie1", "_tie2"]).withColumn("page_num", F.col("_first") + F.row_number().over(copies) - 1)
    return cut_lineage(met.select(F.col(file).alias("source"), "page_num", F.coalesce(F.col(text), F.lit("")).alias("text")))


def centroid_lonlat(features: DataFrame) -> DataFrame:
    """Centroid by property struct, then four column pairs, then geometry; null when none is plausible."""
    f = Fields(features)
    nested = f.get("centroid")

    def inner(*names: str) -> Column:
        return F.coalesce(*[number(F.get_json_object(nested, f"$.{n}")) for n in names])

    pairs = [(inner("x", "lon", "lng", "longitude"), inner("y", "lat", "latitude"))]
    for a, b in (("centroid_x", "centroid_y"), ("CENTROID_X", "CENTROID_Y"), ("longitude", "latitude"), ("lon", "lat")):
        pairs.append((number(f.get(a)), number(f.get(b))))
    centre = g.centroid(F.col("geom"))
    pairs.append((centre["x"], centre["y"]))
    best = F.coalesce(*[F.when(g.plausible_lonlat(x, y), F.struct(x.alias("lon"), y.alias("lat"))) for x, y in pairs])
    return features.withColumn("_c", best).withColumn("lon", F.col("_c.lon")).withColumn("lat", F.col("_c.lat")).drop("_c")


def first_feature_per_id(features: DataFrame, order: Sequence[str], keep_blank: bool) -> DataFrame:
    """First feature per id; a blank id becomes ``parcel-{pos}`` or is dropped."""
    f = Fields(features)
    pid = parcel_id(f, order, F.col("pos") if keep_blank else None)
    return collapse_first(features.withColumn("parcel_id", pid).filter(F.col("parcel_id").isNotNull()), ["parcel_id"], "pos")


def rectangles_to_features(zones: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Zone rows (id, x, y, width, height) to polygon features as GeoJSON text."""
    x, y = F.col("x"), F.col("y")
    geom = g.rectangle(x, y, x + F.col("width"), y + F.col("height"))
    body = F.struct(F.col("id"), *[F.col(c) for c in extra])
    return zones.select(
        "id", geom.alias("geom"),
        F.concat(F.lit('{"type":"Feature","geometry":'), g.to_geojson(geom, F.lit("Polygon")),
                 F.lit(',"properties":'), F.to_json(body), F.lit("}")).alias("feature"))


def with_planning_parameters(parcels: DataFrame, shared: dict[str, float] | None, own: str = "has_own") -> DataFrame:
    """Parcels with own parameters keep exactly those; others take the shared set."""
    out = parcels
    for name in vocab.FALLBACK_RANGES:
        common = F.lit((shared or {}).get(name)).cast("double")
        out = out.withColumn(name, F.when(F.col(own), F.col(name)).otherwise(common))
    return out


def invalid_features(features: DataFrame) -> DataFrame:
    """Rows whose geometry text was given but could not be read, or whose polygon ring crosses itself."""
    unread = F.col("geom_type").isNotNull() & F.col("geom").isNull()
    tested = features.withColumn("_crossing", g.self_crossing(F.col("geom"), F.col("geom_type")))
    return tested.filter(unread | F.col("_crossing")).drop("_crossing")


def plausible_layer(features: DataFrame) -> DataFrame:
    """One row ``ok``: all coordinates look like lon/lat; an empty layer is not ok."""
    pts = features.filter(F.col("geom").isNotNull()).select(F.explode(g.vertices(F.col("geom"))).alias("p"))
    return pts.agg(F.coalesce(F.bool_and(g.plausible_lonlat(F.col("p.x"), F.col("p.y"))), F.lit(False)).alias("ok"))


def resolve_overlay(candidate: DataFrame, fallback: DataFrame, candidate_id: str, fallback_id: str) -> DataFrame:
    """One row (plan_id, used_fallback): the fallback only when it is plausible and the candidate is not."""
    a = plausible_layer(candidate).withColumnRenamed("ok", "a")
    b = plausible_layer(fallback).withColumnRenamed("ok", "b")
    use_b = ~F.col("a") & F.col("b") & F.lit(candidate_id != fallback_id)
    return a.crossJoin(F.broadcast(b)).select(
        F.when(use_b, fallback_id).otherwise(F.lit(candidate_id)).alias("plan_id"), use_b.alias("used_fallback"))
