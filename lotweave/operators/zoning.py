"""Zoning layer joins, key filters and the merge with the risk layer."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotweave.functions.coerce import collapse_first
from lotweave.operators.ranking import key_of, norm_key
from lotweave.operators.spatial import first_per_column, first_per_layer

COUNTY_RENAMES = {"USEREG": "ZONING_CODE", "HEIGHT": "MAX_HEIGHT", "MAXFLR": "MAX_FAR", "LOT": "MIN_LOT_SIZE"}
LIMITS = ("MAX_HEIGHT", "MAX_FAR", "MIN_LOT_SIZE")


def add_jurisdiction(parcels: DataFrame, boundaries: DataFrame | None) -> DataFrame:
    """First non-null boundary name per parcel; without a usable layer every parcel is Unknown."""
    if boundaries is None or "Name" not in boundaries.columns:
        return parcels.withColumn("JURISDICTION", F.lit("Unknown"))
    return first_per_column(parcels, boundaries, {"Name": "JURISDICTION"})


def is_city(jurisdiction: Column) -> Column:
    return F.coalesce(F.lower(jurisdiction).contains("city"), F.lit(False))


def place_zoning(parcels: DataFrame, city: DataFrame | None, county: DataFrame | None, boundaries: DataFrame | None) -> DataFrame:
    """Jurisdiction, city zone (``city_zone``) and county zone columns, all in one spatial join."""
    layers = []
    if boundaries is not None and "Name" in boundaries.columns:
        layers.append((boundaries, {"Name": "JURISDICTION"}))
    if city is not None and "ZONE_NAME" in city.columns:
        layers.append((city, {"ZONE_NAME": "city_zone"}))
    if county is not None and "USEREG" in county.columns:
        renames = {s: f"county_{o}" for s, o in (COUNTY_RENAMES | {"DENSITY": "DENSITY"}).items() if s in county.columns}
        layers.append((county, renames))
    placed = first_per_layer(parcels, layers) if layers else parcels
    if "JURISDICTION" not in placed.columns:
        placed = placed.withColumn("JURISDICTION", F.lit("Unknown"))
    return _with_nulls(placed, ("city_zone", "county_ZONING_CODE", *[f"county_{c}" for c in LIMITS]))


def _base_columns(placed: DataFrame) -> list[str]:
    return [c for c in placed.columns if c != "city_zone" and not c.startswith("county_")]


def city_zoning(placed: DataFrame) -> DataFrame:
    """City parcels with the zone name; limits stay null."""
    none = [F.lit(None).cast(placed.schema[f"county_{c}"].dataType).alias(c) for c in LIMITS]
    return placed.filter(is_city(F.col("JURISDICTION"))).select(*_base_columns(placed), F.col("city_zone").alias("ZONING_CODE"), *none)


def county_zoning(placed: DataFrame) -> DataFrame:
    """All other parcels with the county zone and its limits; absent layer fields give nulls."""
    county = [F.col(c).alias(c.removeprefix("county_")) for c in placed.columns if c.startswith("county_")]
    return placed.filter(~is_city(F.col("JURISDICTION"))).select(*_base_columns(placed), *county)


def _with_nulls(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select("*", *[F.lit(None).cast("string").alias(c) for c in columns if c not in df.columns])


def union_common(first: DataFrame, second: DataFrame) -> DataFrame:
    """Rows of both frames on the columns they share."""
    common = [c for c in first.columns if c in set(second.columns)]
    types = dict(first.dtypes)
    other = dict(second.dtypes)

    def side(df: DataFrame) -> DataFrame:
        return df.select(*[F.col(c) if types[c] == other[c] else F.col(c).cast("string").alias(c) for c in common])

    return side(first).unionByName(side(second))


def assign_zoning(parcels: DataFrame, city: DataFrame | None, county: DataFrame | None,
                  boundaries: DataFrame | None) -> DataFrame:
    """City and county rows on their common columns, chosen per row so that the join runs once."""
    placed = place_zoning(parcels, city, county, boundaries)
    mine = is_city(F.col("JURISDICTION"))
    code = F.when(mine, F.col("city_zone")).otherwise(F.col("county_ZONING_CODE"))
    return placed.select(*_base_columns(placed), code.alias("ZONING_CODE"), *[
        F.when(~mine, F.col(f"county_{c}")).alias(c) for c in LIMITS])


def add_general_plan(parcels: DataFrame, layer: DataFrame | None) -> DataFrame:
    if layer is None or "GP_LU_DESC" not in layer.columns:
        return _with_nulls(parcels, ("GP_LAND_USE",))
    return first_per_column(parcels, layer, {"GP_LU_DESC": "GP_LAND_USE"})


def keep_baseline(parcels: DataFrame, baseline: DataFrame, names: Sequence[str] = ("APN", "PARCELID", "PARNO")) -> DataFrame:
    """Parcels whose key occurs in the baseline; everything when either side has no key column."""
    a, b = key_of(parcels, names), key_of(baseline, names)
    if a is None or b is None:
        return parcels
    keys = baseline.select(norm_key(F.col(b)).alias("_key"))
    return parcels.join(keys, norm_key(F.col(a)) == F.col("_key"), "left_semi")


def once_only(df: DataFrame, key: str) -> DataFrame:
    """Rows whose trimmed key occurs exactly once; null keys never match anything.

    Counting and picking happen in one grouped aggregate, so a key with very many rows is
    combined before the shuffle.
    """
    rest = df.columns
    grouped = (df.withColumn("_key", F.trim(F.col(key).cast("string"))).filter(F.col("_key").isNotNull())
               .groupBy("_key").agg(F.count("*").alias("_n"), F.any_value(F.struct(*rest)).alias("_row")))
    return grouped.filter("_n = 1").select("_key", "_row.*")


def merge_zoning(env: DataFrame, zoning: DataFrame, key: str = "APN", position: str = "pos") -> DataFrame:
    """Risk rows with zoning attributes; row count and shared columns of the risk side stay.

    Zoning rows join only on keys that occur once there. Without a common key the frames join
    on their row positions. Clashing zoning columns get the suffix ``_zoning``.
    """
    attributes = [c for c in zoning.columns if c not in ("geom", "geom_type", "srid")]
    z = zoning.select(*attributes)
    if key in env.columns and key in z.columns:
        unique = once_only(z, key).drop(key)
        renamed = unique.withColumnsRenamed({c: f"{c}_zoning" for c in unique.columns if c != "_key" and c in env.columns})
        return (env.join(renamed, F.trim(F.col(key).cast("string")) == F.col("_key"), "left").drop("_key"))
    renamed = z.withColumnsRenamed({c: f"{c}_zoning" for c in z.columns if c in env.columns and c != position})
    return env.join(renamed, position, "left")


def collapse_rows(df: DataFrame, row_id: str, order: str) -> DataFrame:
    """One row per ``row_id``: per column the first non-null value in ``order``."""
    rest = [c for c in df.columns if c not in (row_id, order)]
    return df.groupBy(row_id).agg(*[
        F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in rest])


def coverage(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """One row per column: rows, non-null rows and percent."""
    stats = df.agg(F.count("*").alias("n"), *[F.count(c).alias(name) for c, name in columns.items()])
    return stats.unpivot("n", list(columns.values()), "field", "present").select(
        "field", "n", "present", F.round(F.col("present") * 100.0 / F.col("n"), 1).alias("percent"))


def append_new(stored: DataFrame, batch: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Rows of the batch not stored yet, one per key."""
    fresh = batch.join(stored.select(key), key, "left_anti")
    return collapse_first(fresh, [key], F.xxhash64(*[c for c in fresh.columns if c != key]))
