"""Neighbourhood summaries around centre parcels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotweave.functions import vocab
from lotweave.functions.coerce import Fields, first_present, numeric_truthy
from lotweave.functions.landuse import proximity_use
from lotweave.functions.risk import proximity_risk, staged
from lotweave.operators.ranking import most_frequent, top_k
from lotweave.operators.spatial import nearby

USES = (*vocab.LAND_USES, "unknown")


def nearest(centres: DataFrame, parcels: DataFrame, radius_m: float, limit: int = 150) -> DataFrame:
    """The ``limit`` nearest per centre by (distance, id)."""
    if not 1 <= limit <= 1000:
        raise ValueError("limit must be 1..1000")
    return top_k(nearby(centres, parcels, radius_m), ["centre_id"], ["distance_m", "parcel_id"], limit)


def planning_facts(features: DataFrame, key: str = "parcel_id") -> DataFrame:
    """Risk, zoning, land-use bucket and hazard flags of each parcel as this summary reads them."""
    features = staged(features)
    f = Fields(features)
    hazards = {}
    for name, aliases in vocab.HAZARD_ALIASES.items():
        hit = F.lit(False)
        for alias in aliases:
            hit = hit | numeric_truthy(f.get(alias), vocab.TRUE_WORDS_PROXIMITY)
        hazards[name] = hit
    return features.select(
        key, proximity_risk(f).alias("risk"), first_present(f, vocab.ZONING_KEYS_PROXIMITY).alias("zoning"),
        proximity_use(first_present(f, vocab.LAND_USE_KEYS_PROXIMITY)).alias("bucket"),
        *[c.alias(f"hz_{n}") for n, c in hazards.items()])


def summaries(members: DataFrame, facts: DataFrame) -> DataFrame:
    """One summary per centre. ``members`` is (centre_id, parcel_id, rank)."""
    # sides are as long as the parcels, whatever Spark guesses from the compressed file: none is broadcast
    rows = members.select("centre_id", "parcel_id", "rank").hint("merge").join(facts.hint("merge"), "parcel_id")
    stats = rows.groupBy("centre_id").agg(
        F.coalesce(F.round(F.avg("risk"), 3), F.lit(0.0)).alias("average_risk"),
        F.sum(F.coalesce((F.col("risk") >= 0.6).cast("bigint"), F.lit(0))).alias("high_risk_count"),
        *[F.sum((F.col("bucket") == u).cast("bigint")).alias(f"use_{u}") for u in USES],
        *[F.sum(F.col(f"hz_{h}").cast("bigint")).alias(f"hazard_{h}") for h in vocab.HAZARD_ALIASES])
    zones = rows.filter(F.col("zoning").isNotNull()).groupBy("centre_id", "zoning").agg(
        F.count("*").alias("n"))
    counts = zones.groupBy("centre_id").agg(F.array_join(F.array_sort(F.collect_list(
        F.concat_ws("=", "zoning", F.col("n").cast("string")))), ",").alias("zoning_counts"))
    mode = most_frequent(rows, ["centre_id"], "zoning", "rank", "dominant_zoning")
    full = stats.join(counts.hint("merge"), "centre_id", "left").join(mode.hint("merge"), "centre_id", "left").fillna("Unknown", ["dominant_zoning"]).fillna("", ["zoning_counts"])
    return full.withColumn("insight", insight())


def insight() -> Column:
    """First rule that holds, on the columns of :func:`summaries`."""
    r, c, i, g, u = (F.col(f"use_{x}") for x in USES)
    risk, high = F.col("average_risk"), F.col("high_risk_count")
    total = r + c + i + g + u
    return (
        F.when((total > 0) & ((risk >= 0.6) | (high >= F.greatest(F.lit(3), F.ceil(total * 0.3)))), F.lit(
            "Nearby parcels show elevated environmental risk. Green/open-space allocation or additional "
            "environmental review may be appropriate."))
        .when((i >= 2) & (r >= 2), F.lit(
            "The nearby area contains both industrial and residential activity, so buffering and compatibility "
            "review are recommended."))
        .when((c > 0) & (c >= F.greatest(r, i, g)), F.lit(
            "This parcel is close to an existing commercial cluster, which may support service-oriented or "
            "mixed-use planning."))
        .when((r > 0) & (r >= F.greatest(c, i, g)) & (risk <= 0.35), F.lit(
            "This parcel is located in a mostly residential, low-risk area. Residential growth may fit the "
            "surrounding pattern, while commercial use should be reviewed for compatibility."))
        .when((g > 0) & (g >= F.greatest(r, c, i)), F.lit(
            "This parcel is surrounded by more open-space and environmental activity, so conservation-sensitive "
            "planning may be appropriate."))
        .otherwise(F.concat(F.lit("This parcel sits in a mixed-use area dominated by "), F.lower("dominant_zoning"),
                            F.lit(". Compatibility review is recommended."))))


def empty_summary(centres: DataFrame) -> DataFrame:
    """The fixed summary of centres with no known neighbour."""
    return centres.select(
        F.col("parcel_id").alias("centre_id"), F.lit(0.0).alias("average_risk"), F.lit(0).cast("bigint").alias("high_risk_count"),
        *[F.lit(0).cast("bigint").alias(f"use_{u}") for u in USES],
        *[F.lit(0).cast("bigint").alias(f"hazard_{h}") for h in vocab.HAZARD_ALIASES],
        F.lit("").alias("zoning_counts"), F.lit("Unknown").alias("dominant_zoning"),
        F.lit("Select nearby parcels to view planning context.").alias("insight"))
