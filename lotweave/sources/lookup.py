"""Lookup tables and stored-run listing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotweave.functions import vocab


def zone_parameter(code: Column, field: str) -> Column:
    """A field of the six-row zone table (exact code match, null when absent)."""
    index = ("code", "MAX_HEIGHT", "MAX_FAR", "MIN_LOT_SIZE", "ALLOWED_USES").index(field)
    expr = None
    for row in vocab.ZONE_PARAMETERS:
        value = row[index]
        lit = F.array(*[F.lit(u) for u in value]) if isinstance(value, tuple) else F.lit(value)
        expr = F.when(code == row[0], lit) if expr is None else expr.when(code == row[0], lit)
    return expr


def with_zone_parameters(df: DataFrame, code: str = "ZONING_CODE") -> DataFrame:
    """Fill the four limits from the zone table only where they are null."""
    out = df
    for field in ("MAX_HEIGHT", "MAX_FAR", "MIN_LOT_SIZE", "ALLOWED_USES"):
        looked_up = zone_parameter(F.col(code), field)
        out = out.withColumn(field, F.coalesce(F.col(field), looked_up) if field in df.columns else looked_up)
    return out


def run_listing(runs: DataFrame, user_id, limit: int, offset: int) -> DataFrame:
    """One page of a user's stored runs, newest first, with the total count on every row."""
    mine = runs.filter(F.col("user_id") == user_id)
    total = mine.agg(F.count("*").alias("total"))
    page = (mine.select("id", "name", F.size("parcels").alias("parcel_count"), F.size("plans").alias("plan_count"),
                        "created_at", "updated_at")
            .orderBy(F.desc("updated_at"), F.desc("id")).offset(offset).limit(limit))
    return page.crossJoin(F.broadcast(total))
