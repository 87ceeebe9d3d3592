"""Top-k, modes, samples and order-preserving distinct."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence, k: int, rank: str = "rank") -> DataFrame:
    """First k rows per key; Spark cuts each map partition to k rows per key before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def most_frequent(df: DataFrame, keys: Sequence[str], value: str, pos: str, out: str = "mode") -> DataFrame:
    """Most frequent non-null value per key; ties go to the value seen first."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(
        F.count("*").alias("_n"), F.min(pos).alias("_first"))
    best = F.max_by(value, F.struct(F.col("_n"), -F.col("_first"))).alias(out)
    return counts.groupBy(*keys).agg(best) if keys else counts.agg(best)


def exact_sample(df: DataFrame, key: str, limit: int, seed: int = 42) -> DataFrame:
    """Exactly ``limit`` rows when there are more, else all rows; the same rows on every run.

    Part of the behaviour, not a shortcut: the layers are published at this size. Rows are drawn
    by hash. A hash bound that lets a little more than ``limit`` rows through keeps the final
    ordering small; when many rows share a key and too few pass, the ordering takes all rows.
    """
    total = df.count()
    if total <= limit:
        return df
    drawn = df.withColumn("_draw", F.xxhash64(F.lit(seed), F.col(key).cast("string")))
    share = min(1.0, (limit + 10 * limit ** 0.5 + 100) / total)
    few = drawn.filter(F.col("_draw") <= int(-(2 ** 63) + (2 ** 64 - 1) * share))
    source = few if few.count() >= limit else drawn
    return source.orderBy("_draw", key).limit(limit).drop("_draw")


def distinct_in_order(df: DataFrame, key: str, pos: str = "pos") -> DataFrame:
    """Unique keys with the position where each was first seen."""
    return df.groupBy(key).agg(F.min(pos).alias(pos))


def history_tail(turns: DataFrame, session: str = "session_id", order: str = "turn", keep: int = 20,
                 context: int = 8) -> DataFrame:
    """Last ``keep`` turns per session; ``in_context`` marks the last ``context`` of them."""
    return top_k(turns, [session], [F.desc(order)], keep, "from_last").withColumn(
        "in_context", F.col("from_last") <= context)


def lowest_winners(df: DataFrame, run: str, metrics: Sequence[str], tolerance: float = 1e-9) -> DataFrame:
    """Per run and metric: plans within ``tolerance`` of the lowest value.

    None when fewer than two values exist or they do not spread.
    """
    long = df.unpivot([run, "plan"], list(metrics), "metric", "value").filter(
        F.col("value").isNotNull() & ~F.isnan("value"))
    best = long.groupBy(run, "metric").agg(
        F.min("value").alias("lo"), F.max("value").alias("hi"), F.count("*").alias("n"))
    spread = best.filter((F.col("n") >= 2) & (F.col("hi") - F.col("lo") > tolerance))
    return long.join(spread, [run, "metric"]).filter(F.col("value") <= F.col("lo") + tolerance).select(
        run, "metric", "plan", "value")


def key_of(df: DataFrame, names: Sequence[str]) -> str | None:
    return next((n for n in names if n in df.columns), None)


def norm_key(c: Column) -> Column:
    return F.upper(F.trim(c.cast("string")))
