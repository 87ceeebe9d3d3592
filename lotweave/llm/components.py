"""Connected components of an edge table, by contraction.

Each round gives every node the neighbour with the smallest hashed id and renames the ends of all
edges by it. Hashed ids make chains short, so nodes shrink by a steady factor a round whatever the
shape; a hub with any number of edges is a key that is only aggregated (combined before the shuffle)
or joined (split by adaptive execution). Rounds are written tables, never driver lists.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotweave.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every node of ``edges`` (a, b); the component is its smallest id."""
    now = edges.select(F.col("a").cast("bigint"), F.col("b").cast("bigint")).filter("a <> b").distinct()
    steps: list[DataFrame] = []
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = F.struct(F.xxhash64("b").alias("h"), F.col("b").alias("id"))
        own = F.struct(F.xxhash64("a").alias("h"), F.col("a").alias("id"))
        parent = both.groupBy("a").agg(F.min(rank).alias("p")).select(F.col("a").alias("id"), F.least("p", own)["id"].alias("to"))
        up = now
        for c in ("a", "b"):
            up = up.join(parent.select(F.col("id").alias(c), F.col("to").alias(f"{c}_to")), c)
        # one table a round: its ends name the parents, its parents are the next round's edges
        up = written(up.select("a", "b", "a_to", "b_to"), "contracted")
        steps.append(up.select("a", F.col("a_to").alias("to")).unionByName(up.select(F.col("b").alias("a"), F.col("b_to").alias("to"))).distinct())
        now = up.filter("a_to <> b_to").select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b")).distinct()
        if now.isEmpty():
            break
    names = steps[0].select(F.col("a").alias("id"), F.col("to").alias("root"))
    for step in steps[1:]:
        names = names.join(step.select(F.col("a").alias("root"), "to"), "root", "left").select("id", F.coalesce("to", "root").alias("root"))
    least = names.groupBy("root").agg(F.min("id").alias("component"))
    return names.join(least, "root").select("id", "component")
