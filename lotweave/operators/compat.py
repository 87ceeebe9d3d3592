"""Neighbour-aware scoring of plans.

Pairs come from :func:`lotweave.operators.spatial.neighbour_pairs`; assignments are rows
(plan, parcel_id, use); risk is a column per parcel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotweave.functions import vocab
from lotweave.functions.coerce import kept
from lotweave.functions.landuse import compatibility_use, pair_score


def assignment_lookup(assignments: DataFrame, plan: str = "plan", key: str = "parcel_id", use: str = "use_label",
                      order: str = "pos") -> DataFrame:
    """(plan, parcel_id, use): incomplete rows dropped, the last row of an id wins."""
    rows = assignments.filter(F.col(key).isNotNull() & F.col(use).isNotNull())
    return rows.groupBy(plan, key).agg(F.max_by(use, order).alias("use"))


def _pair_terms(left_use: Column, right_use: Column, risk: Column, whole_plan: bool) -> dict[str, Column]:
    either = lambda *uses: left_use.isin(*uses) | right_use.isin(*uses)
    elevated, severe = risk >= 0.6, risk >= 0.8
    green, industrial = either("green"), either("industrial")
    score = (pair_score(left_use, right_use)
             + F.when(green & elevated, 0.75).otherwise(0.0)
             - F.when(industrial & elevated, 0.4).otherwise(0.0))
    if whole_plan:
        built = either("residential", "commercial")
        score = score - F.when(built & severe, 0.25).when(built & elevated, 0.15).otherwise(0.0)
    return {"score": score, "buffer": green & elevated, "clash": industrial & either("residential")}


def _count(flag: Column) -> Column:
    return F.coalesce(F.sum(flag.cast("bigint")), F.lit(0))


def scenario_keys(*frames: DataFrame) -> list[str]:
    """``scenario_id`` when every frame carries it."""
    return ["scenario_id"] if all("scenario_id" in f.columns for f in frames) else []


def scored_pairs(pairs: DataFrame, assignments: DataFrame, risks: DataFrame) -> DataFrame:
    """One row per (plan, pair). Both ends use the same lookup, ids without assignment are unknown.

    Risks join once per pair, before the plans multiply the rows. Where pairs and assignments carry
    ``scenario_id``, a pair meets the plans of its own scenario only.
    """
    within = scenario_keys(pairs, assignments)
    own = [c for c in within if c in risks.columns]
    r = risks.select("parcel_id", "risk", *own)
    with_risk = (
        pairs.join(r.withColumnsRenamed({"parcel_id": "left_id", "risk": "_lr"}), ["left_id", *own], "left")
        .join(r.withColumnsRenamed({"parcel_id": "right_id", "risk": "_rr"}), ["right_id", *own], "left")
        .withColumn("max_risk", F.greatest(F.coalesce("_lr", F.lit(0.0)), F.coalesce("_rr", F.lit(0.0))))
        .drop("_lr", "_rr"))
    plans = assignments.select(*within, "plan").distinct()
    uses = assignments.groupBy("parcel_id", *within).agg(
        F.map_from_entries(F.collect_list(F.struct("plan", compatibility_use(F.col("use"))))).alias("uses"))
    both = (
        with_risk.join(uses.withColumnsRenamed({"parcel_id": "left_id", "uses": "_lu"}), ["left_id", *within], "left")
        .join(uses.withColumnsRenamed({"parcel_id": "right_id", "uses": "_ru"}), ["right_id", *within], "left"))
    every = plans.groupBy(*within).agg(F.sort_array(F.collect_list("plan")).alias("_plans"))  # a scenario's plans
    met = both.join(every, within) if within else both.crossJoin(F.broadcast(every))
    rows = met.withColumn("plan", F.explode("_plans"))
    pick = lambda m: F.coalesce(F.col(m)[F.col("plan")], F.lit("unknown"))
    return rows.select(*within, "plan", "left_id", "right_id", "distance_m", "max_risk",
                       pick("_lu").alias("left_use"), pick("_ru").alias("right_use"))


def plan_scores(pairs: DataFrame, assignments: DataFrame, risks: DataFrame) -> DataFrame:
    """Per plan: score (0-1, 4 dp), raw score and the five pair counts; plans without pairs score 0."""
    rows = scored_pairs(pairs, assignments, risks)
    keys = [*scenario_keys(rows), "plan"]
    t = _pair_terms(F.col("left_use"), F.col("right_use"), F.col("max_risk"), whole_plan=True)
    s = rows.withColumn("_s", t["score"]).groupBy(*keys).agg(
        F.count("*").alias("neighbor_pairs_evaluated"),
        _count(F.col("_s") > 0).alias("compatible_pairs"), _count(F.col("_s") < 0).alias("conflict_pairs"),
        _count(t["buffer"]).alias("green_buffer_pairs"), _count(t["clash"]).alias("industrial_residential_conflicts"),
        F.sum("_s").alias("_raw"))
    mean = F.col("_raw") / F.col("neighbor_pairs_evaluated")
    scaled = F.least(F.greatest((mean + 5.0) / 9.0, F.lit(0.0)), F.lit(1.0))
    scored = s.select(*keys, F.round(scaled, 4).alias("score"), F.round("_raw", 4).alias("raw_score"),
                      *[c for c in s.columns if c not in (*keys, "_raw")])
    counts = [c for c in scored.columns if c not in keys]
    return assignments.select(*keys).distinct().join(scored, keys, "left").fillna(0, counts)


def objective(scores: DataFrame, weight: float | None = 0.15) -> DataFrame:
    """weight x (1 - score); 0 without pairs or with a weight of 0 or less; an unreadable weight is .15."""
    try:
        w = max(float(weight), 0.0)
    except (TypeError, ValueError):
        w = 0.15
    idle = (F.col("neighbor_pairs_evaluated") == 0) | F.lit(w <= 0)
    return scores.select(*scenario_keys(scores), "plan", F.when(idle, 0.0).otherwise((F.lit(1.0) - F.col("score")) * w).alias("penalty"))


def _plural(n: Column, one: str, many: str) -> Column:
    return F.when(n == 1, F.lit(one)).otherwise(F.lit(many))


def notes(scores: DataFrame) -> DataFrame:
    """Up to two sentences per plan."""
    clash, conflict, buffer = (F.col(c) for c in ("industrial_residential_conflicts", "conflict_pairs", "green_buffer_pairs"))
    text = lambda n, *parts: F.concat(n.cast("string"), *parts)
    first = (
        F.when(clash > 0, text(clash, F.lit(" industrial-residential proximity "), _plural(clash, "conflict was", "conflicts were"), F.lit(" detected.")))
        .when(conflict > 0, text(conflict, F.lit(" nearby land-use compatibility "), _plural(conflict, "conflict was", "conflicts were"), F.lit(" detected."))))
    second = F.when(buffer > 0, text(buffer, F.lit(" green-buffer "), _plural(buffer, "relationship", "relationships"),
                                     F.lit(" support environmental protection.")))
    return scores.select("plan", F.array_join(kept(first, second), " ").alias("notes"))


def local_context(pairs: DataFrame, assignments: DataFrame, risks: DataFrame, nearest: int = 5) -> DataFrame:
    """Neighbour context of every (plan, parcel), all at once.

    Unlike :func:`plan_scores` it has no built-near-risk penalty. The five nearest are kept
    per parcel by a ranked cut, counts cover every neighbour.
    """
    rows = scored_pairs(pairs, assignments, risks)
    swap = rows.select("plan", F.col("right_id").alias("parcel_id"), F.col("left_id").alias("other_id"),
                       F.col("right_use").alias("own_use"), F.col("left_use").alias("other_use"), "distance_m", "max_risk")
    both = rows.select("plan", F.col("left_id").alias("parcel_id"), F.col("right_id").alias("other_id"),
                       F.col("left_use").alias("own_use"), F.col("right_use").alias("other_use"),
                       "distance_m", "max_risk").unionAll(swap)
    t = _pair_terms(F.col("own_use"), F.col("other_use"), F.col("max_risk"), whole_plan=False)
    terms = both.withColumn("_s", t["score"]).withColumn("_b", t["buffer"]).withColumn("_c", t["clash"])
    keys = ["plan", "parcel_id"]
    counts = terms.groupBy(*keys).agg(
        F.count("*").alias("neighbor_pairs_evaluated"),
        _count(F.col("_s") > 0).alias("compatible_pairs"), _count(F.col("_s") < 0).alias("conflict_pairs"),
        _count(F.col("_b")).alias("green_buffer_pairs"), _count(F.col("_c")).alias("industrial_residential_conflicts"),
        *[_count(F.col("other_use") == u).alias(f"near_{u}") for u in (*vocab.LAND_USES, "unknown")])
    from lotweave.operators.ranking import top_k

    near = top_k(terms.withColumn("_d", F.round("distance_m", 1)), keys, ["_d", "other_id"], nearest)
    closest = near.groupBy(*keys).agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("rank", "other_id", "_d", "_s"))),
        lambda n: F.concat_ws(":", n["other_id"], n["_d"].cast("string"), F.round(n["_s"], 3).cast("string"))), " ").alias("closest"))
    centre = risks.select("parcel_id", F.col("risk").alias("centre_risk"))
    own = assignments.select("plan", "parcel_id", compatibility_use(F.col("use")).alias("assigned_use"))
    full = (own.join(counts, keys, "left").join(closest, keys, "left").join(centre, "parcel_id", "left")
            .fillna(0, [c for c in counts.columns if c not in keys]).fillna(0.0, ["centre_risk"]).fillna("", ["closest"]))
    return full.withColumn("reasons", _context_reasons()).withColumn("warnings", _context_warnings())


def _same_use_count() -> Column:
    expr = F.lit(0).cast("bigint")
    for u in vocab.LAND_USES:
        expr = F.when(F.col("assigned_use") == u, F.col(f"near_{u}")).otherwise(expr)
    return expr


def _context_reasons() -> Column:
    n, use, same, buffer = F.col("neighbor_pairs_evaluated"), F.col("assigned_use"), _same_use_count(), F.col("green_buffer_pairs")
    alone = F.array(F.lit(
        "No nearby assigned parcels were found within the spatial compatibility radius, so this "
        "assignment is not strongly influenced by local clustering."))
    some = kept(
        F.when(same > 0, F.concat(
            F.lit("Within the spatial compatibility radius, this parcel is near "), same.cast("string"), F.lit(" other "), use,
            _plural(same, " assignment", " assignments"), F.lit(", which supports land-use clustering."))),
        F.when(buffer > 0, F.concat(
            F.lit("Nearby green/open-space relationships help buffer environmental risk in "), buffer.cast("string"),
            _plural(buffer, " local pair.", " local pairs."))),
        F.when((use == "green") & (F.col("centre_risk") >= 0.6), F.lit(
            "This parcel has elevated environmental risk, so green assignment can support local buffering "
            "and lower-intensity use.")))
    return F.when(n <= 0, alone).otherwise(some)


def _context_warnings() -> Column:
    n, clash, conflict = F.col("neighbor_pairs_evaluated"), F.col("industrial_residential_conflicts"), F.col("conflict_pairs")
    some = kept(
        F.when(clash > 0, F.concat(
            F.lit("This parcel is involved in "), clash.cast("string"), F.lit(" industrial-residential proximity "),
            _plural(clash, "conflict", "conflicts"), F.lit("; buffering or compatibility review is recommended.")))
        .when(conflict > 0, F.concat(
            F.lit("This parcel has "), conflict.cast("string"), F.lit(" nearby land-use compatibility "),
            _plural(conflict, "conflict", "conflicts"), F.lit(" within the selected radius."))),
        F.when((F.col("assigned_use") == "industrial") & (F.col("near_green") > 0), F.lit(
            "Industrial assignment is close to green/open-space parcels, so environmental buffering and edge "
            "compatibility should be reviewed.")))
    return F.when(n <= 0, F.array().cast("array<string>")).otherwise(some)
