"""Why a parcel got its use: reasons, warnings, headline and scores for every assignment at once."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotweave.functions import risk as rk
from lotweave.functions import vocab
from lotweave.functions.coerce import Fields, fixed, kept, when_in_order
from lotweave.functions.landuse import planner_allowed_uses
from lotweave.operators.scoring import flag_columns
from lotweave.session import cut_lineage

HIGH_TEXT = {
    "residential": ("Residential suitability is high (", "), so the parcel is a strong candidate for housing-oriented development."),
    "commercial": ("Commercial suitability is high (", "), so the parcel is a strong candidate for activity-serving or business use."),
    "industrial": ("Industrial suitability is high (", "), so the parcel is relatively suitable for employment or production-oriented use."),
    "green": ("Green/open-space suitability is high (", "), so the parcel is a strong candidate for conservation, park, or buffer use."),
}
LOW_RISK_TEXT = {
    "residential": "which makes residential development more feasible from a hazard-exposure perspective.",
    "commercial": "which makes commercial activity more feasible from a hazard-exposure perspective.",
    "industrial": "which reduces hazard-related concerns for industrial allocation.",
}


def suitability_rank(scores: Mapping[str, Column]) -> Column:
    """Uses by score, highest first, label order on ties: array of (neg, place, use)."""
    return F.array_sort(F.array(*[
        F.struct((-c).alias("neg"), F.lit(i).alias("place"), F.lit(u).alias("use"))
        for i, (u, c) in enumerate(scores.items())]))


def parcel_facts(features: DataFrame, key: str = "parcel_id") -> DataFrame:
    """What an explanation needs to know about a parcel; worked out once per parcel, not per plan."""
    rows = rk.staged(features)
    f = Fields(rows)
    rows = rows.withColumn("risk_norm", rk.strict_risk(f, vocab.RISK_KEYS_EXPLANATION))
    scores = rk.explanation_suitability(f, F.col("risk_norm"))
    signal = reduce(lambda a, b: a | b, [F.coalesce(f.get(n) != "", F.lit(False)) for n in (
        "allowed_uses", "ZONING_CODE", "GP_LAND_USE", "zoning_code", "gp_land_use")])
    base = rows.select(
        key, "risk_norm", *[c.alias(f"s_{u}") for u, c in scores.items()], rk.active_labels(flag_columns(f)).alias("hazards"),
        signal.alias("zoning_signal"), planner_allowed_uses(f).alias("_allowed"))
    ranked = suitability_rank({u: F.col(f"s_{u}") for u in vocab.LAND_USES})
    return cut_lineage(base.select("*", F.when(F.col("zoning_signal"), F.col("_allowed")).alias("allowed"), ranked.alias("ranked")).drop("_allowed"))


def assignment_facts(assignments: DataFrame, facts: DataFrame, target: Mapping[str, float] | None = None) -> DataFrame:
    """Assignments (plan, parcel_id, use) with score, rank, best use, gap and target share.

    A use outside the four labels is an error.
    """
    use = F.lower(F.trim("use"))
    checked = F.when(use.isin(*vocab.LAND_USES), use).otherwise(F.raise_error(F.concat(F.lit("Unsupported assigned use: "), F.col("use"))))
    weights = {k.strip().lower(): float(v) for k, v in (target or {}).items() if float(v) > 0}
    total = sum(weights.values())
    share = when_in_order([(F.col("assigned") == u, F.lit(w / total)) for u, w in weights.items()]) if weights else F.lit(None).cast("double")
    rows = assignments.select("plan", "parcel_id", checked.alias("assigned")).join(facts.hint("merge"), "parcel_id")
    own = when_in_order([(F.col("assigned") == u, F.col(f"s_{u}")) for u in vocab.LAND_USES])
    best = F.get("ranked", F.lit(0))
    place = F.array_position(F.transform("ranked", lambda r: r["use"]), F.col("assigned"))
    scored = rows.select("*", own.alias("score"), best["use"].alias("best_use"), (-best["neg"]).alias("best_score"),
                         place.cast("int").alias("rank"), share.alias("target_share"))
    return scored.withColumn("gap", F.col("best_score") - F.col("score"))


def _texts() -> dict[str, Column]:
    c = F.col
    use, title, best = c("assigned"), F.initcap("assigned"), F.initcap("best_use")
    score, gap, risk, share = c("score"), c("gap"), c("risk_norm"), c("target_share")
    s2, b2 = fixed(score, 2), fixed(c("best_score"), 2)
    pct = F.concat(F.lit(" ("), F.format_string("%.0f", risk * 100), F.lit("%), "))
    green, is_best = use == "green", use == c("best_use")
    hazard_text = F.array_join(F.slice("hazards", 1, 3), ", ")
    target_text = F.concat(F.format_string("%.0f", share * 100), F.lit("% "), use)
    allowed = F.coalesce(F.array_contains("allowed", use), F.lit(False))
    return {
        "r_suit": F.when(score >= 0.7, when_in_order([(use == u, F.concat(F.lit(a), s2, F.lit(b))) for u, (a, b) in HIGH_TEXT.items()]))
        .when(score >= 0.4, F.concat(title, F.lit(" suitability is moderate ("), s2, F.lit("), so this assignment is acceptable but not a perfect parcel-level fit."))),
        "w_suit": F.when(score >= 0.4, None).when(score > 0, F.concat(title, F.lit(" suitability is weak for this parcel ("), s2, F.lit(").")))
        .otherwise(F.concat(title, F.lit(" suitability is very low or unavailable for this parcel ("), s2, F.lit(")."))),
        "r_best": F.when(is_best & (score > 0), F.concat(title, F.lit(" is the best suitability option for this parcel.")))
        .when(is_best | (gap >= 0.25) | ((gap >= 0.10) & (score >= 0.30)), None)
        .when(score >= 0.4, F.concat(title, F.lit(" is close to the best suitability option, with only a small score difference from "), best, F.lit("."))),
        "w_best": F.when(is_best, None)
        .when(gap >= 0.25, F.concat(title, F.lit(" was selected even though "), best, F.lit(" has a much higher suitability score ("), b2, F.lit(" vs "), s2, F.lit(").")))
        .when((gap >= 0.10) & (score >= 0.30), F.concat(title, F.lit(" is not the top suitability option; "), best, F.lit(" scores slightly better ("), b2, F.lit(" vs "), s2, F.lit(").")))
        .when(score >= 0.4, None)
        .otherwise(F.concat(title, F.lit(" does not appear to be a strong suitability match compared with the best option, "), best, F.lit("."))),
        "r_risk": F.when(green & (risk >= 0.7), F.concat(F.lit("Environmental risk is high"), pct, F.lit("so assigning this parcel to green/open space helps avoid exposing development to hazards.")))
        .when(green & (risk >= 0.4), F.concat(F.lit("Environmental risk is moderate"), pct, F.lit("so green/open-space use can act as a safer buffer or lower-intensity use.")))
        .when(green & risk.isNotNull(), F.concat(F.lit("Environmental risk is low"), pct, F.lit("so this green assignment is more likely driven by suitability, zoning, or target-mix balance than hazard avoidance.")))
        .when(risk < 0.4, F.concat(F.lit("Environmental risk is low"), pct, when_in_order([(use == u, F.lit(t)) for u, t in LOW_RISK_TEXT.items()]))),
        "w_risk": F.when(green, None)
        .when(risk >= 0.7, F.concat(F.lit("Environmental risk is high"), pct, F.lit("so assigning this parcel to built use requires careful planner review.")))
        .when(risk >= 0.4, F.concat(F.lit("Environmental risk is moderate"), pct, F.lit("so "), use, F.lit(" development may need mitigation or additional review."))),
        "r_hazard": F.when(green & (F.size("hazards") > 0), F.concat(F.lit("Active hazard or constraint factors support a lower-intensity open-space treatment: "), hazard_text, F.lit("."))),
        "w_hazard": F.when(~green & (F.size("hazards") > 0), F.concat(F.lit("Active hazard or constraint factors require review before built development: "), hazard_text, F.lit("."))),
        "r_zone": F.when(allowed, F.concat(F.lit("Available zoning or land-use information appears compatible with "), F.when(green, "green/open-space").otherwise(use), F.lit(" use."))),
        "w_zone": F.when(c("zoning_signal") & ~allowed, F.concat(F.lit("Available zoning information does not clearly allow "), use, F.lit(" use."))),
        "r_target": F.when((share > 0) & ((score < 0.4) | ~is_best), F.concat(F.lit("The selected scenario targets about "), target_text, F.lit(" land use, so this assignment may be helping satisfy the plan-level land-use mix.")))
        .when(share > 0, F.concat(F.lit("This assignment also supports the scenario target of about "), target_text, F.lit(" land use."))),
        "w_trade": F.when((score < 0.3) & ~is_best, F.concat(F.lit("This looks like a plan-level trade-off rather than a parcel-level best-fit assignment because "), use, F.lit(" suitability is low and "), best, F.lit(" is the stronger option."))),
    }


def _headline(spatial: bool) -> Column:
    c = F.col
    use, score, risk, share = c("assigned"), c("score"), c("risk_norm"), c("target_share")
    is_best = use == c("best_use")
    parts = [
        F.when(is_best & (score >= 0.4), F.concat(use, F.lit(" is the strongest suitability match"))),
        F.when((use == "green") & (risk >= 0.4), F.lit("green use reduces exposure to environmental constraints")),
        F.when((use != "green") & (risk <= 0.35), F.lit("environmental risk is low enough for built use")),
        F.when(F.array_contains("allowed", use), F.lit("zoning appears compatible")),
        F.when((share > 0) & ((score < 0.4) | ~is_best), F.lit("the scenario needs this land-use category to meet the target mix")),
    ]
    if spatial:
        parts.append(F.when(c("conflict_pairs") > 0, F.lit("nearby land-use compatibility creates a review concern"))
                     .when(c("compatible_pairs") > 0, F.lit("nearby assignments support spatial compatibility")))
    why = kept(*parts)
    lead = F.concat(F.lit("This parcel was assigned as "), F.upper(use))
    return (F.when((score < 0.3) & ~is_best, F.concat(
        lead, F.lit(", but the explanation indicates a trade-off: "), F.initcap(use), F.lit(" suitability is low while "),
        F.initcap("best_use"), F.lit(" is the better parcel-level fit.")))
        .when(F.size(why) > 0, F.concat(lead, F.lit(" mainly because "), F.array_join(why, ", "), F.lit(".")))
        .otherwise(F.concat(lead, F.lit(" based on the combined optimizer trade-off between suitability, risk, zoning, and target mix."))))


def explain_assignments(assignments: DataFrame, features: DataFrame, target: Mapping[str, float] | None = None,
                        context: DataFrame | None = None) -> DataFrame:
    """Explain (plan, parcel_id, use) rows; ``features`` holds the parcels' properties by parcel_id.

    ``context`` is the output of ``compat.local_context``; its reasons and warnings are appended.
    """
    facts = assignment_facts(assignments, parcel_facts(features), target)
    t = _texts()
    reasons = kept(*[v for k, v in t.items() if k.startswith("r_")])
    warnings = kept(*[v for k, v in t.items() if k.startswith("w_")])
    if context is not None:
        ctx = context.select("plan", "parcel_id", "conflict_pairs", "compatible_pairs",
                             F.col("reasons").alias("_cr"), F.col("warnings").alias("_cw"))
        facts = facts.join(ctx.hint("merge"), ["plan", "parcel_id"], "left")
        none = F.array().cast("array<string>")
        reasons = F.concat(reasons, F.coalesce("_cr", none))
        warnings = F.concat(warnings, F.coalesce("_cw", none))
    return facts.select(
        "plan", "parcel_id", F.col("assigned").alias("assigned_use"), _headline(context is not None).alias("headline"),
        F.array_distinct(reasons).alias("reasons"), F.array_distinct(warnings).alias("warnings"),
        rk.tier(F.col("risk_norm")).alias("risk_level"), "best_use", "score", "best_score", "gap", "rank",
        F.col("risk_norm").alias("environmental_risk"), "allowed", "target_share")
