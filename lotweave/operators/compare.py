"""Plan comparison: assignment rows, mixes, risk and zoning metrics, plan-to-plan changes."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotweave.functions import vocab
from lotweave.functions.coerce import Fields, blank_to_null, first_present, kept, thousands, tri_state
from lotweave.functions.landuse import (
    change_class, comparison_allowed_uses, comparison_use, map_use, map_use_code)
from lotweave.functions.risk import staged, strict_risk, tier
from lotweave.session import cut_lineage


def plan_assignments(plans: DataFrame, container: str = "assignments") -> DataFrame:
    """(plan, pos, parcel_id, use) from an array of maps or a map of id to use; incomplete rows dropped."""
    if plans.schema[container].dataType.typeName() == "array":
        rows = plans.select("plan", F.posexplode(container).alias("pos", "props"))
        f = Fields(rows)
        rows = rows.select("plan", "pos", first_present(f, vocab.ASSIGNMENT_ID_KEYS).alias("parcel_id"),
                           comparison_use(first_present(f, vocab.ASSIGNMENT_USE_KEYS)).alias("use"))
    else:
        rows = plans.select("plan", F.posexplode(container).alias("pos", "k", "v")).select(
            "plan", "pos", blank_to_null(F.col("k")).alias("parcel_id"), comparison_use(F.col("v")).alias("use"))
    return rows.filter(F.col("parcel_id").isNotNull() & (F.col("use") != ""))


def assignment_map(plans: DataFrame, container: str = "assignments") -> DataFrame:
    """Map variant: only the four uses, use codes accepted, the last row of an id wins."""
    rows = plans.select("plan", F.posexplode(container).alias("pos", "props"))
    f = Fields(rows)
    use = F.coalesce(map_use(first_present(f, vocab.ASSIGNMENT_USE_KEYS)), map_use_code(f.get("use_code")))
    named = rows.select("plan", "pos", first_present(f, vocab.ASSIGNMENT_ID_KEYS).alias("parcel_id"), use.alias("use"))
    named = named.filter(F.col("parcel_id").isNotNull() & F.col("use").isNotNull())
    return named.groupBy("plan", "parcel_id").agg(F.max_by("use", "pos").alias("use"))


def parcel_facts(features: DataFrame, key: str = "parcel_id") -> DataFrame:
    """Per parcel: comparison risk, explicit zoning verdict, allowed uses, neighbour ids.

    Written once: filters on the facts would otherwise work out every rule again.
    """
    features = staged(features)
    f = Fields(features)
    verdict = F.coalesce(*[tri_state(f.get(n), vocab.TRUE_WORDS_COMPARISON, vocab.FALSE_WORDS_COMPARISON)
                           for n in ("zoningCompatible", "zoning_compatible")])
    lists = []
    for name in vocab.NEIGHBOUR_KEYS:
        items = F.filter(F.transform(F.split(F.regexp_replace(f.get(name), r'[\[\]"{}]', ""), r"[,;|]"),
                                     lambda t: F.trim(F.regexp_replace(t, ":.*$", ""))), lambda t: t != "")
        lists.append(F.when(F.size(items) > 0, items))
    return cut_lineage(features.select(
        key, strict_risk(f, vocab.RISK_KEYS_COMPARISON).alias("risk"), verdict.alias("verdict"),
        comparison_allowed_uses(f).alias("allowed"), F.coalesce(*lists).alias("neighbours")))


def with_facts(assignments: DataFrame, facts: DataFrame) -> DataFrame:
    """Left join: an assignment without a parcel row keeps nulls. There are as many facts as parcels, so none is broadcast."""
    return assignments.join(facts.hint("merge"), "parcel_id", "left")


def land_use_mix(assignments: DataFrame, keys=("plan",)) -> DataFrame:
    """Count and percent of each use; unknown uses stay in the denominator."""
    total = F.count("*")
    out = []
    for u in vocab.LAND_USES:
        n = F.sum((F.col("use") == u).cast("bigint"))
        out += [n.alias(f"n_{u}"), (n * 100.0 / total).alias(f"pct_{u}")]
    return assignments.groupBy(*keys).agg(total.alias("total"), *out)


def average_risk(rows: DataFrame) -> DataFrame:
    return rows.groupBy("plan").agg(F.avg("risk").alias("average_risk"), F.count("risk").alias("observed"))


def _built() -> Column:
    return F.col("use").isin(*vocab.BUILT_USES)


def _null_if_none(checked: Column, count: Column) -> Column:
    return F.when(checked > 0, count)


def high_risk_built(rows: DataFrame) -> DataFrame:
    known = F.count(F.when(_built(), F.col("risk")))
    high = F.sum(F.when(_built() & (F.col("risk") >= 0.7), 1).otherwise(0))
    return rows.groupBy("plan").agg(_null_if_none(known, high).alias("high_risk_built"))


def zoning_conflict() -> Column:
    """True, false or null (not checkable) per assignment row."""
    allowed = F.array_contains("allowed", F.col("use"))
    return F.when(F.col("verdict").isNotNull(), ~F.col("verdict")).otherwise(~allowed)


def zoning_conflicts(rows: DataFrame) -> DataFrame:
    c = zoning_conflict()
    return rows.groupBy("plan").agg(_null_if_none(F.count(c), F.sum(c.cast("bigint"))).alias("zoning_conflicts"))


def target_percent(mix: Mapping[str, float] | None) -> dict[str, float] | None:
    """Target mix as percent of the four uses; None when nothing positive is given."""
    values = {u: float(mix[u]) for u in vocab.LAND_USES if mix and mix.get(u) is not None and float(mix[u]) >= 0}
    total = sum(values.values())
    return {u: v / total * 100 for u, v in values.items()} if total > 0 else None


def mix_deviation(mix: DataFrame, target: Mapping[str, float] | None) -> DataFrame:
    """Sum of absolute percent differences over the four uses; null without a target."""
    percent = target_percent(target)
    if percent is None:
        return mix.select("plan", F.lit(None).cast("double").alias("deviation"))
    total = F.lit(0.0)
    for u in vocab.LAND_USES:
        total = total + F.abs(F.col(f"pct_{u}") - percent.get(u, 0.0))
    return mix.select("plan", total.alias("deviation"))


def property_edges(assignments: DataFrame, facts: DataFrame) -> DataFrame:
    """(plan, a, b, use_a, use_b): neighbour ids listed in properties, each pair once, both ends assigned."""
    listed = facts.filter(F.size("neighbours") > 0).select("parcel_id", F.explode(F.array_distinct("neighbours")).alias("other_id"))
    pairs = listed.select(F.least("parcel_id", "other_id").alias("a"), F.greatest("parcel_id", "other_id").alias("b")).distinct()
    one = assignments.groupBy("plan", "parcel_id").agg(F.max_by("use", "pos").alias("use"))
    left = one.select("plan", F.col("parcel_id").alias("a"), F.col("use").alias("use_a"))
    right = one.select("plan", F.col("parcel_id").alias("b"), F.col("use").alias("use_b"))
    return pairs.hint("merge").join(left.hint("merge"), "a").join(right.hint("merge"), ["plan", "b"]).select("plan", "a", "b", "use_a", "use_b")


def fragmentation(edges: DataFrame) -> DataFrame:
    differ = F.sum((F.col("use_a") != F.col("use_b")).cast("bigint"))
    return edges.groupBy("plan").agg(
        (differ / F.count("*")).alias("fragmentation"), differ.alias("boundary_count"), F.count("*").alias("edge_count"))


def metric_bundle(assignments: DataFrame, facts: DataFrame, target: Mapping[str, float] | None) -> DataFrame:
    """All comparison metrics of every plan in one row each.

    Mix, risk and zoning metrics share one aggregate over the joined rows.
    """
    rows = with_facts(assignments, facts)
    total, conflict = F.count("*"), zoning_conflict()
    known_built = F.count(F.when(_built(), F.col("risk")))
    n = {u: F.sum((F.col("use") == u).cast("bigint")) for u in vocab.LAND_USES}
    base = rows.groupBy("plan").agg(
        total.alias("total"),
        *[(n[u] * 100.0 / total).alias(f"pct_{u}") for u in vocab.LAND_USES],
        F.avg("risk").alias("average_risk"), F.count("risk").alias("observed"),
        _null_if_none(known_built, F.sum(F.when(_built() & (F.col("risk") >= 0.7), 1).otherwise(0))).alias("high_risk_built"),
        _null_if_none(F.count(conflict), F.sum(conflict.cast("bigint"))).alias("zoning_conflicts"))
    dev = mix_deviation(base, target)
    return base.join(dev, "plan").join(fragmentation(property_edges(assignments, facts)), "plan", "left")


# ---- plan to plan ------------------------------------------------------------------------

def compare_plans(lookup: DataFrame, baseline, comparison) -> DataFrame:
    """Full outer join of two plans' uses with the change class."""
    a = lookup.filter(F.col("plan") == baseline).select("parcel_id", F.col("use").alias("baseline_use"))
    b = lookup.filter(F.col("plan") == comparison).select("parcel_id", F.col("use").alias("comparison_use"))
    joined = a.join(b, "parcel_id", "full_outer")
    return joined.withColumn("status", change_class(F.col("baseline_use"), F.col("comparison_use")))


def change_summary(changes: DataFrame, risks: DataFrame) -> DataFrame:
    """One row of counts; missing rows count as changed; risk counts are null without risk data."""
    rows = changes.join(risks.select("parcel_id", "risk"), "parcel_id", "left")
    n = lambda c: F.coalesce(F.sum(c.cast("bigint")), F.lit(0))
    s, risk = F.col("status"), F.col("risk")
    has_risk = F.count("risk") > 0
    high = F.coalesce(risk >= 0.7, F.lit(False))
    return rows.agg(
        F.count("*").alias("total_parcels"), n(s != "unchanged").alias("changed_parcels"), n(s == "unchanged").alias("unchanged"),
        *[n(s == k).alias(k) for k in ("built_to_green", "green_to_built", "built_to_built", "other_change", "missing")],
        has_risk.alias("risk_data_available"),
        F.when(has_risk, n(high & (s == "built_to_green"))).alias("high_risk_improved"),
        F.when(has_risk, n(high & (s == "green_to_built"))).alias("high_risk_worsened"))


def _title(use: Column) -> Column:
    return F.coalesce(*[F.when(use == u, F.lit(t)) for u, t in vocab.USE_TITLES.items()], F.lit("Missing"))


def transitions(changes: DataFrame) -> DataFrame:
    """Counts of differing from/to uses, both known."""
    moved = changes.filter(F.col("baseline_use") != F.col("comparison_use"))
    label = F.concat(_title(F.col("baseline_use")), F.lit(" -> "), _title(F.col("comparison_use")))
    return moved.groupBy("baseline_use", "comparison_use").agg(F.count("*").alias("n"), F.any_value(label).alias("label")).orderBy(
        F.desc("n"), "label")


def planning_impact(status: Column, level: Column) -> Column:
    return (F.when(status == "built_to_green", F.when(level == "high", "Likely improvement").otherwise("Conservation shift"))
            .when(status == "green_to_built", F.when(level == "high", "Potential concern")
                  .when(level == "low", "Growth opportunity / needs zoning review").otherwise("Needs review"))
            .when(status == "built_to_built", "Land-use priority shift")
            .when(status == "unchanged", "Neutral / no change").otherwise("Needs review"))


def risk_level(risk: Column) -> Column:
    return tier(risk, names=("high", "medium", "low"))


def review_text(status: Column, before: Column, after: Column, level: Column) -> Column:
    b, a = F.lower(_title(before)), F.lower(_title(after))
    to_green = F.concat(F.lit("This parcel changed from "), b, F.lit(" to green/open space. "))
    to_built = F.concat(F.lit("This parcel changed from green/open space to "), a)
    tail = lambda text: F.concat(to_built, F.lit(text))
    return (
        F.when((status == "built_to_green") & (level == "high"), F.concat(to_green, F.lit(
            "Because environmental risk is high, this is likely an improvement because it reduces development "
            "exposure on risky land.")))
        .when(status == "built_to_green", F.concat(to_green, F.lit(
            "This may support conservation or open-space goals, but review whether the parcel is also suitable "
            "for planned growth.")))
        .when((status == "green_to_built") & (level == "low"), tail(
            ". Because environmental risk is low, the change may be acceptable from an environmental perspective. "
            "Review zoning compatibility and whether the parcel was intentionally preserved as open space before "
            "approving it."))
        .when((status == "green_to_built") & (level == "medium"), tail(
            ". Environmental risk is moderate, so this change should be reviewed before approval. Check hazard "
            "flags, zoning compatibility, and whether the growth allocation is necessary."))
        .when((status == "green_to_built") & (level == "high"), tail(
            " on a high-risk parcel. This may increase exposure to environmental hazards and should be reviewed "
            "carefully before accepting the plan."))
        .when(status == "green_to_built", tail(
            ". Review environmental risk, zoning compatibility, and whether the parcel was intentionally preserved "
            "as open space before approving it."))
        .when(status == "built_to_built", F.concat(
            F.lit("This parcel changed from "), b, F.lit(" to "), a,
            F.lit(", meaning the plan shifts this parcel from one development priority to another. Review "
                  "suitability, zoning, and target mix before deciding which assignment is better.")))
        .when(status == "unchanged", F.lit("This parcel has the same assignment in both selected plans."))
        .when(status == "missing", F.lit(
            "This parcel is missing an assignment in one of the selected plans, so it should be reviewed before "
            "comparison."))
        .otherwise(F.lit("This parcel changed between the selected plans and may need planner review.")))


def with_impact(changes: DataFrame, risks: DataFrame) -> DataFrame:
    rows = changes.join(risks.select("parcel_id", "risk"), "parcel_id", "left").withColumn("level", risk_level(F.col("risk")))
    return rows.withColumn("impact", planning_impact(F.col("status"), F.col("level"))).withColumn(
        "review", review_text(F.col("status"), F.col("baseline_use"), F.col("comparison_use"), F.col("level")))


def change_filter(name: str) -> Column:
    """Predicate over :func:`with_impact` rows by filter name."""
    status = F.col("status")
    moved = ~status.isin("unchanged", "missing")
    known = {
        "all": F.lit(True), "changed": moved,
        "high_risk_changes": moved & (F.col("level") == "high"),
        "potential_concerns": F.col("impact").isin("Potential concern", "Needs review"),
    }
    if name in ("green_to_built", "built_to_green", "built_to_built"):
        return status == name
    return known[name]


def narrative(summary: DataFrame, top: DataFrame, baseline: str, comparison: str) -> DataFrame:
    """Sentences from the change summary and the largest transition (``top``: at most one row)."""
    largest = top.select(F.struct("label", "n").alias("t"))
    row = summary.join(F.broadcast(largest), F.lit(True), "left")
    c = F.col
    plural = lambda n: F.when(n == 1, F.lit("")).otherwise("s")
    sentences = kept(
        F.concat(F.lit(f"{comparison} changes "), thousands(c("changed_parcels")), F.lit(" out of "), thousands(c("total_parcels")),
                 F.lit(f" parcels compared with {baseline}.")),
        F.when(c("t").isNotNull(), F.concat(
            F.lit("The largest exact transition is "), F.lower(c("t.label")), F.lit(", affecting "), thousands(c("t.n")),
            F.lit(" parcel"), plural(c("t.n")), F.lit("."))),
        F.when(c("green_to_built") > c("built_to_green"), F.lit("The comparison plan shifts more land toward development."))
        .when(c("built_to_green") > c("green_to_built"), F.lit(
            "The comparison plan shifts more land toward conservation or open space."))
        .when(c("built_to_built") > 0, F.lit(
            "Most visible changes are between built-use priorities rather than between development and open space.")),
        F.when(c("risk_data_available") & (c("high_risk_worsened") > 0), F.concat(
            thousands(c("high_risk_worsened")), F.lit(" high-risk parcel"), plural(c("high_risk_worsened")),
            F.lit(" moved from green/open space toward a built use, so those changes deserve review.")))
        .when(c("risk_data_available") & (c("high_risk_improved") > 0), F.lit(
            "No high-risk parcels worsened, and the comparison plan reduces development exposure on some risky parcels."))
        .when(c("risk_data_available"), F.lit("No high-risk parcels worsened in the available risk data.")),
        F.lit("Zoning and policy review is still recommended before approval."))
    return row.select(F.array_join(sentences, " ").alias("narrative"))


def target_shares(mix: DataFrame, scenario: str = "scenario_id") -> DataFrame:
    """Backend target mix: labels trimmed and lower-cased, only positive weights, shares per scenario."""
    label = F.lower(F.trim("label"))
    rows = mix.select(scenario, label.alias("label"), "pos", F.col("weight").try_cast("double").alias("weight")).filter(
        (F.col("label") != "") & (F.col("weight") > 0))
    last = rows.groupBy(scenario, "label").agg(F.max_by("weight", "pos").alias("weight"))
    return last.withColumn("share", F.col("weight") / F.sum("weight").over(Window.partitionBy(scenario)))
