"""Plan report rows, conflicts and summary texts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotweave.functions import vocab
from lotweave.functions.coerce import Fields, fixed, kept, numeric_truthy, pct0
from lotweave.functions.landuse import fold, readable_use, report_allowed_uses
from lotweave.functions.risk import report_suitability, staged, strict_risk
from lotweave.operators.compare import target_percent
from lotweave.session import cut_lineage

REPORT_BUILT = (*vocab.BUILT_USES, "mixed_use")


def report_facts(features: DataFrame, key: str = "parcel_id") -> DataFrame:
    """Per parcel: risk, distinct active hazard labels, zoning verdict, allowed uses, suitability per use.

    Written once: filters on the facts would otherwise work out every rule again.
    """
    features = staged(features)
    f = Fields(features)
    labels = F.array_distinct(kept(*[
        F.when(numeric_truthy(f.get(name), vocab.TRUE_WORDS_REPORT), F.lit(label))
        for name, label in vocab.REPORT_HAZARD_LABELS]))
    explicit = F.coalesce(f.get("zoningCompatible"), f.get("zoning_compatible"))
    verdict = F.when(explicit.isNotNull(), numeric_truthy(explicit, vocab.TRUE_WORDS_REPORT))
    return cut_lineage(features.select(
        key, strict_risk(f, vocab.RISK_KEYS_COMPARISON).alias("risk"), labels.alias("hazards"), verdict.alias("verdict"),
        report_allowed_uses(f).alias("allowed"), *[report_suitability(f, u).alias(f"suit_{u}") for u in vocab.LAND_USES]))


def _built() -> Column:
    return fold(F.col("use")).isin(*REPORT_BUILT)


def _hazardous() -> Column:
    return F.coalesce(F.size("hazards") > 0, F.lit(False))


def high_risk_built_flag() -> Column:
    return _built() & (F.coalesce(F.col("risk") >= 0.7, F.lit(False)) | _hazardous())


def zoning_conflict() -> Column:
    return F.when(F.col("verdict").isNotNull(), ~F.col("verdict")).otherwise(
        ~F.array_contains("allowed", fold(F.col("use"))))


def high_risk_built_rows(rows: DataFrame) -> DataFrame:
    risk = F.col("risk")
    label = (F.when(risk.isNull(), "N/A").when(risk >= 0.7, F.concat(pct0(risk), F.lit("% high risk")))
             .when(risk >= 0.4, F.concat(pct0(risk), F.lit("% medium risk"))).otherwise(F.concat(pct0(risk), F.lit("% low risk"))))
    return rows.filter(high_risk_built_flag()).select(
        "plan", "parcel_id", readable_use(F.col("use")).alias("assigned_use"), label.alias("risk_label"),
        F.array_join("hazards", ", ").alias("hazard_flags"))


def review_counts(rows: DataFrame) -> DataFrame:
    """Per plan: high-risk built parcels and possible zoning conflicts (null when none could be checked)."""
    c = zoning_conflict()
    return rows.groupBy("plan").agg(
        F.sum(high_risk_built_flag().cast("bigint")).alias("high_risk_built"),
        F.when(F.count(c) > 0, F.sum(c.cast("bigint"))).alias("zoning_conflicts"))


def conflict_rows(rows: DataFrame) -> DataFrame:
    """Up to four issues per assignment. Order a plan's rows by (severity_rank, pos, kind)."""
    suit = F.coalesce(*[F.when(fold(F.col("use")) == u, F.col(f"suit_{u}")) for u in vocab.LAND_USES])
    row = lambda kind, rank, text: F.struct(
        F.lit(rank).alias("severity_rank"), F.lit(kind).alias("kind"), text.alias("issue"))
    issues = kept(
        F.when(_built() & (F.col("risk") >= 0.7), row(1, 0, F.concat(
            F.lit("High environmental risk assigned to built use ("), pct0(F.col("risk")), F.lit("%).")))),
        F.when(_built() & _hazardous(), row(2, 0, F.concat(
            F.lit("Active hazard or constraint flags: "), F.array_join(F.slice("hazards", 1, 3), ", "), F.lit(".")))),
        F.when(suit < 0.35, row(3, 1, F.concat(
            F.lit("Low suitability score for assigned use ("), pct0(suit), F.lit("%).")))),
        F.when(zoning_conflict(), row(4, 1, F.lit(
            "Possible mismatch with available zoning or general plan attributes."))))
    return rows.select("plan", "pos", "parcel_id", readable_use(F.col("use")).alias("assigned_use"), F.explode(issues).alias("i")).select(
        "plan", "pos", "parcel_id", "assigned_use", "i.*",
        F.when(F.col("i.severity_rank") == 0, "High").otherwise("Medium").alias("severity"))


def target_rows(mix: DataFrame, target: Mapping[str, float] | None) -> DataFrame:
    """Per plan and use: count, actual and target percent, difference."""
    percent = target_percent(target) or {}
    rows = F.array(*[F.struct(
        F.lit(u).alias("use"), F.lit(vocab.USE_TITLES[u].split("/")[0]).alias("label"), F.col(f"n_{u}").alias("n"),
        F.lit(percent.get(u)).cast("double").alias("target_percent"), F.col(f"pct_{u}").alias("actual_percent"))
        for u in vocab.LAND_USES])
    out = mix.select("plan", F.explode(rows).alias("r")).select("plan", "r.*")
    return out.withColumn("difference", F.col("actual_percent") - F.col("target_percent"))


def _badge_text() -> Column:
    return F.when(F.size("badges") > 0, F.array_join("badges", ", ")).otherwise("None")


def comparison_rows(bundle: DataFrame, names: Sequence[str]) -> DataFrame:
    """Every plan: label, badges, mix percents, review counts and the three named objectives."""
    from lotweave.operators.badges import objective_index

    picks = []
    for key, out in (("risk", "risk_objective"), ("zoning", "zoning_objective"), ("compact", "fragmentation_objective")):
        i = objective_index(names, vocab.OBJECTIVE_TOKENS[key])
        picks.append((F.col(names[i]) if i >= 0 else F.lit(None).cast("double")).alias(out))
    return bundle.select(
        F.concat(F.lit("Plan "), (F.col("plan") + 1).cast("string")).alias("plan_label"), _badge_text().alias("badges"),
        *[F.col(f"pct_{u}") for u in vocab.LAND_USES], "deviation", "high_risk_built", "zoning_conflicts", *picks)


def _main_strength() -> Column:
    has = lambda label: F.array_contains("badges", label)
    ranked = F.array_sort(F.array(*[F.struct((-F.col(f"pct_{u}")).alias("p"), F.lit(i).alias("i"),
                                             F.lit(vocab.USE_TITLES[u].split("/")[0].lower()).alias("u"))
                                    for i, u in enumerate(vocab.LAND_USES)]))
    top = F.get(ranked, F.lit(0))
    return (F.when(has("Safest Plan"), "its comparatively low environmental risk exposure among generated alternatives")
            .when(has("Closest to Target Mix"), "its close alignment with the requested land-use mix")
            .when(has("Greenest Plan"), "its stronger green and conservation allocation")
            .when(has("Most Development-Friendly"), "its stronger allocation toward built development uses")
            .otherwise(F.concat(F.lit("its emphasis on "), top["u"], F.lit(" ("), fixed(-top["p"], 1), F.lit("%)"))))


def _main_concern() -> Column:
    built, zoning, dev = F.col("high_risk_built"), F.col("zoning_conflicts"), F.col("deviation")
    s = lambda n: F.when(n == 1, F.lit("")).otherwise("s")
    return (F.when(built > 0, F.concat(built.cast("string"), F.lit(" high-risk built-use parcel"), s(built), F.lit(" need review")))
            .when(zoning > 0, F.concat(zoning.cast("string"), F.lit(" possible zoning conflict"), s(zoning), F.lit(" should be confirmed")))
            .when(dev > 20, F.lit("the actual mix differs materially from the requested target mix"))
            .otherwise(F.lit("no major parcel-level warning was computable from the available frontend data")))


def summary_texts(bundle: DataFrame) -> DataFrame:
    """Executive summary and explanation per plan, from mix, badges, deviation and review counts."""
    name = F.concat(F.lit("Plan "), (F.col("plan") + 1).cast("string"))
    dev = F.col("deviation")
    first = F.get("badges", F.lit(0))
    about = F.coalesce(*[F.when(first == label, F.lit(text.lower())) for _, label, text in vocab.BADGES])
    head = F.when(first.isNotNull(), F.concat(name, F.lit(" is flagged as "), first, F.lit(" because "), about)).otherwise(
        F.concat(name, F.lit(" is a generated planning alternative for the selected parcels.")))
    mix = F.concat_ws(", ", *[F.concat(fixed(F.col(f"pct_{u}"), 0), F.lit(f"% {vocab.USE_TITLES[u].split('/')[0].lower()}"))
                              for u in vocab.LAND_USES])
    gap = (F.when(dev.isNull(), "Target mix alignment could not be computed because target settings were unavailable.")
           .when(dev <= 10, F.concat(F.lit("The plan is close to the target mix with "), fixed(dev, 1),
                                     F.lit(" percentage points of total deviation.")))
           .otherwise(F.concat(F.lit("The plan differs from the target mix by "), fixed(dev, 1), F.lit(" percentage points."))))
    green = F.col("pct_green")
    return bundle.select(
        "plan",
        F.concat(head, F.lit(" It assigns "), mix, F.lit(". "), gap, F.lit(" Main strength: "), _main_strength(),
                 F.lit(". Main warning: "), _main_concern(), F.lit(".")).alias("executive_summary"),
        F.concat(name, F.lit(" performs well because it offers "), _main_strength(), F.lit(". It allocates "),
                 fixed(F.lit(100.0) - green, 1), F.lit("% of parcels to built uses and "), fixed(green, 1),
                 F.lit("% to green/open space. The main planning concern is that "), _main_concern(),
                 F.lit(". Use this recommendation as a decision-support starting point, not a final regulatory "
                       "decision.")).alias("explanation"))


def objective_total(values: Column) -> Column:
    """Sum of the finite entries of an objective array."""
    finite = F.filter(values, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.aggregate(finite, F.lit(0.0), lambda a, v: a + v)


def compliance_score(compliance: Column) -> Column:
    """Mean rounded half up; 0 for no zones."""
    return F.floor(F.coalesce(F.avg(compliance), F.lit(0.0)) + 0.5)
