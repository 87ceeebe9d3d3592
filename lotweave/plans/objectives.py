"""Plan objectives, all minimised, and planning metrics.

Gene rows carry the plan keys, ``pos``, ``use_code`` and the parcel columns ``area_m2``,
``risk``, ``suit`` and ``allowed``. All per-parcel objectives share one grouped pass.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotweave.functions import vocab
from lotweave.functions.coerce import Fields, number
from lotweave.functions.geometry import geodesic_area
from lotweave.functions.landuse import use_label
from lotweave.plans import genes

GREEN_TARGET = 0.30


@dataclass(frozen=True)
class Context:
    """What objectives may need besides the gene rows."""

    keys: tuple[str, ...] = ("plan",)
    labels: tuple[str, ...] = vocab.LAND_USES
    edges: DataFrame | None = None
    pairs: DataFrame | None = None
    risks: DataFrame | None = None
    extra: Mapping[str, object] = field(default_factory=dict)


@dataclass(frozen=True)
class Objective:
    """A named objective: either an aggregate over gene rows or a function of the rows and context.

    ``table`` returns the plan keys and a ``value`` column. ``arrays``, if there, gives the same
    objective over gene arrays for the use labels; searches take it where they can.
    """

    name: str
    aggregate: Callable[[Context], Column] | None = None
    table: Callable[[DataFrame, Context], DataFrame] | None = None
    arrays: Callable[[Sequence[str]], genes.ArrayForm] | None = None


def _area() -> Column:
    return F.greatest(F.col("area_m2"), F.lit(0.0))


def _in(codes: Sequence[int]) -> Column:
    return F.col("use_code").isin(*codes) if codes else F.lit(False)


def _ratio(part: Column, whole: Column, empty: Column | float) -> Column:
    return F.when(whole > 0, part / whole).otherwise(empty)


def zoning_violations(ctx: Context) -> Column:
    broken = (F.size("allowed") > 0) & ~F.array_contains("allowed", F.col("use_code"))
    return F.sum(F.coalesce(broken, F.lit(False)).cast("double"))


def green_deviation(target: float = GREEN_TARGET) -> Callable[[Context], Column]:
    def build(ctx: Context) -> Column:
        if "green" not in ctx.labels:
            return F.max(F.lit(0.0))
        share = F.sum(F.when(F.col("use_code") == ctx.labels.index("green"), _area()).otherwise(0.0))
        total = F.sum(_area())
        return F.when(total > 0, F.abs(share / total - target)).otherwise(abs(target))
    return build


def risk_exposure(ctx: Context) -> Column:
    built = [i for i, u in enumerate(ctx.labels) if u in vocab.BUILT_USES] or [i for i, u in enumerate(ctx.labels) if u != "green"]
    exposed = F.sum(F.when(_in(built), F.col("risk") * _area()).otherwise(0.0))
    return _ratio(exposed, F.sum(_area()), F.lit(0.0))


def suitability_loss(ctx: Context) -> Column:
    known = F.col("use_code").between(0, len(ctx.labels) - 1)
    own = F.col("suit")[use_label(F.col("use_code"), ctx.labels)]
    loss = F.lit(1.0) - F.least(F.greatest(F.coalesce(own, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    weighted = F.sum(F.when(known, loss * _area()).otherwise(0.0))
    return _ratio(weighted, F.sum(_area()), F.coalesce(F.avg(F.when(known, loss)), F.lit(0.0)))


def mix_weights(target: Mapping[str, float]) -> dict[str, float]:
    """Weights by use that are not negative; at least one must be above zero."""
    weights = {str(k).strip().lower(): float(v) for k, v in target.items() if float(v) >= 0}
    if sum(weights.values()) <= 0:
        raise ValueError("target_mix must contain at least one positive value")
    return weights


def balance(target: Mapping[str, float]) -> Callable[[Context], Column]:
    weights = mix_weights(target)
    total = sum(weights.values())

    def build(ctx: Context) -> Column:
        gap = F.lit(0.0)
        for i, u in enumerate(ctx.labels):
            share = F.sum((F.col("use_code") == i).cast("double")) / F.count("*")
            gap = gap + F.abs(share - weights.get(u, 0.0) / total)
        return gap
    return build


def fragmentation(rows: DataFrame, ctx: Context) -> DataFrame:
    """Share of adjacency edges (a, b) whose ends differ; 0 without edges."""
    keys = list(ctx.keys)
    plans = rows.select(*keys).distinct()
    if ctx.edges is None:
        return plans.withColumn("value", F.lit(0.0))
    # genes of a parcel travel as one map over plans, so each edge row is joined twice, not plans x 2 times
    packed = rows.groupBy("pos").agg(F.map_from_entries(F.collect_list(F.struct(F.struct(*keys), F.col("use_code")))).alias("m"))
    both = (ctx.edges.join(packed.select(F.col("pos").alias("a"), F.col("m").alias("ma")), "a")
            .join(packed.select(F.col("pos").alias("b"), F.col("m").alias("mb")), "b"))
    ends = both.select(F.explode("ma").alias("k", "ua"), "mb").withColumn("ub", F.col("mb")[F.col("k")]).filter(F.col("ub").isNotNull())
    share = ends.groupBy("k").agg(F.avg((F.col("ua") != F.col("ub")).cast("double")).alias("value"))
    found = share.select(*[F.col("k")[c].alias(c) for c in keys], "value")
    return plans.join(found, keys, "left").fillna(0.0, ["value"])


def compatibility(weight: float = 0.15) -> Callable[[DataFrame, Context], DataFrame]:
    def build(rows: DataFrame, ctx: Context) -> DataFrame:
        from lotweave.operators.compat import objective, plan_scores

        keys = list(ctx.keys)
        own = [c for c in ("scenario_id",) if c in keys and c in ctx.pairs.columns]
        named = rows.select(*own, F.to_json(F.struct(*keys)).alias("plan"), F.struct(*keys).alias("_k"), "parcel_id",
                            use_label(F.col("use_code"), ctx.labels).alias("use"))
        scored = objective(plan_scores(ctx.pairs, named.select(*own, "plan", "parcel_id", "use"), ctx.risks), weight).drop(*own)
        found = named.select("plan", "_k").distinct().join(scored, "plan")
        return found.select(*[F.col("_k")[c].alias(c) for c in keys], F.col("penalty").alias("value"))
    return build


def default_objectives(green_target: float = GREEN_TARGET, target_mix: Mapping[str, float] | None = None,
                       compatibility_weight: float | None = None) -> tuple[Objective, ...]:
    """Zoning, suitability, green area, risk, fragmentation; balance with a target; compatibility when weighted."""
    chosen = [
        Objective("zoning_violation_penalty", aggregate=zoning_violations, arrays=genes.zoning_form),
        Objective("mean_suitability_loss", aggregate=suitability_loss, arrays=genes.suitability_form),
        Objective("green_area_deviation", aggregate=green_deviation(green_target), arrays=partial(genes.green_form, green_target)),
        Objective("environmental_risk_exposure", aggregate=risk_exposure, arrays=genes.risk_form),
        Objective("fragmentation_penalty", table=fragmentation, arrays=genes.fragmentation_form),
    ]
    if target_mix:
        chosen.append(Objective("land_use_balance_penalty", aggregate=balance(target_mix), arrays=partial(genes.balance_form, mix_weights(target_mix))))
    if compatibility_weight is not None:
        chosen.append(Objective("spatial_compatibility_penalty", table=compatibility(compatibility_weight),
                                arrays=partial(genes.compatibility_form, compatibility_weight)))
    return tuple(chosen)


def evaluate(rows: DataFrame, objectives: Sequence[Objective], ctx: Context) -> DataFrame:
    """Plan keys with one column per objective."""
    keys = list(ctx.keys)
    if len({o.name for o in objectives}) != len(objectives) or not objectives:
        raise ValueError("objectives need distinct names and at least one entry")
    direct = [o.aggregate(ctx).alias(o.name) for o in objectives if o.aggregate]
    out = rows.groupBy(*keys).agg(*direct) if direct else rows.select(*keys).distinct()
    for o in objectives:
        if o.table:
            out = out.join(o.table(rows, ctx).withColumnRenamed("value", o.name), keys, "left").fillna(0.0, [o.name])
    return out.select(*keys, *[o.name for o in objectives])


# ---- planning metrics --------------------------------------------------------------------

def metric_facts(features: DataFrame) -> DataFrame:
    """(parcel_id, area, hazard): stored area when positive, else geodesic area, else 500 m2."""
    f = Fields(features)
    pid = F.coalesce(*[F.when(f.get(n) != "", F.trim(f.get(n))) for n in vocab.ID_ORDER_METRICS], F.trim(f.feature_id()))
    stored = F.coalesce(*[number(f.get(n)) for n in ("area_m2", "AREA_M2", "Shape_Area")])
    ground = geodesic_area(F.col("geom")) if "geom" in features.columns else F.lit(None).cast("double")
    area = F.coalesce(F.when(stored > 0, stored), F.when(ground > 0, ground), F.lit(vocab.DEFAULT_AREA_M2))
    hazard = F.greatest(*[F.coalesce(f.get(n).try_cast("int") != 0, F.lit(False)) for n in vocab.METRIC_HAZARD_FLAGS])
    rows = features.select(pid.alias("parcel_id"), area.alias("area"), hazard.alias("hazard"), "pos").filter(F.col("parcel_id") != "")
    return rows.groupBy("parcel_id").agg(F.max_by("area", "pos").alias("area"), F.max_by("hazard", "pos").alias("hazard"))


def planning_metrics(assignments: DataFrame, facts: DataFrame) -> DataFrame:
    """Per plan: housing, residents, green per resident, tax, hazard-exposed built parcels and areas.

    Assignments without a parcel row count with 500 m2 and no hazard. Plans of different scenarios
    (``scenario_id``, if there) are counted apart.
    """
    keys = [c for c in ("scenario_id", "plan") if c in assignments.columns]
    rows = assignments.join(facts, "parcel_id", "left")
    label = F.lower("use_label")
    area = F.coalesce("area", F.lit(vocab.DEFAULT_AREA_M2))
    sums = rows.groupBy(*keys).agg(
        *[F.sum(F.when(label == u, area).otherwise(0.0)).alias(f"a_{u}") for u in vocab.LAND_USES],
        F.sum(((label != "green") & F.coalesce("hazard", F.lit(False))).cast("bigint")).alias("hazard_built_parcels"),
        F.count("*").alias("total_parcels"))
    total = F.lit(0.0)
    tax = F.lit(0.0)
    for u in vocab.LAND_USES:
        total = total + F.col(f"a_{u}")
        tax = tax + F.col(f"a_{u}") * vocab.TAX_PER_M2[u]
    out = sums.withColumn("housing_units", (F.col("a_residential") / vocab.UNIT_SIZE_M2).cast("bigint"))
    out = out.withColumn("estimated_residents", (F.col("housing_units") * vocab.HOUSEHOLD_SIZE).cast("bigint"))
    green = F.when(F.col("estimated_residents") > 0, F.col("a_green") / F.col("estimated_residents")).otherwise(F.col("a_green"))
    return out.select(
        *keys, "housing_units", "estimated_residents", F.round(green, 1).alias("green_space_per_resident_m2"),
        F.lit(vocab.GREEN_TARGET_M2).alias("green_target_m2"), "hazard_built_parcels", "total_parcels",
        tax.cast("bigint").alias("annual_tax"), *[F.round(f"a_{u}").alias(f"area_{u}") for u in vocab.LAND_USES],
        F.round(total).alias("area_total"))


def current_state(facts: DataFrame) -> DataFrame:
    """The baseline row: nothing built, hazard parcels, parcel count, total area."""
    return facts.agg(
        F.lit(0).alias("housing_units"), F.lit(0).alias("estimated_residents"), F.lit(0.0).alias("green_space_per_resident_m2"),
        F.sum(F.col("hazard").cast("bigint")).alias("total_hazard_parcels"), F.count("*").alias("total_parcels"),
        F.round(F.sum("area")).alias("area_total"))


def objective_ranges(population: DataFrame, names: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    long = population.unpivot(list(keys), list(names), "objective", "value")
    return long.groupBy(*keys, "objective").agg(F.min("value").alias("low"), F.max("value").alias("high"))
