"""Risk normalisers, suitability rules, hazard attribution and bands.

The normalisers disagree on purpose about missing, negative and over-range input, so each
caller has its own function.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotweave.functions import vocab
from lotweave.functions.coerce import Fields, blank_to_null, clamp, number, when_in_order, with_numbers
from lotweave.functions.geometry import let


SUITABILITY_FIELDS = tuple(
    name for u in vocab.LAND_USES
    for name in (u, f"suitability_{u}", f"{u}_suitability", f"score_{u}", f"{u}_score"))


def staged(df: DataFrame) -> DataFrame:
    """Parse every risk and suitability field once."""
    return with_numbers(df, [*vocab.RISK_KEYS_PROXIMITY, *vocab.RISK_KEYS_COMPATIBILITY, *SUITABILITY_FIELDS])


def planner_risk(fields: Fields) -> Column:
    """First key present decides; the first two hold 0-1 values, the last two percentages."""
    scaled = (("risk_score_norm", 1.0), ("environmental_risk", 1.0),
              ("xgb_risk_score", 100.0), ("rule_risk_score", 100.0))
    cases = [
        (fields.has(key), clamp(F.coalesce(fields.num(key), F.lit(0.0)) / F.lit(divisor)))
        for key, divisor in scaled
    ]
    return when_in_order(cases, F.lit(0.0))


def proximity_risk(fields: Fields, keys: Sequence[str] = vocab.RISK_KEYS_PROXIMITY) -> Column:
    """First usable key; over 100 counts as 1 and negatives as 0; null when none is usable."""
    options = []
    for key in keys:
        value = fields.num(key)
        scaled = F.when((value > 1) & (value <= 100), value / 100).otherwise(value)
        options.append(F.when(value.isNotNull(), clamp(scaled)))
    return F.coalesce(*options)


def percent_or_fraction(parsed_or_null: Column) -> Column:
    """1 < v <= 100 is a percentage; everything is clamped to 0-1; unreadable counts as 0."""
    parsed = F.coalesce(parsed_or_null, F.lit(0.0))
    return clamp(F.when((parsed > 1) & (parsed <= 100), parsed / 100).otherwise(parsed))


def compatibility_risk(fields: Fields, keys: Sequence[str] = vocab.RISK_KEYS_COMPATIBILITY) -> Column:
    """First key present decides, even when its value is unreadable."""
    return when_in_order(
        [(fields.has(k), percent_or_fraction(fields.num(k))) for k in keys], F.lit(0.0))


def strict_fraction(parsed: Column) -> Column:
    """0-1 as is, up to 100 as a percentage, anything else null."""
    return F.when((parsed >= 0) & (parsed <= 1), parsed).when(
        (parsed > 1) & (parsed <= 100), parsed / 100)


def strict_risk(fields: Fields, keys: Sequence[str]) -> Column:
    """First key whose value passes :func:`strict_fraction` (explanation, comparison, area)."""
    return F.coalesce(*[strict_fraction(fields.num(k)) for k in keys])


def suitability_from_risk(risk: Column) -> dict[str, Column]:
    return {
        "residential": F.greatest(F.lit(0.0), F.lit(0.8) - risk),
        "commercial": F.greatest(F.lit(0.0), F.lit(0.7) - risk * 0.8),
        "industrial": F.greatest(F.lit(0.0), F.lit(0.6) - risk * 0.5),
        "green": F.least(F.lit(1.0), F.lit(0.2) + risk),
    }


def planner_suitability(fields: Fields, labels: Sequence[str] = vocab.LAND_USES, known: Column | None = None) -> dict[str, Column]:
    """``suitability_x`` else ``x`` per label; risk-derived scores when no label is given at all.

    Pass ``known`` (a column already holding :func:`planner_risk`) to keep the generated code small.
    """
    raw = {u: F.coalesce(fields.get(f"suitability_{u}"), fields.get(u)) for u in labels}
    own = {u: F.when(fields.get(f"suitability_{u}").isNotNull(), fields.num(f"suitability_{u}")).otherwise(fields.num(u)) for u in labels}
    explicit = F.coalesce(*raw.values()).isNotNull()
    signal = reduce(
        lambda a, b: a | b,
        [F.coalesce(fields.get(k) != "", F.lit(False)) for k in vocab.RISK_KEYS_AREA])
    derived = suitability_from_risk(planner_risk(fields) if known is None else known)
    return {
        u: F.when(explicit, clamp(F.coalesce(own[u], F.lit(0.0))))
        .when(signal, derived.get(u, F.lit(0.0)))
        .otherwise(F.lit(0.0))
        for u in labels
    }


def explanation_suitability(fields: Fields, known: Column | None = None) -> dict[str, Column]:
    """Five aliases per use, percentages accepted; risk-derived when none is usable.

    ``known``: a column already holding the explanation risk.
    """
    found = {
        u: F.coalesce(*[strict_fraction(fields.num(n)) for n in (
            u, f"suitability_{u}", f"{u}_suitability", f"score_{u}", f"{u}_score")])
        for u in vocab.LAND_USES
    }
    any_found = F.coalesce(*found.values()).isNotNull()
    risk = strict_risk(fields, vocab.RISK_KEYS_EXPLANATION) if known is None else known
    derived = suitability_from_risk(risk)
    return {
        u: F.when(any_found, F.coalesce(found[u], F.lit(0.0)))
        .when(risk.isNotNull(), derived[u]).otherwise(F.lit(0.0))
        for u in vocab.LAND_USES
    }


def area_suitability(fields: Fields, use: str) -> Column:
    return F.coalesce(*[strict_fraction(fields.num(n)) for n in (f"suitability_{use}", use)])


def report_suitability(fields: Fields, use: str) -> Column:
    """Three aliases; the first non-negative number decides and may exceed 1 after scaling."""
    options = []
    for name in (f"suitability_{use}", f"{use}_suitability", use):
        value = fields.num(name)
        options.append(F.when(value >= 0, F.when(value <= 1, value).otherwise(value / 100)))
    return F.coalesce(*options)


def feature_based_risk(fields: Fields) -> Column:
    """Weighted air, surface and soil risk; null when all four inputs are missing."""
    def either(*names: str) -> Column:
        return F.coalesce(*[fields.num(n) for n in names])

    aqi = either("aqi_mean", "AirQualityIndex")
    surface = either("impervious_mean", "ImperviousSurface")
    clay = either("soil_clay_pct", "ClayContent")
    sand = either("soil_sand_pct", "SandContent")
    air = F.coalesce(aqi, F.lit(75.0))
    hard = F.coalesce(surface, F.lit(0.5))
    score = (
        clamp((air - 20.0) / 130.0) * 0.45
        + clamp(F.when(hard > 1, hard / 100).otherwise(hard)) * 0.30
        + clamp(F.coalesce(clay, F.lit(20.0)) / 100.0) * 0.15
        + (F.lit(1.0) - clamp(F.coalesce(sand, F.lit(40.0)) / 100.0)) * 0.10
    )
    return F.when(F.coalesce(aqi, surface, clay, sand).isNotNull(), clamp(score))


def flag(fields: Fields, name: str) -> Column:
    """1 when the flag reads as the whole number 1, else 0."""
    return F.coalesce((fields.get(name).try_cast("int") == 1).cast("int"), F.lit(0))


def rule_risk_score(flags: Mapping[str, Column]) -> Column:
    """100 x weighted sum of the flags given; flags not given count as 0."""
    total = reduce(lambda a, b: a + b, [
        F.coalesce(flags[n].cast("double"), F.lit(0.0)) * w
        for n, w in vocab.RISK_WEIGHTS.items() if n in flags] or [F.lit(0.0)])
    return clamp(total * 100, 0.0, 100.0)


def attribution(flags: Mapping[str, Column]) -> Column:
    """Array of (factor, label, weight, active, contribution_pct), largest first, table order kept."""
    rows = F.array(*[
        F.struct(F.lit(name).alias("factor"), F.lit(vocab.RISK_LABELS[name]).alias("label"), F.lit(weight).alias("weight"),
                 (flags[name] == 1).alias("active"),
                 F.round(F.when(flags[name] == 1, F.lit(weight)).otherwise(0.0) * 100, 1).alias("contribution_pct"))
        for name, weight in vocab.RISK_WEIGHTS.items()])
    # the table lists weights from large to small, so active rows first is the sorted order
    return let(rows, lambda all_rows: F.concat(F.filter(all_rows, lambda r: r["active"]), F.filter(all_rows, lambda r: ~r["active"])))


def attribution_total(flags: Mapping[str, Column]) -> Column:
    total = reduce(lambda a, b: a + b, [
        F.when(flags[n] == 1, F.lit(w)).otherwise(0.0) for n, w in vocab.RISK_WEIGHTS.items()])
    return F.round(total * 100, 2)


def active_labels(flags: Mapping[str, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(flags[n] == 1, F.lit(vocab.RISK_LABELS[n])) for n in vocab.RISK_WEIGHTS]))


def tier(value: Column, high: float = 0.70, middle: float = 0.40, names=("high", "moderate", "low"),
         missing: str = "unknown") -> Column:
    return (F.when(value.isNull(), F.lit(missing)).when(value >= high, F.lit(names[0]))
            .when(value >= middle, F.lit(names[1])).otherwise(F.lit(names[2])))


def summary_level(value: Column) -> Column:
    """Strictly above .6 is HIGH, strictly above .3 is MEDIUM."""
    return F.when(value > 0.6, "HIGH").when(value > 0.3, "MEDIUM").otherwise("LOW")


def color_bin(value: Column, thresholds: Sequence[float] = (0.10, 0.20, 0.30, 0.40)) -> Column:
    """0 for the safest bin; upper bounds are inclusive."""
    score = clamp(value)
    return when_in_order(
        [(score <= t, F.lit(i)) for i, t in enumerate(thresholds)], F.lit(len(thresholds)))


def score_or_null(value: Column) -> Column:
    return number(blank_to_null(value))
