"""Area summaries, presence checks, selection lookups and run texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotweave.functions import risk as rk
from lotweave.functions import vocab
from lotweave.functions.coerce import Fields, first_present, number, numeric_truthy, parcel_id, pct0
from lotweave.operators.ranking import most_frequent


def _label(value: Column) -> Column:
    """Trimmed text; a JSON list of texts becomes a comma list."""
    items = F.from_json(value, "array<string>")
    joined = F.array_join(F.filter(F.transform(items, lambda i: F.trim(i)), lambda i: i != ""), ", ")
    text = F.when(F.trim(value).startswith("["), joined).otherwise(F.trim(value))
    return F.when(text != "", text)


def area_facts(features: DataFrame) -> DataFrame:
    features = rk.staged(features)
    f = Fields(features)
    positive = lambda name: F.when(number(f.get(name)) > 0, number(f.get(name)))
    return features.select(
        "pos", _label(F.coalesce(*[F.when(f.get(n) != "", f.get(n)) for n in vocab.ZONE_KEYS_AREA])).alias("zone"),
        _label(F.coalesce(*[F.when(f.get(n) != "", f.get(n)) for n in vocab.JURISDICTION_KEYS_AREA])).alias("jurisdiction"),
        positive("area_m2").alias("area"), positive("perimeter_m").alias("perimeter"),
        rk.strict_risk(f, vocab.RISK_KEYS_AREA).alias("risk"),
        *[rk.area_suitability(f, u).alias(f"suit_{u}") for u in vocab.LAND_USES],
        *[numeric_truthy(f.get(field), vocab.TRUE_WORDS_AREA).alias(f"c_{key}") for key, _, field, _ in vocab.CONSTRAINTS])


def area_summary(features: DataFrame) -> DataFrame:
    """One row over the selected features; zone and jurisdiction sets are sorted."""
    facts = area_facts(features)
    flags = [F.col(f"c_{key}").cast("int") for key, *_ in vocab.CONSTRAINTS]
    active = sum(flags[1:], flags[0])
    policy = F.greatest(*[F.col(f"c_{key}") for key, _, _, kind in vocab.CONSTRAINTS if kind == "policy"])
    n = lambda c: F.coalesce(F.sum(c.cast("bigint")), F.lit(0))
    stats = facts.agg(
        F.count("*").alias("n"), F.sum("area").alias("area_m2"), F.avg("area").alias("mean_area_m2"),
        F.avg("perimeter").alias("mean_perimeter_m"), F.avg("risk").alias("average_risk"),
        n(active > 0).alias("constrained"), n(policy).alias("protected"), n(active >= 2).alias("multi_constraint"),
        F.array_join(F.sort_array(F.collect_set("zone")), ";").alias("zones"),
        F.array_join(F.sort_array(F.collect_set("jurisdiction")), ";").alias("jurisdictions"),
        *[F.avg(f"suit_{u}").alias(f"suit_{u}") for u in vocab.LAND_USES],
        *[n(F.col(f"c_{key}")).alias(f"c_{key}") for key, *_ in vocab.CONSTRAINTS])
    mode = most_frequent(facts, [], "zone", "pos", "dominant_zone")
    ranked = F.array_sort(F.filter(F.array(*[
        F.struct((-F.col(f"c_{key}")).alias("n"), F.lit(label).alias("label")) for key, label, *_ in vocab.CONSTRAINTS]),
        lambda s: s["n"] < 0))
    top = F.get(ranked, F.lit(0))["label"]
    return stats.crossJoin(F.broadcast(mode)).withColumn("dominant_constraint", top)


def constraint_counts(features: DataFrame) -> DataFrame:
    """Constraints that occur: count, share of all features, protected mark; order by count desc, label."""
    facts = area_facts(features)
    stats = facts.agg(F.count("*").alias("n"), *[F.sum(F.col(f"c_{k}").cast("bigint")).alias(k) for k, *_ in vocab.CONSTRAINTS])
    rows = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(label).alias("label"), F.col(k).alias("count"),
                              F.lit(kind == "policy").alias("protected")) for k, label, _, kind in vocab.CONSTRAINTS])
    out = stats.select("n", F.explode(rows).alias("r")).select("r.*", (F.col("r.count") / F.greatest("n", F.lit(1))).alias("share"))
    return out.filter("count > 0").orderBy(F.desc("count"), "label")


def presence(features: DataFrame) -> DataFrame:
    facts = area_facts(features)
    some = lambda c: F.coalesce(F.bool_or(F.col(c).isNotNull()), F.lit(False))
    return facts.agg(some("risk").alias("has_environment"), some("zone").alias("has_zoning"))


def risk_only_scores(features: DataFrame) -> DataFrame:
    """Zeros for the four uses and the known risk (0 when unknown) for every row with an id."""
    f = Fields(features)
    return features.select(
        parcel_id(f, vocab.ID_ORDER_WORKSPACE).alias("parcel_id"), *[F.lit(0.0).alias(u) for u in vocab.LAND_USES],
        F.coalesce(rk.strict_risk(f, vocab.RISK_KEYS_AREA), F.lit(0.0)).alias("environmental_risk")).filter("parcel_id is not null")


def pick_selected(ids: DataFrame, selected: DataFrame, loaded: DataFrame) -> DataFrame:
    """For each selected id the selected feature, else the loaded one; ids with neither are left out."""
    s = selected.select("parcel_id", F.struct("*").alias("_s"))
    l = loaded.select("parcel_id", F.struct("*").alias("_l"))
    joined = ids.join(s, "parcel_id", "left").join(l, "parcel_id", "left")
    row = F.coalesce("_s", "_l")
    return joined.filter(row.isNotNull()).select("order", row.alias("_f")).select("order", "_f.*")


def first_plan(assignments: DataFrame, plan: str = "plan") -> DataFrame:
    """Assignments of plan 0 limited to the four uses."""
    use = F.lower("use_label")
    return assignments.filter((F.col(plan) == 0) & use.isin(*vocab.LAND_USES)).groupBy("parcel_id").agg(
        F.max_by(use, "pos").alias("use"))


def environment_lines(scores: DataFrame) -> DataFrame:
    """One text line per parcel: risk with level, then the four scores."""
    p = lambda c: F.concat(pct0(F.col(c)), F.lit("%"))
    return scores.select("query_id", "parcel_id", F.concat(
        F.lit("Parcel "), F.col("parcel_id"), F.lit(": risk="), p("environmental_risk"), F.lit(" ("),
        rk.summary_level(F.col("environmental_risk")), F.lit(") | residential="), p("residential"), F.lit(" commercial="),
        p("commercial"), F.lit(" industrial="), p("industrial"), F.lit(" green="), p("green")).alias("line"))


def run_summary(scores: DataFrame) -> DataFrame:
    """Per query: number of parcels, average risk, sorted lists of safe (<.3) and risky (>.6) parcels.

    A query names the parcels its user picked, so the lists stay short.
    """
    names = lambda c: F.array_join(F.sort_array(F.collect_list(F.when(c, F.col("parcel_id")))), ", ")
    r = F.col("environmental_risk")
    rows = scores.groupBy("query_id").agg(F.count("*").alias("n"), F.avg(r).alias("avg_risk"), names(r < 0.3).alias("safe"), names(r > 0.6).alias("risky"))
    return rows.withColumn("summary", F.concat(
        F.lit("**Environmental Analysis** — "), F.col("n").cast("string"), F.lit(" parcels assessed, average risk **"),
        pct0(F.col("avg_risk")), F.lit("%**."),
        F.when(F.col("safe") != "", F.concat(F.lit("\n- **Safe for residential** (risk <30%): "), F.col("safe"))).otherwise(""),
        F.when(F.col("risky") != "", F.concat(F.lit("\n- **High-risk** (risk >60%): "), F.col("risky"))).otherwise("")))


def mix_line(assignments: DataFrame, group: str = "query_id") -> DataFrame:
    """``3 green · 1 residential`` per query, labels in order."""
    counts = assignments.groupBy(group, "use_label").agg(F.count("*").alias("n"))
    return counts.groupBy(group).agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("use_label", "n"))),
        lambda s: F.concat_ws(" ", s["n"].cast("string"), s["use_label"])), " · ").alias("mix"))


def first_zone(fields: Fields) -> Column:
    return first_present(fields, vocab.ZONE_KEYS_AREA)
