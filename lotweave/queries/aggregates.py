"""Plan objectives, neighbourhood and plan metrics, comparison and report aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from lotweave.functions import vocab
from lotweave.operators import area, badges, compare, compat, nearby, report, zoning
from lotweave.operators.scoring import evaluate as evaluate_model
from lotweave.plans import objectives as ob
from lotweave.queries.joins import (
    ADJ, CHANGES, CONTEXT_PAIRS, LOCAL, NEAR, ONCE, PROP_EDGES, changes, edges, gene_uses, pairs, risks, used)
from lotweave.queries.registry import query
from lotweave.queries.rules import (
    COMPARE_RISK, PROX_RISK, STRICT_RISK, comparison_allowed_sql, comparison_use_sql, proximity_use_sql, report_allowed_sql)

TARGET = {"residential": 40, "commercial": 20, "industrial": 10, "green": 30}
ALLOWED = "CASE g.pos % 5 WHEN 0 THEN g.use_code IN (0, 3) WHEN 1 THEN g.use_code IN (1, 2) WHEN 3 THEN g.use_code = 3 ELSE TRUE END"
OWN_SUIT = "CASE g.use_code WHEN 0 THEN l.s_residential WHEN 1 THEN l.s_commercial WHEN 2 THEN l.s_industrial ELSE l.s_green END"
OBJECTIVES = f"""SELECT g.plan, cast(count(*) FILTER (WHERE NOT ({ALLOWED})) AS double) AS zoning_violation_penalty,
  round(sum((1 - {OWN_SUIT}) * l.area_m2) / sum(l.area_m2), 6) AS mean_suitability_loss,
  round(abs(sum(CASE WHEN g.use_code = 3 THEN l.area_m2 ELSE 0 END) / sum(l.area_m2) - 0.3e0), 6) AS green_area_deviation,
  round(sum(CASE WHEN g.use_code < 3 THEN l.risk * l.area_m2 ELSE 0 END) / sum(l.area_m2), 6) AS environmental_risk_exposure,
  round(max(f.v), 6) AS fragmentation_penalty,
  round(abs(avg(CASE WHEN g.use_code = 0 THEN 1e0 ELSE 0 END) - 0.4e0) + abs(avg(CASE WHEN g.use_code = 1 THEN 1e0 ELSE 0 END) - 0.2e0)
    + abs(avg(CASE WHEN g.use_code = 2 THEN 1e0 ELSE 0 END) - 0.1e0) + abs(avg(CASE WHEN g.use_code = 3 THEN 1e0 ELSE 0 END) - 0.3e0), 6) AS land_use_balance_penalty
FROM {{genes}} g JOIN {{lots}} l ON l.pos = g.pos
JOIN (SELECT x.plan, avg(CASE WHEN x.use_code <> y.use_code THEN 1e0 ELSE 0e0 END) AS v FROM ({ADJ}) e JOIN {{genes}} x ON x.pos = e.a JOIN {{genes}} y ON y.pos = e.b AND y.plan = x.plan GROUP BY x.plan) f ON f.plan = g.plan
GROUP BY g.plan"""


def gene_rows(d):
    return d.view("genes").select("plan", "pos", "use_code").join(d.parcels.select("pos", "parcel_id", "area_m2", "risk", "suit", "allowed"), "pos")


def objective_table(d):
    ctx = ob.Context(("plan",), vocab.LAND_USES, edges=edges(d))
    return ob.evaluate(gene_rows(d), ob.default_objectives(target_mix=TARGET), ctx)


@query("a01_a06_plan_objectives", OBJECTIVES)
def _(d):
    return objective_table(d)


def _single(name, column, objective):
    def run(d):
        ctx = ob.Context(("plan",), vocab.LAND_USES, edges=edges(d) if objective.table else None)
        return ob.evaluate(gene_rows(d), [objective], ctx)
    query(name, f"SELECT plan, {column} FROM ({OBJECTIVES}) o")(run)


for _name, _objective in zip(
        ("a01_zoning_violations", "a06_suitability_loss", "a02_green_area_deviation", "a03_risk_exposure", "a04_fragmentation", "a05_land_use_balance"),
        ob.default_objectives(target_mix=TARGET)):
    _single(_name, _objective.name, _objective)


SCORED = f"{LOCAL} - CASE WHEN (lu < 2 OR ru < 2) AND mr >= 0.8e0 THEN 0.25e0 WHEN (lu < 2 OR ru < 2) AND mr >= 0.6e0 THEN 0.15e0 ELSE 0 END"
SCORES = f"""SELECT plan, round(least(greatest((raw / n + 5) / 9, 0e0), 1e0), 4) AS score, round(raw, 4) AS raw_score, n AS neighbor_pairs_evaluated, ok AS compatible_pairs,
  bad AS conflict_pairs, buf AS green_buffer_pairs, clash AS industrial_residential_conflicts FROM (
  SELECT plan, count(*) AS n, sum(s) AS raw, count(*) FILTER (WHERE s > 0) AS ok, count(*) FILTER (WHERE s < 0) AS bad,
    count(*) FILTER (WHERE (lu = 3 OR ru = 3) AND mr >= 0.6e0) AS buf, count(*) FILTER (WHERE (lu = 2 OR ru = 2) AND (lu = 0 OR ru = 0)) AS clash
  FROM (SELECT *, {SCORED} AS s FROM ({CONTEXT_PAIRS}) c) z GROUP BY plan) y"""


def scores(d):
    return compat.plan_scores(pairs(d), gene_uses(d), risks(d))


@query("a07_compatibility_objective", f"SELECT plan, round(0.15e0 * (1 - score), 6) AS penalty FROM ({SCORES}) s")
def _(d):
    return compat.objective(scores(d), 0.15)


@query("a08_compatibility_score", SCORES)
def _(d):
    return scores(d)


@query("a09_compatibility_notes", f"""
SELECT plan, concat_ws(' ', CASE WHEN industrial_residential_conflicts > 0 THEN concat(cast(industrial_residential_conflicts AS string), ' industrial-residential proximity conflict',
  CASE WHEN industrial_residential_conflicts = 1 THEN ' was' ELSE 's were' END, ' detected.') WHEN conflict_pairs > 0 THEN concat(cast(conflict_pairs AS string),
  ' nearby land-use compatibility conflict', CASE WHEN conflict_pairs = 1 THEN ' was' ELSE 's were' END, ' detected.') END,
  CASE WHEN green_buffer_pairs > 0 THEN concat(cast(green_buffer_pairs AS string), ' green-buffer relationship', CASE WHEN green_buffer_pairs = 1 THEN '' ELSE 's' END, ' support environmental protection.') END) AS notes
FROM ({SCORES}) s""")
def _(d):
    return compat.notes(scores(d))


FACTS = f"""SELECT parcel_id, {PROX_RISK} AS risk, coalesce(gp, land_use) AS zoning, {proximity_use_sql('coalesce(land_use, gp)')} AS bucket,
  coalesce(has_flood <> 0, FALSE) AS flood, has_fault = 1 AS fault, in_mscp = 1 AS mscp FROM {{props}}"""
SUMMARY = f"""SELECT n.centre_id, coalesce(round(avg(f.risk), 3), 0e0) AS average_risk, count(*) FILTER (WHERE f.risk >= 0.6e0) AS high_risk_count,
  count(*) FILTER (WHERE bucket = 'residential') AS use_residential, count(*) FILTER (WHERE bucket = 'commercial') AS use_commercial,
  count(*) FILTER (WHERE bucket = 'industrial') AS use_industrial, count(*) FILTER (WHERE bucket = 'green') AS use_green, count(*) FILTER (WHERE bucket = 'unknown') AS use_unknown,
  count(*) FILTER (WHERE flood) AS hazard_flood, count(*) FILTER (WHERE fault) AS hazard_fault, count(*) FILTER (WHERE mscp) AS hazard_mscp, max(m.zoning) AS dominant_zoning
FROM ({NEAR}) n JOIN ({FACTS}) f ON f.parcel_id = n.parcel_id LEFT JOIN (SELECT centre_id, zoning FROM (
  SELECT n2.centre_id, f2.zoning, row_number() OVER (PARTITION BY n2.centre_id ORDER BY count(*) DESC, min(n2.rank)) AS k FROM ({NEAR}) n2 JOIN ({FACTS}) f2 ON f2.parcel_id = n2.parcel_id
  WHERE f2.zoning IS NOT NULL AND n2.rank <= 150 GROUP BY n2.centre_id, f2.zoning) q WHERE k = 1) m ON m.centre_id = n.centre_id WHERE n.rank <= 150 GROUP BY n.centre_id"""
INSIGHT = """CASE WHEN average_risk >= 0.6e0 OR high_risk_count >= greatest(3, ceil(total * 0.3e0)) THEN 'risk' WHEN use_industrial >= 2 AND use_residential >= 2 THEN 'mixed activity'
  WHEN use_commercial > 0 AND use_commercial >= greatest(use_residential, use_industrial, use_green) THEN 'commercial'
  WHEN use_residential > 0 AND use_residential >= greatest(use_commercial, use_industrial, use_green) AND average_risk <= 0.35e0 THEN 'residential'
  WHEN use_green > 0 AND use_green >= greatest(use_residential, use_commercial, use_industrial) THEN 'green' ELSE 'mixed' END"""


def _summaries(d):
    return nearby.summaries(nearby.nearest(d.parcels, d.parcels, 400.0, 150), nearby.planning_facts(d.by_lot))


@query("a10_neighbourhood_summary", SUMMARY)
def _(d):
    return _summaries(d).select("centre_id", "average_risk", "high_risk_count", *[f"use_{u}" for u in nearby.USES], "hazard_flood", "hazard_fault", "hazard_mscp", "dominant_zoning")


@query("p33_area_insight", f"""SELECT centre_id, {INSIGHT} AS kind FROM (SELECT *, use_residential + use_commercial + use_industrial + use_green + use_unknown AS total FROM ({SUMMARY}) s) t""")
def _(d):
    i = F.col("insight")
    kind = (F.when(i.startswith("Nearby parcels show"), "risk").when(i.startswith("The nearby area"), "mixed activity").when(i.contains("commercial cluster"), "commercial")
            .when(i.contains("mostly residential"), "residential").when(i.contains("surrounded by"), "green").otherwise("mixed"))
    return _summaries(d).select("centre_id", kind.alias("kind"))


AREA = "coalesce(CASE WHEN coalesce(area_prop, shape_area) > 0 THEN coalesce(area_prop, shape_area) END, 500e0)"
HAZ = "(coalesce(has_flood, 0) <> 0 OR has_fault <> 0 OR has_liquefaction <> 0 OR is_steep <> 0 OR is_fire_zone <> 0)"
MFACTS = f"SELECT apn AS parcel_id, {AREA} AS area, {HAZ} AS hazard FROM {{props}} WHERE apn IS NOT NULL"


def _facts(d):
    """Only rows keyed by their own APN, without geometry, so that the default area shows."""
    return ob.metric_facts(d.features.filter(F.map_contains_key("props", F.lit("APN"))).drop("geom"))


@query("a11_planning_metrics", f"""
SELECT plan, units AS housing_units, res AS estimated_residents, round(CASE WHEN res > 0 THEN ag / res ELSE ag END, 1) AS green_space_per_resident_m2, 9e0 AS green_target_m2,
  hz AS hazard_built_parcels, n AS total_parcels, cast(floor(ar * 12 + ac * 18 + ai * 9) AS bigint) AS annual_tax, round(ar) AS area_residential, round(ac) AS area_commercial,
  round(ai) AS area_industrial, round(ag) AS area_green, round(ar + ac + ai + ag) AS area_total
FROM (SELECT *, cast(floor(units * 2.5e0) AS bigint) AS res FROM (SELECT *, cast(floor(ar / 85) AS bigint) AS units FROM (
  SELECT a.plan, count(*) AS n, sum(CASE WHEN use_label = 'residential' THEN coalesce(f.area, 500e0) ELSE 0 END) AS ar, sum(CASE WHEN use_label = 'commercial' THEN coalesce(f.area, 500e0) ELSE 0 END) AS ac,
    sum(CASE WHEN use_label = 'industrial' THEN coalesce(f.area, 500e0) ELSE 0 END) AS ai, sum(CASE WHEN use_label = 'green' THEN coalesce(f.area, 500e0) ELSE 0 END) AS ag,
    count(*) FILTER (WHERE use_label <> 'green' AND coalesce(f.hazard, FALSE)) AS hz
  FROM {{assignments}} a LEFT JOIN ({MFACTS}) f ON f.parcel_id = a.parcel_id GROUP BY a.plan) x) y) z""")
def _(d):
    return ob.planning_metrics(d.view("assignments"), _facts(d))


@query("a12_current_state", f"""
SELECT 0 AS housing_units, 0 AS estimated_residents, 0e0 AS green_space_per_resident_m2, count(*) FILTER (WHERE hazard) AS total_hazard_parcels, count(*) AS total_parcels, round(sum(area)) AS area_total FROM ({MFACTS}) f""")
def _(d):
    return ob.current_state(_facts(d))


USED = f"SELECT plan, pos, parcel_id, {comparison_use_sql('use_label')} AS use FROM {{assignments}}"
MIX = "SELECT plan, count(*) AS total, " + ", ".join(
    f"count(*) FILTER (WHERE use = '{u}') AS n_{u}, round(count(*) FILTER (WHERE use = '{u}') * 100e0 / count(*), 6) AS pct_{u}" for u in vocab.LAND_USES) + f" FROM ({USED}) u GROUP BY plan"
VERDICT = "CASE lower(zcompat) WHEN 'yes' THEN TRUE WHEN 'no' THEN FALSE END"
ROWS = f"""SELECT u.plan, u.pos, u.parcel_id, u.use, p.risk, p.verdict, p.allowed, CASE WHEN p.verdict IS NOT NULL THEN NOT p.verdict ELSE NOT list_contains(string_split(p.allowed, ','), u.use) END AS conflict
FROM ({USED}) u LEFT JOIN (SELECT parcel_id, {COMPARE_RISK} AS risk, {VERDICT} AS verdict, {comparison_allowed_sql()} AS allowed FROM {{props}}) p ON p.parcel_id = u.parcel_id"""
BUILT = "use IN ('residential', 'commercial', 'industrial')"


def facts(d):
    return compare.parcel_facts(d.by_lot)


def rows(d):
    return compare.with_facts(used(d), facts(d))


@query("a13_land_use_mix", MIX)
def _(d):
    return compare.land_use_mix(used(d))


@query("a14_average_risk", f"SELECT plan, round(avg(risk), 6) AS average_risk, count(risk) AS observed FROM ({ROWS}) r GROUP BY plan")
def _(d):
    return compare.average_risk(rows(d))


HIGH = f"CASE WHEN count(risk) FILTER (WHERE {BUILT}) > 0 THEN count(*) FILTER (WHERE {BUILT} AND risk >= 0.7e0) END"


@query("a15_high_risk_built", f"SELECT plan, {HIGH} AS high_risk_built FROM ({ROWS}) r GROUP BY plan")
def _(d):
    return compare.high_risk_built(rows(d))


DEV = " + ".join(f"abs(n_{u} * 100e0 / total - {v}e0)" for u, v in TARGET.items())


@query("a16_target_mix_deviation", f"SELECT plan, round({DEV}, 6) AS deviation FROM ({MIX}) m")
def _(d):
    return compare.mix_deviation(compare.land_use_mix(used(d)), TARGET)


CONFLICTS = "CASE WHEN count(conflict) > 0 THEN count(*) FILTER (WHERE conflict) END"


@query("a17_zoning_conflicts", f"SELECT plan, {CONFLICTS} AS zoning_conflicts FROM ({ROWS}) r GROUP BY plan")
def _(d):
    return compare.zoning_conflicts(rows(d))


FRAG = f"SELECT plan, round(count(*) FILTER (WHERE use_a <> use_b) * 1e0 / count(*), 6) AS fragmentation, count(*) FILTER (WHERE use_a <> use_b) AS boundary_count, count(*) AS edge_count FROM ({PROP_EDGES}) e GROUP BY plan"


@query("a18_property_fragmentation", FRAG)
def _(d):
    return compare.fragmentation(compare.property_edges(used(d), facts(d)))


RISKS = "SELECT parcel_id, CASE WHEN pos % 5 <> 0 THEN risk END AS risk FROM {lots}"


def known_risks(d):
    return d.sql(RISKS)


CHANGED = f"SELECT c.*, r.risk FROM ({CHANGES}) c LEFT JOIN ({RISKS}) r ON r.parcel_id = c.parcel_id"
CHANGE_SUMMARY = "SELECT count(*) AS total_parcels, count(*) FILTER (WHERE status <> 'unchanged') AS changed_parcels, count(*) FILTER (WHERE status = 'unchanged') AS unchanged, " + ", ".join(
    f"count(*) FILTER (WHERE status = '{k}') AS {k}" for k in ("built_to_green", "green_to_built", "built_to_built", "other_change", "missing")) + f""",
  count(risk) > 0 AS risk_data_available, count(*) FILTER (WHERE risk >= 0.7e0 AND status = 'built_to_green') AS high_risk_improved,
  count(*) FILTER (WHERE risk >= 0.7e0 AND status = 'green_to_built') AS high_risk_worsened FROM ({CHANGED}) c"""


@query("a19_change_summary", CHANGE_SUMMARY)
def _(d):
    return compare.change_summary(changes(d), known_risks(d))


TITLE = "CASE {0} WHEN 'residential' THEN 'Residential' WHEN 'commercial' THEN 'Commercial' WHEN 'industrial' THEN 'Industrial' WHEN 'green' THEN 'Green/Open Space' END"
TRANSITIONS = f"""SELECT baseline_use, comparison_use, count(*) AS n, concat({TITLE.format('baseline_use')}, ' -> ', {TITLE.format('comparison_use')}) AS label FROM ({CHANGES}) c
WHERE baseline_use <> comparison_use GROUP BY baseline_use, comparison_use"""


@query("a20_transitions", TRANSITIONS)
def _(d):
    return compare.transitions(changes(d))


CONSTRAINT_SQL = {"steep": "is_steep", "liquefaction": "has_liquefaction", "flood": "coalesce(has_flood, 0)", "fault": "has_fault", "fire": "is_fire_zone", "esa": "in_esa", "mscp": "in_mscp"}
ACTIVE = " + ".join(f"(CASE WHEN {c} <> 0 THEN 1 ELSE 0 END)" for c in CONSTRAINT_SQL.values())


@query("a21_area_summary", f"""
SELECT count(*) AS n, sum(area_prop) AS area_m2, round(avg(area_prop), 6) AS mean_area_m2, round(avg(perimeter), 6) AS mean_perimeter_m, round(avg({STRICT_RISK}), 6) AS average_risk,
  count(*) FILTER (WHERE {ACTIVE} > 0) AS constrained, count(*) FILTER (WHERE in_esa <> 0 OR in_mscp <> 0) AS protected, count(*) FILTER (WHERE {ACTIVE} >= 2) AS multi_constraint,
  string_agg(DISTINCT zoning_code, ';' ORDER BY zoning_code) AS zones, string_agg(DISTINCT jurisdiction, ';' ORDER BY jurisdiction) AS jurisdictions,
  round(avg(suit_res), 6) AS suit_residential, (SELECT zoning_code FROM {{props}} GROUP BY 1 ORDER BY count(*) DESC, min(pos) LIMIT 1) AS dominant_zone,
  'Flood' AS dominant_constraint FROM {{props}}""")
def _(d):
    s = area.area_summary(d.features)
    return s.select("n", "area_m2", "mean_area_m2", "mean_perimeter_m", "average_risk", "constrained", "protected", "multi_constraint", "zones", "jurisdictions",
                    "suit_residential", "dominant_zone", "dominant_constraint")


@query("a22_layer_coverage", f"""
SELECT field, n, present, round(present * 100e0 / n, 1) AS percent FROM (SELECT 'zoning' AS field, count(*) AS n, count(zone_text) AS present FROM ({{merged}}) m
  UNION ALL SELECT 'height', count(*), count(height) FROM ({{merged}}) m2) q""".replace("({merged})", f"(SELECT l.pos, z.zone_text, z.height FROM {{lots}} l LEFT JOIN ({ONCE}) z ON z.apn = l.parcel_id)"))
def _(d):
    env = d.view("lots").select("pos", F.col("parcel_id").alias("APN"))
    merged = zoning.merge_zoning(env, d.view("zoning_attrs").withColumnRenamed("apn", "APN"))
    return zoning.coverage(merged, {"zone_text": "zoning", "height": "height"})


@query("a23_model_evaluation", """
SELECT round(sqrt(avg((l_quantity - l_linenumber * 7e0) * (l_quantity - l_linenumber * 7e0))), 6) AS rmse,
  round(1 - sum((l_quantity - l_linenumber * 7e0) * (l_quantity - l_linenumber * 7e0)) / (var_pop(l_quantity) * count(*)), 6) AS r2, count(*) AS test_size FROM {lineitem}""")
def _(d):
    t = d.table("lineitem").select(F.col("l_quantity").alias("rule_risk_score"), (F.col("l_linenumber") * 7.0).alias("prediction"))
    return evaluate_model(t)


@query("a24_target_rows", "SELECT plan, use, label, n, target_percent, round(actual, 6) AS actual_percent, round(actual - target_percent, 6) AS difference FROM ("
       + " UNION ALL ".join(f"SELECT plan, '{u}' AS use, '{u.title()}' AS label, n_{u} AS n, {TARGET[u]}e0 AS target_percent, pct_{u} AS actual FROM ({MIX}) m" for u in vocab.LAND_USES) + ") q")
def _(d):
    return report.target_rows(compare.land_use_mix(used(d)), TARGET)


REPORT_BUILT = "use IN ('residential', 'commercial', 'industrial', 'mixed_use')"
RROWS = f"""SELECT u.plan, u.pos, u.parcel_id, u.use, p.risk, p.hazards, CASE WHEN p.verdict IS NOT NULL THEN NOT p.verdict ELSE NOT list_contains(string_split(p.allowed, ','), u.use) END AS conflict,
  CASE u.use WHEN 'residential' THEN p.sres WHEN 'green' THEN p.sgreen END AS suit FROM ({USED}) u LEFT JOIN (SELECT parcel_id, {COMPARE_RISK} AS risk,
  concat_ws(', ', CASE WHEN coalesce(has_flood, 0) <> 0 THEN 'Flood' END, CASE WHEN is_steep <> 0 THEN 'Steep slope' END, CASE WHEN has_fault <> 0 THEN 'Fault' END,
    CASE WHEN has_liquefaction <> 0 THEN 'Liquefaction' END, CASE WHEN is_fire_zone <> 0 THEN 'Fire hazard' END, CASE WHEN in_esa <> 0 THEN 'Environmentally sensitive area' END,
    CASE WHEN in_mscp <> 0 THEN 'MSCP area' END) AS hazards, CASE WHEN zcompat IS NOT NULL THEN zcompat = 'Yes' END AS verdict, {report_allowed_sql()} AS allowed, suit_res AS sres,
  CASE WHEN green <= 1 THEN green ELSE green / 100 END AS sgreen FROM {{props}}) p ON p.parcel_id = u.parcel_id"""
RISKY = f"{REPORT_BUILT} AND (coalesce(risk >= 0.7e0, FALSE) OR hazards <> '')"
RCOUNTS = f"SELECT plan, count(*) FILTER (WHERE {RISKY}) AS high_risk_built, CASE WHEN count(conflict) > 0 THEN count(*) FILTER (WHERE conflict) END AS zoning_conflicts FROM ({RROWS}) r GROUP BY plan"


def report_rows(d):
    return compare.with_facts(used(d), report.report_facts(d.by_lot))


@query("a15_report_high_risk_built", f"""
SELECT plan, parcel_id, CASE use WHEN 'mixed_use' THEN 'Mixed Use' ELSE concat(upper(substr(use, 1, 1)), substr(use, 2)) END AS assigned_use,
  CASE WHEN risk IS NULL THEN 'N/A' ELSE concat(cast(cast(round(risk * 100) AS bigint) AS string), CASE WHEN risk >= 0.7e0 THEN '% high risk' WHEN risk >= 0.4e0 THEN '% medium risk' ELSE '% low risk' END) END AS risk_label,
  hazards AS hazard_flags FROM ({RROWS}) r WHERE {RISKY}""")
def _(d):
    return report.high_risk_built_rows(report_rows(d))


@query("a24_review_counts", RCOUNTS)
def _(d):
    return report.review_counts(report_rows(d))


def plan_table(d):
    """One row per plan: objectives, mix, shares, review counts, deviation and badges."""
    objectives = ob.evaluate(gene_rows(d), ob.default_objectives(), ob.Context(("plan",), edges=edges(d)))
    names = [o.name for o in ob.default_objectives()]
    mix = compare.land_use_mix(used(d))
    shares = badges.share_facts(d.view("assignments").withColumn("run", F.lit(1)), TARGET)
    marks = badges.plan_badges(objectives.withColumn("run", F.lit(1)).join(shares, ["run", "plan"]), names).drop("run")
    dev = compare.mix_deviation(mix, TARGET)
    return objectives.join(mix, "plan").join(dev, "plan").join(report.review_counts(report_rows(d)), "plan").join(marks, "plan"), names


@query("a24_report_comparison_rows", f"""
SELECT concat('Plan ', cast(m.plan + 1 AS string)) AS plan_label, {", ".join(f"m.pct_{u}" for u in vocab.LAND_USES)}, round({DEV.replace('n_', 'm.n_').replace('/ total', '/ m.total')}, 6) AS deviation, c.high_risk_built, c.zoning_conflicts,
  o.environmental_risk_exposure AS risk_objective, o.zoning_violation_penalty AS zoning_objective, o.fragmentation_penalty AS fragmentation_objective
FROM ({MIX}) m JOIN ({RCOUNTS}) c ON c.plan = m.plan JOIN ({OBJECTIVES}) o ON o.plan = m.plan""")
def _(d):
    table, names = plan_table(d)
    return report.comparison_rows(table, names).drop("badges")


@query("a24_report_summary_texts")
def _(d):
    return report.summary_texts(plan_table(d)[0])


@query("a25_plan_conflicts", f"""
SELECT plan, parcel_id, kind, CASE WHEN kind <= 2 THEN 'High' ELSE 'Medium' END AS severity FROM (
  SELECT plan, parcel_id, 1 AS kind FROM ({RROWS}) a WHERE {REPORT_BUILT} AND risk >= 0.7e0 UNION ALL SELECT plan, parcel_id, 2 FROM ({RROWS}) b WHERE {REPORT_BUILT} AND hazards <> ''
  UNION ALL SELECT plan, parcel_id, 3 FROM ({RROWS}) c WHERE suit < 0.35e0 UNION ALL SELECT plan, parcel_id, 4 FROM ({RROWS}) e WHERE conflict) q""")
def _(d):
    return report.conflict_rows(report_rows(d)).select("plan", "parcel_id", "kind", "severity")


@query("a26_comparison_narrative", f"""
SELECT concat_ws(' ', concat('Plan 4 changes ', format('{{:,}}', s.changed_parcels), ' out of ', format('{{:,}}', s.total_parcels), ' parcels compared with Plan 1.'),
  concat('The largest exact transition is ', lower(t.label), ', affecting ', format('{{:,}}', t.n), ' parcel', CASE WHEN t.n = 1 THEN '' ELSE 's' END, '.'),
  CASE WHEN s.green_to_built > s.built_to_green THEN 'The comparison plan shifts more land toward development.' WHEN s.built_to_green > s.green_to_built THEN
    'The comparison plan shifts more land toward conservation or open space.' WHEN s.built_to_built > 0 THEN
    'Most visible changes are between built-use priorities rather than between development and open space.' END,
  CASE WHEN s.high_risk_worsened > 0 THEN concat(format('{{:,}}', s.high_risk_worsened), ' high-risk parcel', CASE WHEN s.high_risk_worsened = 1 THEN '' ELSE 's' END,
    ' moved from green/open space toward a built use, so those changes deserve review.') WHEN s.high_risk_improved > 0 THEN
    'No high-risk parcels worsened, and the comparison plan reduces development exposure on some risky parcels.' ELSE 'No high-risk parcels worsened in the available risk data.' END,
  'Zoning and policy review is still recommended before approval.') AS narrative FROM ({CHANGE_SUMMARY}) s CROSS JOIN (SELECT * FROM ({TRANSITIONS}) x ORDER BY n DESC, label LIMIT 1) t""")
def _(d):
    c = changes(d)
    return compare.narrative(compare.change_summary(c, known_risks(d)), compare.transitions(c).limit(1), "Plan 1", "Plan 4")


@query("a27_compliance_score", "SELECT l_returnflag, cast(floor(coalesce(avg(l_quantity), 0) + 0.5e0) AS bigint) AS compliance FROM {lineitem} GROUP BY l_returnflag")
def _(d):
    return d.table("lineitem").groupBy("l_returnflag").agg(report.compliance_score(F.col("l_quantity")).alias("compliance"))


@query("a28_presence_checks", f"SELECT count({STRICT_RISK}) > 0 AS has_environment, count(zoning_code) > 0 AS has_zoning FROM {{props}}")
def _(d):
    return area.presence(d.features)


@query("a29_objective_ranges", "SELECT run, 'o1' AS objective, min(o1) AS low, max(o1) AS high FROM {individuals} GROUP BY run UNION ALL SELECT run, 'o2', round(min(o2), 6), round(max(o2), 6) FROM {individuals} GROUP BY run")
def _(d):
    return ob.objective_ranges(d.view("individuals").select("run", "o1", "o2"), ["o1", "o2"], ["run"])


@query("a30_gene_changes", "SELECT a.plan, count(*) FILTER (WHERE a.use_code <> b.use_code) AS changes FROM {genes} a JOIN {genes} b ON b.pos = a.pos AND b.plan = 0 GROUP BY a.plan")
def _(d):
    from lotweave.plans.search import gene_changes

    genes = d.view("genes").select("plan", "pos", "use_code")
    first = genes.filter("plan = 0").drop("plan")
    return gene_changes(genes, genes.select("plan", "pos").join(first, "pos"), ["plan"])


@query("a31_metric_bundle", f"""
SELECT m.plan, m.total, {", ".join(f"m.pct_{u}" for u in vocab.LAND_USES)}, r.average_risk, r.observed, r.high_risk_built, r.zoning_conflicts, round({DEV.replace('n_', 'm.n_').replace('/ total', '/ m.total')}, 6) AS deviation,
  f.fragmentation, f.boundary_count, f.edge_count FROM ({MIX}) m JOIN (SELECT plan, round(avg(risk), 6) AS average_risk, count(risk) AS observed, {HIGH} AS high_risk_built,
  {CONFLICTS} AS zoning_conflicts FROM ({ROWS}) x GROUP BY plan) r ON r.plan = m.plan LEFT JOIN ({FRAG}) f ON f.plan = m.plan""")
def _(d):
    return compare.metric_bundle(used(d), facts(d), TARGET)


@query("a32_objective_total", "SELECT p_partkey, round(p_size + CASE WHEN p_partkey % 3 <> 0 THEN p_retailprice ELSE 0 END + p_partkey % 17, 6) AS total FROM {part}")
def _(d):
    bad = F.when(F.col("p_partkey") % 3 == 0, F.lit(float("inf"))).otherwise(F.col("p_retailprice"))
    values = F.array(F.col("p_size").cast("double"), bad, (F.col("p_partkey") % 17).cast("double"), F.lit(None).cast("double"), F.lit(float("nan")))
    return d.table("part").select("p_partkey", report.objective_total(values).alias("total"))


# ---- plan change columns -----------------------------------------------------------------

LEVEL = "CASE WHEN risk IS NULL THEN 'unknown' WHEN risk >= 0.7e0 THEN 'high' WHEN risk >= 0.4e0 THEN 'medium' ELSE 'low' END"
IMPACT = f"""CASE WHEN status = 'built_to_green' THEN CASE WHEN {LEVEL} = 'high' THEN 'Likely improvement' ELSE 'Conservation shift' END
  WHEN status = 'green_to_built' THEN CASE {LEVEL} WHEN 'high' THEN 'Potential concern' WHEN 'low' THEN 'Growth opportunity / needs zoning review' ELSE 'Needs review' END
  WHEN status = 'built_to_built' THEN 'Land-use priority shift' WHEN status = 'unchanged' THEN 'Neutral / no change' ELSE 'Needs review' END"""


@query("p34_change_class", f"SELECT status, count(*) AS n FROM ({CHANGES}) c GROUP BY status")
def _(d):
    return changes(d).groupBy("status").agg(F.count("*").alias("n"))


@query("p35_planning_impact", f"SELECT parcel_id, status, {LEVEL} AS level, {IMPACT} AS impact FROM ({CHANGED}) c")
def _(d):
    return compare.with_impact(changes(d), known_risks(d)).select("parcel_id", "status", "level", "impact")


@query("p35_review_texts")
def _(d):
    return compare.with_impact(changes(d), known_risks(d)).select("parcel_id", "review")


FILTERS = ("all", "changed", "green_to_built", "built_to_green", "built_to_built", "high_risk_changes", "potential_concerns")


@query("p36_change_filters", f"""SELECT count(*) AS n_all, count(*) FILTER (WHERE status NOT IN ('unchanged', 'missing')) AS n_changed, count(*) FILTER (WHERE status = 'green_to_built') AS n_green_to_built,
  count(*) FILTER (WHERE status = 'built_to_green') AS n_built_to_green, count(*) FILTER (WHERE status = 'built_to_built') AS n_built_to_built,
  count(*) FILTER (WHERE status NOT IN ('unchanged', 'missing') AND {LEVEL} = 'high') AS n_high_risk_changes, count(*) FILTER (WHERE {IMPACT} IN ('Potential concern', 'Needs review')) AS n_potential_concerns FROM ({CHANGED}) c""")
def _(d):
    out = compare.with_impact(changes(d), known_risks(d))
    return out.agg(*[F.sum(compare.change_filter(f).cast("bigint")).alias(f"n_{f}") for f in FILTERS])


@query("p42_run_summary", """
SELECT query_id, n, round(avg_risk, 6) AS avg_risk, safe, risky FROM (SELECT c_nationkey AS query_id, count(*) AS n, avg(risk) AS avg_risk,
  coalesce(string_agg(CASE WHEN risk < 0.3e0 THEN parcel_id END, ', ' ORDER BY parcel_id), '') AS safe, coalesce(string_agg(CASE WHEN risk > 0.6e0 THEN parcel_id END, ', ' ORDER BY parcel_id), '') AS risky FROM {lots} GROUP BY 1) q""")
def _(d):
    scored = d.scored_lots().join(d.view("lots").select("parcel_id", F.col("c_nationkey").alias("query_id")), "parcel_id")
    return area.run_summary(scored).drop("summary")


@query("p42_run_summary_texts")
def _(d):
    scored = d.scored_lots().join(d.view("lots").select("parcel_id", F.col("c_nationkey").alias("query_id")), "parcel_id")
    lines = area.environment_lines(scored).groupBy("query_id").agg(F.count("*").alias("lines"))
    mix = area.mix_line(used(d).withColumnRenamed("use", "use_label").withColumnRenamed("plan", "query_id"))
    return area.run_summary(scored).select("query_id", "summary").join(lines, "query_id").join(mix, "query_id", "left")


_MAPPED = "CASE WHEN use_label = 'mixed_use' THEN CASE use_code WHEN 0 THEN 'residential' WHEN 1 THEN 'commercial' WHEN 2 THEN 'industrial' ELSE 'green' END ELSE use_label END"


def _plans(d):
    """Plans as nested rows, the way runs are stored."""
    entry = F.create_map(F.lit("parcelId"), F.col("parcel_id"), F.lit("use_label"), F.col("use_label"), F.lit("use_code"), F.col("use_code").cast("string"))
    slices = d.view("assignments").withColumn("part", F.floor(F.col("pos") / 512))
    return slices.groupBy("plan", "part").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.map_entries(entry).alias("e")))), lambda r: F.map_from_entries(r["e"])).alias("assignments"))


@query("p43_assignment_normalisation", f"SELECT plan, parcel_id, {comparison_use_sql('use_label')} AS list_use, {_MAPPED} AS map_use FROM {{assignments}}")
def _(d):
    plans = _plans(d)
    a = compare.plan_assignments(plans).select("plan", "parcel_id", F.col("use").alias("list_use"))
    b = compare.assignment_map(plans).select("plan", "parcel_id", F.col("use").alias("map_use"))
    return a.join(b, ["plan", "parcel_id"])
