"""Spatial, key and comparison joins, and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from lotweave.functions import landuse, risk, vocab
from lotweave.operators import area, compare, compat, nearby, scoring, spatial, zoning
from lotweave.plans import jobs
from lotweave.queries.geometry import haversine_sql
from lotweave.queries.registry import query
from lotweave.queries.rules import STRICT_RISK, SUIT, comparison_use_sql
from lotweave.sources.geojson import risk_table

HIT = "{l}.x0 <= {r}.x1 AND {l}.x1 >= {r}.x0 AND {l}.y0 <= {r}.y1 AND {l}.y1 >= {r}.y0"
LAYERS = spatial.HAZARD_LAYERS
FLAGGED = "SELECT l.pos, " + ", ".join(
    f"max(CASE WHEN h.layer_no = {i} THEN 1 ELSE 0 END) AS {n}" for i, n in enumerate(LAYERS)) + (
    f" FROM {{lots}} l LEFT JOIN {{hazards}} h ON {HIT.format(l='l', r='h')} GROUP BY l.pos")
ADJ = "SELECT a.pos AS a, b.pos AS b FROM {lots} a JOIN {lots} b ON a.pos < b.pos AND abs(a.gx - b.gx) <= 1 AND abs(a.gy - b.gy) <= 1"
PAIRS = f"""SELECT * FROM (SELECT a.parcel_id AS left_id, b.parcel_id AS right_id, a.pos AS left_pos, b.pos AS right_pos,
  {haversine_sql('a.lon', 'a.lat', 'b.lon', 'b.lat')} AS distance_m FROM {{lots}} a JOIN {{lots}} b
  ON a.pos < b.pos AND abs(a.gx - b.gx) <= 2 AND abs(a.gy - b.gy) <= 2) q WHERE distance_m <= 250"""


def flagged(d):
    return spatial.hazard_flags(d.parcels.select("pos", "parcel_id", "risk", "geom"), d.hazard_layers.select("layer", "geom"))


def edges(d):
    return spatial.adjacency(d.parcels)


def pairs(d):
    return spatial.neighbour_pairs(d.parcels, 250.0)


@query("flagship_zone_best_use", f"""
SELECT zone, best_use, count(*) AS parcels, round(avg(r), 6) AS mean_risk FROM (
  SELECT zone, r, CASE WHEN s1 >= s2 AND s1 >= s3 AND s1 >= s4 THEN 'residential' WHEN s2 >= s3 AND s2 >= s4 THEN 'commercial' WHEN s3 >= s4 THEN 'industrial' ELSE 'green' END AS best_use
  FROM (SELECT zone, r, {", ".join(SUIT[u].format('(r / 100)') + f" AS s{i + 1}" for i, u in enumerate(vocab.LAND_USES))} FROM (
    SELECT p.zoning_code AS zone, least(greatest(({" + ".join(f"f.{n} * {w}e0" for n, w in vocab.RISK_WEIGHTS.items())}) * 100, 0e0), 100e0) AS r
    FROM ({FLAGGED}) f JOIN {{props}} p ON p.pos = f.pos) a) b) c GROUP BY zone, best_use""")
def _(d):
    zones = d.view("props").select("pos", F.col("zoning_code").alias("zone"))
    rows = flagged(d).select("pos", risk.rule_risk_score({n: F.col(n) for n in vocab.RISK_WEIGHTS}).alias("r")).join(zones, "pos")
    scores = risk.suitability_from_risk(F.col("r") / 100)
    best = F.lit(None).cast("string")
    top = F.greatest(*scores.values())
    for u in reversed(vocab.LAND_USES):
        best = F.when(scores[u] == top, F.lit(u)).otherwise(best)
    return rows.withColumn("best_use", best).groupBy("zone", "best_use").agg(F.count("*").alias("parcels"), F.avg("r").alias("mean_risk"))


@query("j01_hazard_flags", FLAGGED)
def _(d):
    return flagged(d).select("pos", *LAYERS)


def _zones(d, **columns):
    return d.shaped("zones").select("rn", "geom", *[F.col(c).alias(n) for n, c in columns.items()])


def _first(column: str, layer: str = "zones") -> str:
    return f"(SELECT z.{column} FROM {{{layer}}} z WHERE z.{column} IS NOT NULL AND {HIT.format(l='l', r='z')} ORDER BY z.rn LIMIT 1)"


JURIS = f"SELECT l.*, {_first('name')} AS jurisdiction FROM {{lots}} l"


def first_of(column: str, alias: str, layer: str = "zones") -> str:
    return f"""(SELECT l.pos, min_by(z.{column}, z.rn) AS {alias} FROM {{lots}} l JOIN {{{layer}}} z ON {HIT.format(l='l', r='z')} WHERE z.{column} IS NOT NULL GROUP BY l.pos)"""


def _placed(d):
    return zoning.add_jurisdiction(d.parcels.select("pos", "parcel_id", "geom"), _zones(d, Name="name"))


@query("j02_jurisdiction_join", f"SELECT l.pos, j.v AS jurisdiction FROM {{lots}} l LEFT JOIN {first_of('name', 'v')} j ON j.pos = l.pos")
def _(d):
    return _placed(d).select("pos", F.col("JURISDICTION").alias("jurisdiction"))


CITY = f"""SELECT l.pos, j.v AS jurisdiction, c.v AS zoning_code FROM {{lots}} l LEFT JOIN {first_of('name', 'v')} j ON j.pos = l.pos
LEFT JOIN {first_of('layer_name', 'v', 'city_layer')} c ON c.pos = l.pos WHERE coalesce(contains(lower(j.v), 'city'), FALSE)"""
CITY = CITY.replace("{city_layer}", "(SELECT pos AS rn, x0, y0, x1, y1, CASE WHEN pos % 4 <> 0 THEN concat('RS-1-', cast(pos % 9 AS string)) END AS layer_name FROM {hazards})")
COUNTY = f"""SELECT l.pos, j.v AS jurisdiction, c.v AS zoning_code, h.v AS max_height, f.v AS max_far FROM {{lots}} l LEFT JOIN {first_of('name', 'v')} j ON j.pos = l.pos
LEFT JOIN {first_of('usereg', 'v')} c ON c.pos = l.pos LEFT JOIN {first_of('height', 'v')} h ON h.pos = l.pos LEFT JOIN {first_of('far', 'v')} f ON f.pos = l.pos
WHERE NOT coalesce(contains(lower(j.v), 'city'), FALSE)"""


def _city_layer(d):
    name = F.when(F.col("pos") % 4 != 0, F.concat(F.lit("RS-1-"), (F.col("pos") % 9).cast("string")))
    return d.shaped("hazards").select(F.col("pos").alias("rn"), "geom", name.alias("ZONE_NAME"))


def _county_layer(d):
    return _zones(d, USEREG="usereg", HEIGHT="height", MAXFLR="far")


def _zoned(d):
    return zoning.place_zoning(d.parcels.select("pos", "parcel_id", "geom"), _city_layer(d), _county_layer(d), _zones(d, Name="name"))


@query("j03_city_zoning_join", CITY)
def _(d):
    out = zoning.city_zoning(_zoned(d))
    return out.select("pos", F.col("JURISDICTION").alias("jurisdiction"), F.col("ZONING_CODE").alias("zoning_code"))


@query("j04_county_zoning_join", COUNTY)
def _(d):
    out = zoning.county_zoning(_zoned(d))
    return out.select("pos", F.col("JURISDICTION").alias("jurisdiction"), F.col("ZONING_CODE").alias("zoning_code"),
                      F.col("MAX_HEIGHT").alias("max_height"), F.col("MAX_FAR").alias("max_far"))


@query("j05_general_plan_join", f"SELECT l.pos, g.v AS gp_land_use FROM {{lots}} l LEFT JOIN {first_of('gp_lu', 'v', 'gp_areas')} g ON g.pos = l.pos")
def _(d):
    layer = d.shaped("gp_areas").select("rn", "geom", F.col("gp_lu").alias("GP_LU_DESC"))
    return zoning.add_general_plan(d.parcels.select("pos", "geom"), layer).select("pos", F.col("GP_LAND_USE").alias("gp_land_use"))


@query("j06_baseline_key_filter", "SELECT pos FROM {lots} WHERE upper(trim(parcel_id)) IN (SELECT upper(trim(apn)) FROM {zoning_attrs})")
def _(d):
    baseline = d.view("zoning_attrs").select(F.concat(F.lit(" "), F.lower("apn")).alias("PARCELID"))
    return zoning.keep_baseline(d.parcels.select("pos", F.col("parcel_id").alias("APN")), baseline).select("pos")


ONCE = "SELECT apn, min(zone_text) AS zone_text, min(height) AS height, min(row_id) AS row_id FROM {zoning_attrs} GROUP BY apn HAVING count(*) = 1"


@query("j07_env_zoning_merge", f"SELECT l.pos, l.parcel_id AS apn, z.zone_text, round(z.height, 6) AS height, z.row_id FROM {{lots}} l LEFT JOIN ({ONCE}) z ON z.apn = l.parcel_id")
def _(d):
    env = d.view("lots").select("pos", F.col("parcel_id").alias("APN"))
    z = d.view("zoning_attrs").withColumnRenamed("apn", "APN")
    return zoning.merge_zoning(env, z).select("pos", F.col("APN").alias("apn"), "zone_text", "height", "row_id")


@query("j07_positional_merge", "SELECT l.pos, l.parcel_id, z.zone_text FROM {lots} l LEFT JOIN {zoning_attrs} z ON z.row_id = l.pos")
def _(d):
    z = d.view("zoning_attrs").select(F.col("row_id").alias("pos"), "zone_text")
    return zoning.merge_zoning(d.view("lots").select("pos", "parcel_id"), z)


def _regulations(d):
    return d.sql("SELECT concat('APN-', lpad(cast(s_suppkey * 3 AS string), 8, '0')) AS parcel_id, 1 AS regulations_found, array(s_name) AS regulations FROM {supplier}")


@query("j08_stage_merge", """
SELECT coalesce(l.parcel_id, z.parcel_id) AS parcel_id, """ + ", ".join(f"round(coalesce(s_{u}, 0e0), 6) AS {u}" for u in vocab.LAND_USES) + """,
  round(coalesce(risk, 0e0), 6) AS environmental_risk, coalesce(z.n, 0) AS regulations_found, coalesce(z.s_name, '') AS regulations
FROM (SELECT * FROM {lots}) l FULL JOIN (SELECT concat('APN-', lpad(cast(s_suppkey * 3 AS string), 8, '0')) AS parcel_id, 1 AS n, s_name FROM {supplier}) z ON z.parcel_id = l.parcel_id""")
def _(d):
    return jobs.merge_stages(d.scored_lots().drop("pos"), _regulations(d))


@query("j09_risk_lookup_join", """
SELECT l.parcel_id, round(r.v, 6) AS risk_raw FROM {lots} l LEFT JOIN (SELECT apn, coalesce(r_xgb, r_rule) AS v FROM {props} WHERE apn IS NOT NULL AND coalesce(r_xgb, r_rule) IS NOT NULL) r ON r.apn = l.parcel_id""")
def _(d):
    return scoring.lookup_risk(d.view("lots").select("parcel_id"), risk_table(d.features))


@query("j10_adjacency_touches", ADJ)
def _(d):
    return edges(d)


@query("j10_adjacency_exact_predicate", ADJ)
def _(d):
    """The general edge-by-edge test, for shapes that are not boxes."""
    pairs_ = spatial.self_box_pairs(spatial.with_box(d.parcels.select("pos", "geom")), "pos")
    from lotweave.functions.geometry import touches

    return pairs_.filter(touches(F.col("l.geom"), F.col("r.geom"))).select(F.col("l.pos").alias("a"), F.col("r.pos").alias("b"))


@query("j10_neighbour_lists", f"""
SELECT l.pos, coalesce(n.v, '') AS neighbours FROM {{lots}} l LEFT JOIN (SELECT a, string_agg(cast(b AS string), ',' ORDER BY b) AS v FROM (
  SELECT a, b FROM ({ADJ}) e UNION ALL SELECT b, a FROM ({ADJ}) e2) m GROUP BY a) n ON n.a = l.pos""")
def _(d):
    return spatial.neighbour_lists(edges(d), d.parcels)


@query("j11_neighbour_pairs", f"SELECT left_id, right_id, round(distance_m, 3) AS distance_m FROM ({PAIRS}) p")
def _(d):
    return pairs(d).withColumn("distance_m", F.round("distance_m", 3))


NEAR = f"""SELECT centre_id, parcel_id, distance_m, row_number() OVER (PARTITION BY centre_id ORDER BY distance_m, parcel_id) AS rank FROM (
  SELECT c.parcel_id AS centre_id, l.parcel_id, round({haversine_sql('c.lon', 'c.lat', 'l.lon', 'l.lat')}, 3) AS distance_m, {haversine_sql('c.lon', 'c.lat', 'l.lon', 'l.lat')} AS dist
  FROM {{lots}} c JOIN {{lots}} l ON abs(c.gx - l.gx) <= 3 AND abs(c.gy - l.gy) <= 3) q WHERE dist <= 400"""


@query("j12_nearby_topk", f"SELECT centre_id, parcel_id, distance_m, cast(rank AS int) AS rank FROM ({NEAR}) r WHERE rank <= 5")
def _(d):
    return nearby.nearest(d.parcels, d.parcels, 400.0, 5)


@query("j13_compatibility_matrix", f"""
SELECT a.plan, a.parcel_id, coalesce(CASE WHEN a.use_label = b.u THEN CASE a.use_label WHEN 'green' THEN 3e0 WHEN 'mixed_use' THEN 2e0 ELSE 2e0 END END,
  CASE concat(least(n.x, b.u), greatest(n.x, b.u)) WHEN 'commercialresidential' THEN 0.5e0 WHEN 'industrialresidential' THEN -4e0 WHEN 'greenresidential' THEN 1e0
  WHEN 'commercialindustrial' THEN -1e0 WHEN 'greenindustrial' THEN -2e0 WHEN 'commercialcommercial' THEN 2e0 ELSE 0e0 END) AS score
FROM {{assignments}} a JOIN (SELECT 'residential' AS u, 0 AS c UNION ALL SELECT 'commercial', 1 UNION ALL SELECT 'industrial', 2 UNION ALL SELECT 'green', 3) b ON b.c = a.pos % 4
JOIN (SELECT 'mixed_use' AS k, 'commercial' AS x UNION ALL SELECT 'residential', 'residential' UNION ALL SELECT 'commercial', 'commercial' UNION ALL SELECT 'industrial', 'industrial'
  UNION ALL SELECT 'green', 'green') n ON n.k = a.use_label""")
def _(d):
    other = landuse.use_label((F.col("pos") % 4).cast("int"))
    return d.view("assignments").select("plan", "parcel_id", landuse.pair_score(landuse.compatibility_use(F.col("use_label")), other).alias("score"))


LOOK = "SELECT plan, parcel_id, pos, CASE WHEN use_label = 'mixed_use' THEN CASE use_code WHEN 0 THEN 'residential' WHEN 1 THEN 'commercial' WHEN 2 THEN 'industrial' ELSE 'green' END ELSE use_label END AS use FROM {assignments}"
CHANGE = """CASE WHEN a.use IS NULL OR b.use IS NULL THEN 'missing' WHEN a.use = b.use THEN 'unchanged' WHEN b.use = 'green' THEN 'built_to_green'
  WHEN a.use = 'green' THEN 'green_to_built' ELSE 'built_to_built' END"""
CHANGES = f"""SELECT coalesce(a.parcel_id, b.parcel_id) AS parcel_id, coalesce(a.pos, b.pos) AS pos, a.use AS baseline_use, b.use AS comparison_use, {CHANGE} AS status
FROM (SELECT * FROM ({LOOK}) x WHERE plan = 0) a FULL JOIN (SELECT * FROM ({LOOK}) y WHERE plan = 3) b ON a.parcel_id = b.parcel_id"""


def lookup(d):
    """Assignments through the map variant, which reads use codes when the label is no map use."""
    rows = d.view("assignments")
    use = F.coalesce(landuse.map_use(F.col("use_label")), landuse.map_use_code(F.col("use_code")))
    return rows.withColumn("use", use).groupBy("plan", "parcel_id").agg(F.max_by("use", "pos").alias("use"))


def changes(d):
    return compare.compare_plans(lookup(d), 0, 3)


@query("j14_plan_to_plan", f"SELECT parcel_id, baseline_use, comparison_use, status FROM ({CHANGES}) c")
def _(d):
    return changes(d)


@query("j15_assignment_properties", f"""
SELECT a.plan, a.parcel_id, {comparison_use_sql('a.use_label')} AS use, round({STRICT_RISK}, 6) AS risk FROM {{assignments}} a LEFT JOIN {{props}} p ON p.parcel_id = a.parcel_id AND p.pos % 13 <> 0""")
def _(d):
    rows = d.view("assignments").select("plan", "pos", "parcel_id", landuse.comparison_use(F.col("use_label")).alias("use"))
    facts = compare.parcel_facts(d.by_lot.filter(F.col("pos") % 13 != 0))
    return compare.with_facts(rows, facts).select("plan", "parcel_id", "use", "risk")


CONTEXT_PAIRS = f"""SELECT g.plan, p.left_id, p.right_id, g.use_code AS lu, h.use_code AS ru, greatest(a.risk, b.risk) AS mr, p.distance_m
FROM ({PAIRS}) p JOIN {{genes}} g ON g.pos = p.left_pos JOIN {{genes}} h ON h.pos = p.right_pos AND h.plan = g.plan JOIN {{lots}} a ON a.pos = p.left_pos JOIN {{lots}} b ON b.pos = p.right_pos"""
MATRIX = """CASE least(lu, ru) * 4 + greatest(lu, ru) WHEN 0 THEN 2e0 WHEN 1 THEN 0.5e0 WHEN 2 THEN -4e0 WHEN 3 THEN 1e0 WHEN 5 THEN 2e0 WHEN 6 THEN -1e0 WHEN 7 THEN 0e0
  WHEN 10 THEN 2e0 WHEN 11 THEN -2e0 WHEN 15 THEN 3e0 END"""
LOCAL = f"{MATRIX} + CASE WHEN (lu = 3 OR ru = 3) AND mr >= 0.6e0 THEN 0.75e0 ELSE 0 END - CASE WHEN (lu = 2 OR ru = 2) AND mr >= 0.6e0 THEN 0.4e0 ELSE 0 END"


def gene_uses(d):
    return d.view("genes").select("plan", "parcel_id", landuse.use_label(F.col("use_code")).alias("use"))


def risks(d):
    return d.view("lots").select("parcel_id", "risk")


@query("j16_local_context", f"""
SELECT g.plan, g.parcel_id, coalesce(n, 0) AS neighbor_pairs_evaluated, coalesce(ok, 0) AS compatible_pairs, coalesce(bad, 0) AS conflict_pairs,
  coalesce(buf, 0) AS green_buffer_pairs, coalesce(near_green, 0) AS near_green
FROM {{genes}} g LEFT JOIN (SELECT plan, id, count(*) AS n, count(*) FILTER (WHERE s > 0) AS ok, count(*) FILTER (WHERE s < 0) AS bad, count(*) FILTER (WHERE buffered) AS buf, count(*) FILTER (WHERE other = 3) AS near_green FROM (
  SELECT plan, left_id AS id, ru AS other, {LOCAL} AS s, (lu = 3 OR ru = 3) AND mr >= 0.6e0 AS buffered FROM ({CONTEXT_PAIRS}) c
  UNION ALL SELECT plan, right_id, lu, {LOCAL}, (lu = 3 OR ru = 3) AND mr >= 0.6e0 FROM ({CONTEXT_PAIRS}) c2) m GROUP BY plan, id) x ON x.plan = g.plan AND x.id = g.parcel_id""")
def _(d):
    out = compat.local_context(pairs(d), gene_uses(d), risks(d))
    return out.select("plan", "parcel_id", "neighbor_pairs_evaluated", "compatible_pairs", "conflict_pairs", "green_buffer_pairs", "near_green")


@query("j16_local_context_texts")
def _(d):
    out = compat.local_context(pairs(d), gene_uses(d), risks(d))
    return out.select("plan", "parcel_id", "closest", "reasons", "warnings")


PROP_EDGES = """SELECT a.plan, e.x AS a, e.y AS b, a.u AS use_a, b.u AS use_b FROM (
  SELECT DISTINCT least(parcel_id, n) AS x, greatest(parcel_id, n) AS y FROM (SELECT parcel_id, trim(unnest(string_split(neigh, ';'))) AS n FROM {props} WHERE neigh IS NOT NULL) q) e
  JOIN (SELECT plan, parcel_id, use_label AS u FROM {assignments}) a ON a.parcel_id = e.x JOIN (SELECT plan, parcel_id, use_label AS u FROM {assignments}) b ON b.parcel_id = e.y AND b.plan = a.plan"""


def used(d):
    return d.view("assignments").select("plan", "pos", "parcel_id", landuse.comparison_use(F.col("use_label")).alias("use"))


@query("j17_neighbour_id_edges", PROP_EDGES)
def _(d):
    return compare.property_edges(used(d), compare.parcel_facts(d.by_lot))


@query("j18_box_selection", "SELECT pos FROM {lots} WHERE x0 <= -117.15e0 AND x1 >= -117.18e0 AND y0 <= 32.74e0 AND y1 >= 32.71e0")
def _(d):
    return spatial.box_select(d.parcels, -117.18, 32.71, -117.15, 32.74).select("pos")


@query("j19_viewport_filter", """
SELECT pos FROM {lots} WHERE (x0 BETWEEN -117.18e0 AND -117.15e0 OR x1 BETWEEN -117.18e0 AND -117.15e0) AND (y0 BETWEEN 32.71e0 AND 32.74e0 OR y1 BETWEEN 32.71e0 AND 32.74e0)""")
def _(d):
    return spatial.in_viewport(d.parcels, -117.18, 32.71, -117.15, 32.74).select("pos")


@query("j20_selection_precedence", """
SELECT o_orderkey AS "order", concat('APN-', lpad(cast(o_custkey AS string), 8, '0')) AS parcel_id, CASE WHEN o_custkey % 2 = 0 THEN 'selected' ELSE 'loaded' END AS origin
FROM {orders} JOIN {lots} l ON l.pos = o_custkey WHERE o_custkey % 2 = 0 OR o_custkey % 3 <> 0""")
def _(d):
    ids = d.sql("SELECT o_orderkey AS `order`, concat('APN-', lpad(cast(o_custkey AS string), 8, '0')) AS parcel_id FROM {orders}")
    lots = d.view("lots")
    chosen = lots.filter(F.col("pos") % 2 == 0).select("parcel_id", F.lit("selected").alias("origin"))
    loaded = lots.filter(F.col("pos") % 3 != 0).select("parcel_id", F.lit("loaded").alias("origin"))
    return area.pick_selected(ids, chosen, loaded)


@query("j21_shared_regulations", """
SELECT l.parcel_id, 5 AS regulations_found, x.first_source FROM {lots} l CROSS JOIN (SELECT source AS first_source FROM {documents} ORDER BY doc_id LIMIT 1) x""")
def _(d):
    hits = d.sql("SELECT cast(doc_id + 1 AS int) AS place, source, lang AS jurisdiction, '' AS section, text FROM {documents}")
    out = jobs.shared_regulations(d.view("lots").select("parcel_id"), hits)
    return out.select("parcel_id", "regulations_found", F.get("regulations", F.lit(0))["source"].alias("first_source"))


# ---- set operations ----------------------------------------------------------------------

@query("u01_union_common_columns", f"SELECT pos, jurisdiction, zoning_code FROM ({CITY}) c UNION ALL SELECT pos, jurisdiction, zoning_code FROM ({COUNTY}) k")
def _(d):
    zoned = _zoned(d)
    out = zoning.union_common(zoning.city_zoning(zoned), zoning.county_zoning(zoned))
    return out.select("pos", F.col("JURISDICTION").alias("jurisdiction"), F.col("ZONING_CODE").alias("zoning_code"))


@query("j03_j04_assign_zoning", f"SELECT pos, jurisdiction, zoning_code, NULL::DOUBLE AS max_far FROM ({CITY}) c UNION ALL SELECT pos, jurisdiction, zoning_code, max_far FROM ({COUNTY}) k")
def _(d):
    out = zoning.assign_zoning(d.parcels.select("pos", "parcel_id", "geom"), _city_layer(d), _county_layer(d), _zones(d, Name="name"))
    return out.select("pos", F.col("JURISDICTION").alias("jurisdiction"), F.col("ZONING_CODE").alias("zoning_code"), F.col("MAX_FAR").alias("max_far"))


@query("u02_id_union", "SELECT parcel_id FROM {lots} UNION SELECT apn FROM {zoning_attrs}")
def _(d):
    return d.view("lots").select("parcel_id").union(d.view("zoning_attrs").select("apn")).distinct()


@query("u03_key_intersection", """
SELECT parcel_id, 'kept' AS side FROM {lots} WHERE parcel_id IN (SELECT apn FROM {zoning_attrs}) UNION ALL
SELECT DISTINCT apn, 'new' FROM {zoning_attrs} WHERE apn NOT IN (SELECT parcel_id FROM {lots})""")
def _(d):
    lots, z = d.view("lots").select("parcel_id"), d.view("zoning_attrs").select(F.col("apn").alias("parcel_id"))
    kept = lots.join(z, "parcel_id", "left_semi").select("parcel_id", F.lit("kept").alias("side"))
    new = z.join(lots, "parcel_id", "left_anti").distinct().select("parcel_id", F.lit("new").alias("side"))
    return kept.unionAll(new)


@query("u04_idempotent_append", """
SELECT DISTINCT substr(sha256(text), 1, 16) AS chunk_id FROM {documents} WHERE substr(sha256(text), 1, 16) NOT IN (SELECT substr(sha256(text), 1, 16) FROM {documents} WHERE lang = 'en')""")
def _(d):
    docs = d.table("documents").select(F.substring(F.sha2("text", 256), 1, 16).alias("chunk_id"), "text", "lang")
    return zoning.append_new(docs.filter("lang = 'en'"), docs).select("chunk_id")


@query("u06_distinct_in_order", "SELECT o_custkey AS id, min(o_orderkey) AS pos FROM {orders} GROUP BY o_custkey")
def _(d):
    from lotweave.operators.ranking import distinct_in_order

    return distinct_in_order(d.table("orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("pos")), "id")


@query("u07_collapse_rows", """
SELECT c AS row_id, min_by(a, k) FILTER (WHERE a IS NOT NULL) AS a, round(min_by(b, k) FILTER (WHERE b IS NOT NULL), 6) AS b
FROM (SELECT o_custkey AS c, o_orderkey AS k, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority END AS a, CASE WHEN o_orderkey % 4 <> 0 THEN o_totalprice END AS b FROM {orders}) q GROUP BY c""")
def _(d):
    rows = d.sql("SELECT o_custkey AS row_id, o_orderkey AS k, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority END AS a, CASE WHEN o_orderkey % 4 <> 0 THEN o_totalprice END AS b FROM {orders}")
    return zoning.collapse_rows(rows, "row_id", "k")


@query("s13_first_feature_per_id", """
SELECT parcel_id, min(k) AS pos FROM (SELECT o_orderkey AS k, CASE WHEN o_custkey % 10 = 3 THEN concat('parcel-', cast(o_orderkey AS string)) ELSE cast(o_custkey AS string) END AS parcel_id FROM {orders}) q GROUP BY parcel_id""")
def _(d):
    from lotweave.sources.geojson import first_feature_per_id

    rows = d.sql("SELECT o_orderkey AS pos, map('APN', CASE WHEN o_custkey % 10 = 3 THEN '  ' ELSE cast(o_custkey AS string) END) AS props FROM {orders}")
    return first_feature_per_id(rows, vocab.ID_ORDER_PROXIMITY, keep_blank=True).select("parcel_id", "pos")


@query("s02_risk_table", "SELECT apn, round(coalesce(r_xgb, r_rule), 6) AS risk_raw FROM {props} WHERE apn IS NOT NULL AND coalesce(r_xgb, r_rule) IS NOT NULL")
def _(d):
    return risk_table(d.features)


@query("s03_parcel_centroids", "SELECT parcel_id, round(lon, 6) AS lon, round(lat, 6) AS lat FROM (SELECT coalesce(apn, nullif(trim(pid), ''), join_key, feature_id) AS parcel_id, lon, lat FROM {props}) q WHERE parcel_id IS NOT NULL")
def _(d):
    from lotweave.sources.geojson import parcel_centroids

    return parcel_centroids(d.features).select("parcel_id", "lon", "lat")


@query("s03_centroid_quality", """
SELECT cast(count(*) AS bigint) AS total, cast(count(DISTINCT id) AS bigint) AS usable, cast(count(*) - count(id) AS bigint) AS invalid, cast(count(id) - count(DISTINCT id) AS bigint) AS duplicates
FROM (SELECT coalesce(apn, nullif(trim(pid), ''), join_key, feature_id) AS id FROM {props} UNION ALL SELECT parcel_id FROM {lots}) q""")
def _(d):
    from lotweave.sources.geojson import centroid_quality

    again = d.features.withColumn("props", F.create_map(F.lit("APN"), F.col("lot_id")))
    return centroid_quality(d.features.unionByName(again))


@query("s04_regulation_pages", "SELECT source, cast(row_number() OVER (PARTITION BY source ORDER BY page_id) AS bigint) AS page_num, page_id FROM {reg_pages}")
def _(d):
    from lotweave.operators.prefix import running_number

    return running_number(d.view("reg_pages"), ["source"], "page_id", "page_num").select("source", F.col("page_num").cast("bigint").alias("page_num"), "page_id")
