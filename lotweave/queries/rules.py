"""Scalar rules over loose parcel properties."""

from __future__ import annotations

from pyspark.sql import functions as F

from lotweave.functions import coerce, landuse, risk, text, vocab
from lotweave.functions.coerce import Fields, parcel_id
from lotweave.operators import area, compare, explain, nearby, scoring

from lotweave.queries.registry import query
from lotweave.sources.lookup import with_zone_parameters

PID = "nullif(trim(pid), '')"
CLAMP = "least(greatest({0}, 0e0), 1e0)"
STRICT = "CASE WHEN {0} >= 0 AND {0} <= 1 THEN {0} WHEN {0} > 1 AND {0} <= 100 THEN {0} / 100 END"
COMPAT = "least(greatest(CASE WHEN {0} > 1 AND {0} <= 100 THEN {0} / 100 ELSE {0} END, 0e0), 1e0)"
STRICT_RISK = "coalesce(" + ", ".join(STRICT.format(c) for c in ("r_norm", "r_env", "r_xgb", "r_rule")) + ")"
EXPLAIN_RISK = "coalesce(" + ", ".join(STRICT.format(c) for c in ("r_env", "r_xgb", "r_rule")) + ")"
COMPARE_RISK = "coalesce(" + ", ".join(STRICT.format(c) for c in ("r_norm", "r_env", "r_xgb", "r_rule")) + ")"
PLANNER_RISK = ("CASE WHEN r_norm IS NOT NULL THEN " + CLAMP.format("r_norm") + " WHEN r_env IS NOT NULL THEN " + CLAMP.format("r_env")
                + " WHEN r_xgb IS NOT NULL THEN " + CLAMP.format("r_xgb / 100") + " WHEN r_rule IS NOT NULL THEN " + CLAMP.format("r_rule / 100")
                + " ELSE 0e0 END")
PROX_ONE = "CASE WHEN {0} > 100 THEN 1e0 WHEN {0} > 1 THEN {0} / 100 WHEN {0} < 0 THEN 0e0 ELSE {0} END"
PROX_RISK = "coalesce(" + ", ".join(PROX_ONE.format(c) for c in ("r_xgb", "r_rule", "r_env")) + ")"
COMPAT_RISK = ("CASE WHEN r_xgb IS NOT NULL THEN " + COMPAT.format("r_xgb") + " WHEN r_rule IS NOT NULL THEN " + COMPAT.format("r_rule")
               + " WHEN r_env IS NOT NULL THEN " + COMPAT.format("r_env") + " WHEN r_score IS NOT NULL THEN 0e0"
               + " WHEN r_norm IS NOT NULL THEN " + COMPAT.format("r_norm") + " ELSE 0e0 END")
FLAGS = tuple(vocab.RISK_WEIGHTS)
FLAG_SQL = {f: f"(CASE WHEN {f} = 1 THEN 1 ELSE 0 END)" for f in FLAGS}
RULE_TOTAL = " + ".join(f"{FLAG_SQL[f]} * {w}e0" for f, w in vocab.RISK_WEIGHTS.items())
SUIT = {
    "residential": "greatest(0e0, 0.8e0 - {0})", "commercial": "greatest(0e0, 0.7e0 - {0} * 0.8e0)",
    "industrial": "greatest(0e0, 0.6e0 - {0} * 0.5e0)", "green": "least(1e0, 0.2e0 + {0})",
}
FOLD = "regexp_replace(regexp_replace(replace(lower(trim(coalesce({0}, ''))), '&', ' and '), '[\\s-]+', '_', 'g'), '[^a-z0-9_]', '', 'g')"


def words(expr: str, items) -> str:
    return "(" + " OR ".join(f"contains({expr}, '{w}')" for w in items) + ")"


def keep(flags: dict[str, str]) -> str:
    """Comma list of the labels whose condition holds."""
    return "concat_ws(',', " + ", ".join(f"CASE WHEN {c} THEN '{u}' END" for u, c in flags.items()) + ")"


def comparison_use_sql(x: str) -> str:
    f = FOLD.format(x)
    return "CASE " + " ".join(f"WHEN {words(f, w)} THEN '{u}'" for u, w in vocab.COMPARISON_USE_WORDS.items()) + f" ELSE {f} END"


def map_use_sql(x: str) -> str:
    f = FOLD.format(x)
    out = "CASE"
    for u in vocab.LAND_USES:
        extra = f" OR {f} = '{vocab.MAP_USE_EXACT[u]}'" if u in vocab.MAP_USE_EXACT else ""
        out += f" WHEN {words(f, vocab.COMPARISON_USE_WORDS[u])}{extra} THEN '{u}'"
    return out + " END"


def proximity_use_sql(x: str) -> str:
    t = f"lower(trim({x}))"
    return "CASE " + " ".join(f"WHEN {words(t, w)} THEN '{u}'" for u, w in vocab.PROXIMITY_USE_WORDS) + " ELSE 'unknown' END"


def zone_category_sql(x: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({x}, '{p}') THEN '{n}'" for n, p in vocab.ZONE_PATTERNS) + " ELSE 'Unknown' END"


PLANNER_BLOB = "lower(concat_ws(' ', coalesce(zoning_code, ''), coalesce(gp, ''), '', ''))"


def planner_allowed_sql() -> str:
    explicit = keep({u: f"list_contains(list_transform(string_split(lower(coalesce(allowed_txt, '')), ','), lambda t: trim(t)), '{u}')" for u in vocab.LAND_USES})
    infer = {}
    for u in vocab.LAND_USES:
        c = words(PLANNER_BLOB, vocab.PLANNER_ZONING_KEYWORDS[u])
        infer[u] = f"({c} OR contains({PLANNER_BLOB}, 'mixed'))" if u in ("residential", "commercial") else c
    return f"coalesce(nullif({explicit}, ''), nullif({keep(infer)}, ''), '{','.join(vocab.LAND_USES)}')"


COMPARE_BLOB = "lower(concat_ws(' ', '', coalesce(zoning_code, ''), '', coalesce(gp, ''), ''))"


def comparison_allowed_sql() -> str:
    def flags(src: str, extra_mixed: str | None = None) -> dict[str, str]:
        items = f"string_split_regex(coalesce({src}, ''), '[,;|]')"
        any_item = lambda cond: f"len(list_filter({items}, lambda i: {cond})) > 0"
        mixed = any_item("contains(" + comparison_use_sql("i") + ", 'mixed')")
        out = {}
        for u in vocab.LAND_USES:
            c = any_item(comparison_use_sql("i") + f" = '{u}'")
            if u in ("residential", "commercial"):
                c = f"({c} OR {mixed}" + (f" OR {extra_mixed})" if extra_mixed else ")")
            out[u] = c
        return out
    word = f"regexp_matches({COMPARE_BLOB}, '\\bmixed\\b|\\bmixed_use\\b|\\bmixed-use\\b')"
    return f"coalesce(nullif({keep(flags('allowed_txt'))}, ''), nullif({keep(flags(COMPARE_BLOB, word))}, ''))"


def report_allowed_sql() -> str:
    def flags(src: str) -> dict[str, str]:
        items = f"list_transform(string_split_regex(coalesce({src}, ''), '[,;|]'), lambda q: {FOLD.format('q')})"
        any_item = lambda cond: f"len(list_filter({items}, lambda i: {cond})) > 0"
        mixed = any_item("contains(i, 'mixed')")
        return {
            "residential": f"({mixed} OR " + any_item("contains(i, 'residential') OR i = 'r' OR starts_with(i, 'rs')") + ")",
            "commercial": f"({mixed} OR " + any_item("contains(i, 'commercial') OR i = 'c'") + ")",
            "industrial": any_item("contains(i, 'industrial') OR i = 'i'"),
            "green": any_item(words("i", ("green", "open_space", "park", "conservation"))),
        }
    b = COMPARE_BLOB
    pats = {
        "residential": "\\brs\\b|\\brm\\b|\\br-\\b|residential", "commercial": "\\bcc\\b|\\bcn\\b|\\bc-\\b|commercial|retail|office",
        "industrial": "\\bil\\b|\\bih\\b|\\bi-\\b|industrial|manufacturing|warehouse",
        "green": "open space|open_space|\\bos\\b|park|conservation|green|agri"}
    f = flags(b)
    merged = {u: f"({f[u]} OR regexp_matches({b}, '{pats[u]}')" + (f" OR contains({b}, 'mixed'))" if u in ("residential", "commercial") else ")") for u in vocab.LAND_USES}
    return f"coalesce(nullif({keep(flags('allowed_txt'))}, ''), nullif({keep(merged)}, ''))"


@query("p01_parcel_id_resolution", f"""
SELECT pos, coalesce({PID}, apn, join_key, feature_id, concat('parcel-', cast(pos AS string))) AS planner_id,
  coalesce(apn, {PID}, join_key, feature_id) AS proximity_id, coalesce(apn, {PID}, feature_id) AS workspace_id,
  coalesce(apn, {PID}, feature_id) AS metrics_id FROM {{props}}""")
def _(d):
    f = Fields(d.features)
    return d.features.select(
        "pos", parcel_id(f, vocab.ID_ORDER_PLANNER, F.col("pos")).alias("planner_id"),
        parcel_id(f, vocab.ID_ORDER_PROXIMITY).alias("proximity_id"), parcel_id(f, vocab.ID_ORDER_WORKSPACE).alias("workspace_id"),
        parcel_id(f, vocab.ID_ORDER_METRICS).alias("metrics_id"))


@query("p02_risk_key_presence", f"SELECT pos, round({PLANNER_RISK}, 6) AS risk FROM {{props}}")
def _(d):
    return d.features.select("pos", risk.planner_risk(Fields(d.features)).alias("risk"))


@query("p03_risk_proximity", f"SELECT pos, round({PROX_RISK}, 6) AS risk FROM {{props}}")
def _(d):
    return d.features.select("pos", risk.proximity_risk(Fields(d.features)).alias("risk"))


@query("p04_risk_compatibility", f"SELECT pos, round({COMPAT_RISK}, 6) AS risk FROM {{props}}")
def _(d):
    return d.features.select("pos", risk.compatibility_risk(Fields(d.features)).alias("risk"))


@query("p05_risk_explanation", f"SELECT pos, round({EXPLAIN_RISK}, 6) AS risk FROM {{props}}")
def _(d):
    return d.features.select("pos", risk.strict_risk(Fields(d.features), vocab.RISK_KEYS_EXPLANATION).alias("risk"))


@query("p06_risk_plan_comparison", f"SELECT pos, round({COMPARE_RISK}, 6) AS comparison, round({STRICT_RISK}, 6) AS area FROM {{props}}")
def _(d):
    f = Fields(d.features)
    return d.features.select("pos", risk.strict_risk(f, vocab.RISK_KEYS_COMPARISON).alias("comparison"), risk.strict_risk(f, vocab.RISK_KEYS_AREA).alias("area"))


@query("p07_suitability_from_risk", "SELECT pos, " + ", ".join(f"round(s_{u}, 6) AS {u}" for u in vocab.LAND_USES) + " FROM {lots}")
def _(d):
    return d.view("lots").select("pos", *[c.alias(u) for u, c in risk.suitability_from_risk(F.col("risk")).items()])


_PS = {u: SUIT[u].format(f"({PLANNER_RISK})") for u in vocab.LAND_USES}
_XS = {u: SUIT[u].format(f"({EXPLAIN_RISK})") for u in vocab.LAND_USES}
_EXPLICIT = "(suit_res IS NOT NULL OR green IS NOT NULL)"
_SIGNAL = "(r_norm IS NOT NULL OR r_env IS NOT NULL OR r_xgb IS NOT NULL OR r_rule IS NOT NULL)"
_OWN_CLAMP = {"residential": f"coalesce({CLAMP.format('suit_res')}, 0e0)", "green": f"coalesce({CLAMP.format('green')}, 0e0)"}
_OWN_STRICT = {"residential": STRICT.format("suit_res"), "green": STRICT.format("green")}


@query("p08_suitability_extraction", "SELECT pos, " + ", ".join(
    f"round(CASE WHEN {_EXPLICIT} THEN {_OWN_CLAMP.get(u, '0e0')} WHEN {_SIGNAL} THEN {_PS[u]} ELSE 0e0 END, 6) AS planner_{u}, "
    f"round(CASE WHEN coalesce({_OWN_STRICT['residential']}, {_OWN_STRICT['green']}) IS NOT NULL THEN coalesce({_OWN_STRICT.get(u, 'NULL')}, 0e0) "
    f"WHEN {EXPLAIN_RISK} IS NOT NULL THEN {_XS[u]} ELSE 0e0 END, 6) AS explain_{u}" for u in vocab.LAND_USES)
    + f", round({_OWN_STRICT['residential']}, 6) AS area_residential, round(CASE WHEN green <= 1 THEN green ELSE green / 100 END, 6) AS report_green FROM {{props}}")
def _(d):
    f = Fields(d.features)
    base = risk.staged(d.features)
    f = Fields(base)
    staged = base.withColumn("_p", risk.planner_risk(f)).withColumn("_x", risk.strict_risk(f, vocab.RISK_KEYS_EXPLANATION))
    a, b = risk.planner_suitability(f, known=F.col("_p")), risk.explanation_suitability(f, F.col("_x"))
    return staged.select("pos", *[a[u].alias(f"planner_{u}") for u in a], *[b[u].alias(f"explain_{u}") for u in b],
                             risk.area_suitability(f, "residential").alias("area_residential"), risk.report_suitability(f, "green").alias("report_green"))


FEATURE_RISK = f"""CASE WHEN coalesce(aqi, imperv, clay, sand) IS NOT NULL THEN {CLAMP.format(
    "0.45e0 * " + CLAMP.format("(coalesce(aqi, 75e0) - 20e0) / 130e0")
    + " + 0.30e0 * " + CLAMP.format("CASE WHEN coalesce(imperv, 0.5e0) > 1 THEN coalesce(imperv, 0.5e0) / 100 ELSE coalesce(imperv, 0.5e0) END")
    + " + 0.15e0 * " + CLAMP.format("coalesce(clay, 20e0) / 100") + " + 0.10e0 * (1 - " + CLAMP.format("coalesce(sand, 40e0) / 100") + ")")} END"""


@query("p09_feature_based_risk", f"SELECT pos, round({FEATURE_RISK} + 1e-9, 6) AS risk FROM {{props}}")
def _(d):
    return d.features.select("pos", (risk.feature_based_risk(Fields(d.features)) + 1e-9).alias("risk"))


_P10 = f"coalesce(CASE WHEN coalesce(r_xgb, r_rule) IS NOT NULL THEN {CLAMP.format('coalesce(r_xgb, r_rule) / 100')} END, {FEATURE_RISK})"


@query("p10_suitability_prediction", f"SELECT parcel_id, " + ", ".join(
    f"cast(floor((CASE WHEN r IS NULL THEN 0.5e0 ELSE {SUIT[u].format('r')} END) * 1e4 + 0.313e0) AS bigint) AS {u}" for u in vocab.LAND_USES)
    + f", cast(floor(coalesce(r, 0e0) * 1e4 + 0.313e0) AS bigint) AS environmental_risk FROM (SELECT parcel_id, {_P10.replace('r_xgb', 'CASE WHEN apn IS NOT NULL THEN r_xgb END').replace('r_rule', 'CASE WHEN apn IS NOT NULL THEN r_rule END')} AS r FROM {{props}}) q")
def _(d):
    from lotweave.sources.geojson import risk_table

    out = scoring.predict_suitability(d.by_lot, risk_table(d.features))
    # steps of 1e-4 whose borders no short decimal meets, so that engines agree
    return out.select("parcel_id", *[F.floor(F.col(c) * 1e4 + 0.313).cast("bigint").alias(c) for c in (*vocab.LAND_USES, "environmental_risk")])


def _fallback_sql(col: str, name: str, lo: float, hi: float) -> str:
    h = f"('0x' || substr(sha256(concat(coalesce(feature_id, 'None'), ':{name}')), 1, 8))::BIGINT"
    return f"round(coalesce({col}, {lo}e0 + {hi - lo}e0 * ({h} / 4294967295e0)), 6)"


@query("p11_attach_features", "SELECT feature_id AS parcel_id, cast(NULL AS double) AS lon, cast(NULL AS double) AS lat, " + ", ".join(
    f"{_fallback_sql(c, n, *vocab.FALLBACK_RANGES[n])} AS {n}" for c, n in (
        ("sand", "soil_sand_pct"), ("clay", "soil_clay_pct"), ("aqi", "aqi_mean"), ("imperv", "impervious_mean"))) + " FROM {props}")
def _(d):
    return scoring.attach_features(d.features)


@query("p12_rule_risk", f"SELECT pos, round(least(greatest(({RULE_TOTAL}) * 100, 0e0), 100e0), 6) AS rule_risk_score FROM {{props}}")
def _(d):
    return d.features.select("pos", risk.rule_risk_score(scoring.flag_columns(Fields(d.features))).alias("rule_risk_score"))


@query("p13_allowed_uses_planner", f"SELECT pos, {planner_allowed_sql()} AS allowed FROM {{props}}")
def _(d):
    return d.features.select("pos", landuse.planner_allowed_uses(Fields(d.features)).alias("allowed"))


@query("p13_allowed_uses_listed", f"""SELECT pos, CASE pos % 4 WHEN 0 THEN 'industrial,green' WHEN 1 THEN 'residential' ELSE {planner_allowed_sql().replace('allowed_txt', 'CAST(NULL AS VARCHAR)')} END AS allowed FROM {{props}}""")
def _(d):
    """Lists kept as JSON text: two uses, one in other case, an empty list, and a broken one."""
    listed = F.element_at(F.array(*map(F.lit, ('["green", "industrial"]', '[" Residential ", "x"]', "[]", '["commercial"'))), (F.col("pos") % 4 + 1).cast("int"))
    props = F.map_concat(F.map_filter("props", lambda k, v: k != "allowed_uses"), F.create_map(F.lit("allowed_uses"), listed))
    rows = d.features.withColumn("props", props)
    return rows.select("pos", landuse.planner_allowed_uses(Fields(rows)).alias("allowed"))


@query("p14_allowed_uses_comparison", f"SELECT pos, {comparison_allowed_sql()} AS comparison, {report_allowed_sql()} AS report FROM {{props}}")
def _(d):
    f = Fields(d.features)
    return d.features.select("pos", landuse.comparison_allowed_uses(f).alias("comparison"), landuse.report_allowed_uses(f).alias("report"))


_ALIAS = "CASE replace(lower(trim({0})), ' ', '_') " + " ".join(
    f"WHEN '{k}' THEN '{v}'" for k, v in ({u: u for u in vocab.LAND_USES} | vocab.COMPATIBILITY_ALIASES).items()) + " ELSE 'unknown' END"


@query("p15_land_use_compatibility", f"SELECT pos, {_ALIAS.format('land_use')} AS use, {_ALIAS.format('gp')} AS plan_use FROM {{props}}")
def _(d):
    f = Fields(d.features)
    return d.features.select("pos", landuse.compatibility_use(f.get("land_use")).alias("use"), landuse.compatibility_use(f.get("GP_LAND_USE")).alias("plan_use"))


@query("p16_land_use_proximity", f"SELECT pos, {proximity_use_sql('land_use')} AS use, {proximity_use_sql('gp')} AS plan_use FROM {{props}}")
def _(d):
    f = Fields(d.features)
    return d.features.select("pos", landuse.proximity_use(f.get("land_use")).alias("use"), landuse.proximity_use(f.get("GP_LAND_USE")).alias("plan_use"))


@query("p17_land_use_comparison", f"""
SELECT pos, {comparison_use_sql('land_use')} AS comparison, {map_use_sql('land_use')} AS map_use,
  CASE pos % 5 WHEN 0 THEN 'residential' WHEN 1 THEN 'commercial' WHEN 2 THEN 'industrial' WHEN 3 THEN 'green' END AS map_code,
  regexp_replace(lower(trim(coalesce(land_use, ''))), '[\\s-]+', '_', 'g') AS badge FROM {{props}}""")
def _(d):
    f = Fields(d.features)
    u = f.get("land_use")
    return d.features.select("pos", landuse.comparison_use(u).alias("comparison"), landuse.map_use(u).alias("map_use"),
                             landuse.map_use_code((F.col("pos") % 5).cast("string")).alias("map_code"), landuse.badge_fold(u).alias("badge"))


@query("p18_value_coercion", """
SELECT pos, coalesce(lower(trim(zcompat)) IN ('1', 'true', 'yes', 'y', 't', 'on'), FALSE) AS proximity,
  coalesce(lower(trim(zcompat)) IN ('true', 'yes', 'y', '1', 'active', 'present'), FALSE) AS report,
  coalesce(has_flood <> 0, FALSE) AS area_flag,
  CASE WHEN lower(trim(zcompat)) IN ('true', 'yes', 'y', '1', 'compatible') THEN TRUE
       WHEN lower(trim(zcompat)) IN ('false', 'no', 'n', '0', 'incompatible') THEN FALSE END AS tri,
  round(coalesce(r_norm, r_xgb), 6) AS num FROM {props}""")
def _(d):
    f = Fields(d.features)
    z = f.get("zoning_compatible")
    return d.features.select(
        "pos", coerce.truthy(z, vocab.TRUE_WORDS_PROXIMITY).alias("proximity"), coerce.truthy(z, vocab.TRUE_WORDS_REPORT).alias("report"),
        coerce.numeric_truthy(f.get("has_flood"), vocab.TRUE_WORDS_AREA).alias("area_flag"),
        coerce.tri_state(z, vocab.TRUE_WORDS_COMPARISON, vocab.FALSE_WORDS_COMPARISON).alias("tri"),
        F.coalesce(coerce.number(f.get("risk_score")), coerce.number(f.get("risk_score_norm")), coerce.number(f.get("xgb_risk_score"))).alias("num"))


@query("p19_first_non_empty_field", """
SELECT pos, coalesce(gp, land_use) AS zoning, coalesce(land_use, gp) AS land_use, jurisdiction, zoning_code AS zone,
  coalesce(has_flood <> 0, FALSE) AS flood, in_esa = 1 AS esa FROM {props}""")
def _(d):
    facts = nearby.planning_facts(d.features, "pos")
    f = Fields(d.features)
    return d.features.select(
        "pos", coerce.first_present(f, vocab.ZONING_KEYS_PROXIMITY).alias("zoning"), coerce.first_present(f, vocab.LAND_USE_KEYS_PROXIMITY).alias("land_use"),
        coerce.first_present(f, vocab.JURISDICTION_KEYS_AREA).alias("jurisdiction"), area.first_zone(f).alias("zone")).join(
        facts.select("pos", F.col("hz_flood").alias("flood"), F.col("hz_esa").alias("esa")), "pos")


@query("p20_target_mix", """
SELECT scenario_id, label, round(weight, 6) AS weight, round(weight / sum(weight) OVER (PARTITION BY scenario_id), 6) AS share
FROM (SELECT c_nationkey AS scenario_id, lower(c_mktsegment) AS label, sum(greatest(c_acctbal, 0e0)) AS weight FROM {customer} GROUP BY 1, 2) q WHERE weight > 0""")
def _(d):
    mix = d.sql("SELECT c_nationkey AS scenario_id, concat(' ', c_mktsegment) AS label, 1 AS pos, sum(greatest(c_acctbal, 0e0)) AS weight FROM {customer} GROUP BY 1, 2")
    return compare.target_shares(mix.withColumn("weight", F.col("weight").cast("string")))


_TXT = "concat(cast(pos % 70 AS string), '% green, ', CASE WHEN pos % 2 = 0 THEN '20 % residential' ELSE 'more roads' END)"


@query("p21_target_mix_from_text", """
SELECT pos, round(CASE WHEN pos % 2 = 0 THEN 0.2e0 ELSE left_over * (0.4e0 / 0.7e0) END, 6) AS residential,
  round(left_over * (0.2e0 / CASE WHEN pos % 2 = 0 THEN 0.3e0 ELSE 0.7e0 END), 6) AS commercial,
  round(left_over * (0.1e0 / CASE WHEN pos % 2 = 0 THEN 0.3e0 ELSE 0.7e0 END), 6) AS industrial, round((pos % 70) / 100e0, 6) AS green
FROM (SELECT pos, greatest(0e0, 1e0 - (pos % 70) / 100e0 - CASE WHEN pos % 2 = 0 THEN 0.2e0 ELSE 0e0 END) AS left_over FROM {lots}) q""")
def _(d):
    rows = d.sql(f"SELECT pos, {_TXT} AS txt FROM {{lots}}")
    return rows.select("pos", *[c.alias(u) for u, c in landuse.mix_from_text(F.col("txt")).items()])


_ROUTE = "concat_ws(',', " + ", ".join(f"CASE WHEN {words('lower(text)', w)} THEN '{t}' END" for t, w in vocab.ROUTE_WORDS) + ")"


@query("p22_topic_routing", f"SELECT conv_id, turn, coalesce(nullif({_ROUTE}, ''), 'analyze_environment') AS tools FROM {{conversations}}")
def _(d):
    return d.table("conversations").select("conv_id", "turn", text.routes(F.col("text")).alias("tools"))


@query("p23_zone_category", f"SELECT pos, {zone_category_sql('zoning_code')} AS category, concat_ws(',', " + ", ".join(
    f"CASE WHEN regexp_matches(concat(zoning_code, ' next to RR and S80'), '{p}') THEN '{n}' END" for n, p in vocab.ZONE_PATTERNS) + ") AS categories FROM {props}")
def _(d):
    code = Fields(d.features).get("ZONING_CODE")
    return d.features.select("pos", text.zone_category(code).alias("category"), text.zone_categories(F.concat(code, F.lit(" next to RR and S80"))).alias("categories"))


@query("p24_section_number", """
SELECT page_id, CASE WHEN regexp_matches(text, '§131\\.\\d{4}') THEN regexp_extract(text, '§(131\\.\\d{4})', 1)
  WHEN regexp_matches(text, '§\\d{4}') THEN regexp_extract(text, '§(\\d{4})', 1)
  WHEN regexp_matches(text, '(?i)\\bSection\\s+\\d{4}\\b') THEN regexp_extract(text, '(?i)\\bSection\\s+(\\d{4})\\b', 1) END AS section FROM {reg_pages}""")
def _(d):
    return d.view("reg_pages").select("page_id", text.section_number(F.col("text")).alias("section"))


_MARK = lambda ms: " + ".join(f"cast(contains(lower(text), '{m}') AS int)" for m in ms)


@query("p25_document_jurisdiction", f"""
SELECT page_id, CASE WHEN contains(source, 'county') THEN '{vocab.COUNTY}' WHEN contains(source, 'city') THEN '{vocab.CITY}'
  WHEN {_MARK(vocab.COUNTY_MARKERS)} > {_MARK(vocab.CITY_MARKERS)} THEN '{vocab.COUNTY}'
  WHEN {_MARK(vocab.CITY_MARKERS)} > {_MARK(vocab.COUNTY_MARKERS)} THEN '{vocab.CITY}' ELSE 'Unknown' END AS jurisdiction FROM {{reg_pages}}""")
def _(d):
    return d.view("reg_pages").select("page_id", text.document_jurisdiction(F.col("source"), F.col("text")).alias("jurisdiction"))


@query("p26_retrieval_filters", f"""
SELECT pos, CASE WHEN contains(upper(jurisdiction), 'COUNTY') THEN '{vocab.COUNTY}'
  WHEN contains(upper(jurisdiction), 'CITY') OR contains(upper(jurisdiction), 'SAN DIEGO') THEN '{vocab.CITY}' END AS jurisdiction_filter,
  nullif({zone_category_sql('zoning_code')}, 'Unknown') AS zone_filter FROM {{props}}""")
def _(d):
    f = Fields(d.features)
    return d.features.select("pos", text.jurisdiction_filter(f.get("JURISDICTION")).alias("jurisdiction_filter"), text.zone_filter(f.get("ZONING_CODE")).alias("zone_filter"))


@query("p27_retrieval_query_text", f"""
SELECT pos, concat('What may I build?', ' (', concat_ws(', ', CASE WHEN contains(upper(jurisdiction), 'COUNTY') THEN 'county zoning ordinance'
  WHEN contains(upper(jurisdiction), 'SAN DIEGO') THEN 'municipal code' ELSE concat('jurisdiction: ', jurisdiction) END,
  concat(zoning_code, ' zone'), CASE WHEN {zone_category_sql('zoning_code')} <> 'Unknown' THEN concat(lower({zone_category_sql('zoning_code')}), ' use') END,
  CASE WHEN gp IS NOT NULL THEN concat('general plan: ', gp) END), ')') AS query FROM {{props}}""")
def _(d):
    f = Fields(d.features)
    return d.features.select("pos", text.retrieval_query(F.lit("What may I build?"), f.get("JURISDICTION"), f.get("ZONING_CODE"), f.get("GP_LAND_USE")).alias("query"))


_ZP = lambda i: "CASE zoning_code " + " ".join(f"WHEN '{r[0]}' THEN {r[i] if r[i] is not None else 'NULL'}" for r in vocab.ZONE_PARAMETERS) + " END"
_ZU = "CASE zoning_code " + " ".join(f"WHEN '{r[0]}' THEN '{','.join(r[4])}'" for r in vocab.ZONE_PARAMETERS) + " END"


@query("s12_zone_parameter_lookup", f"""
SELECT pos, cast({_ZP(1)} AS double) AS "MAX_HEIGHT", cast({_ZP(2)} AS double) AS "MAX_FAR", cast({_ZP(3)} AS double) AS "MIN_LOT_SIZE", {_ZU} AS "ALLOWED_USES" FROM {{props}}""")
def _(d):
    rows = d.features.select("pos", Fields(d.features).get("ZONING_CODE").alias("ZONING_CODE"))
    return with_zone_parameters(rows).drop("ZONING_CODE")


@query("p28_zone_enrichment", f"""
SELECT pos, coalesce(CASE WHEN pos % 2 = 0 THEN 99e0 END, cast({_ZP(1)} AS double)) AS "MAX_HEIGHT", cast({_ZP(2)} AS double) AS "MAX_FAR",
  cast({_ZP(3)} AS double) AS "MIN_LOT_SIZE", {_ZU} AS "ALLOWED_USES" FROM {{props}}""")
def _(d):
    rows = d.features.select("pos", Fields(d.features).get("ZONING_CODE").alias("ZONING_CODE"), F.when(F.col("pos") % 2 == 0, F.lit(99.0)).alias("MAX_HEIGHT"))
    return with_zone_parameters(rows).drop("ZONING_CODE")


@query("p29_risk_attribution", "SELECT parcel_id, factor, label, weight, active, round(CASE WHEN active THEN weight ELSE 0 END * 100, 1) AS contribution_pct, total_rule_score, "
       "cast(row_number() OVER (PARTITION BY parcel_id ORDER BY CASE WHEN active THEN -weight ELSE 0 END, ord) AS int) AS place FROM ("
       + " UNION ALL ".join(f"SELECT parcel_id, {i} AS ord, '{f}' AS factor, '{vocab.RISK_LABELS[f]}' AS label, {w}e0 AS weight, {FLAG_SQL[f]} = 1 AS active, "
                            f"round(({RULE_TOTAL}) * 100, 2) AS total_rule_score FROM {{props}}" for i, (f, w) in enumerate(vocab.RISK_WEIGHTS.items())) + ") q")
def _(d):
    return scoring.explain_risk(d.by_lot)


_AFTER = RULE_TOTAL.replace(FLAG_SQL["has_flood"], "(CASE WHEN fl = 1 THEN 1 ELSE 0 END)").replace(FLAG_SQL["is_steep"], "(CASE WHEN st = 1 THEN 1 ELSE 0 END)")


@query("p30_risk_counterfactual", f"""
SELECT scenario_id, parcel_id, round(({RULE_TOTAL}) * 100, 2) AS original_score, round(({_AFTER}) * 100, 2) AS counterfactual_score,
  round(round(({_AFTER}) * 100, 2) - round(({RULE_TOTAL}) * 100, 2), 2) AS delta,
  concat_ws(',', concat('has_flood:', cast({FLAG_SQL['has_flood']} AS string), '->0'), CASE WHEN pos % 2 = 0 THEN concat('is_steep:', cast(is_steep AS string), '->1') END) AS applied_changes
FROM (SELECT *, 'dry' AS scenario_id, 0 AS fl, CASE WHEN pos % 2 = 0 THEN 1 ELSE is_steep END AS st FROM {{props}}) q""")
def _(d):
    o = d.view("lots").select(F.lit("dry").alias("scenario_id"), "parcel_id", F.lit(0).alias("has_flood"), F.when(F.col("pos") % 2 == 0, 1).alias("is_steep"))
    return scoring.counterfactual(d.by_lot, o)


@query("p31_risk_bands", """
SELECT pos, CASE WHEN risk >= 0.7e0 THEN 'high' WHEN risk >= 0.4e0 THEN 'moderate' ELSE 'low' END AS explain_band,
  CASE WHEN risk >= 0.7e0 THEN 'high' WHEN risk >= 0.4e0 THEN 'medium' ELSE 'low' END AS map_band,
  CASE WHEN risk > 0.6e0 THEN 'HIGH' WHEN risk > 0.3e0 THEN 'MEDIUM' ELSE 'LOW' END AS summary_band,
  CASE WHEN risk <= 0.1e0 THEN 0 WHEN risk <= 0.2e0 THEN 1 WHEN risk <= 0.3e0 THEN 2 WHEN risk <= 0.4e0 THEN 3 ELSE 4 END AS color_bin FROM {lots}""")
def _(d):
    r = F.col("risk")
    return d.view("lots").select("pos", risk.tier(r).alias("explain_band"), compare.risk_level(r).alias("map_band"),
                                 risk.summary_level(r).alias("summary_band"), risk.color_bin(r).alias("color_bin"))


@query("p37_objective_descriptions", """
SELECT p_partkey, CASE WHEN n LIKE '%risk%' THEN 'Environmental risk exposure' WHEN n LIKE '%zoning%' THEN 'Zoning violation penalty'
  WHEN n LIKE '%green%' AND n LIKE '%deviation%' THEN 'Green area deviation' WHEN n LIKE '%adjacency%' THEN 'Fragmentation penalty'
  ELSE 'Plain Objective' END AS label, n LIKE '%risk%' OR n LIKE '%zoning%' OR n LIKE '%adjacency%' OR n LIKE '%green%' AS explained
FROM (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'env_risk' WHEN 1 THEN 'zoning_gap' WHEN 2 THEN 'green_deviation' WHEN 3 THEN 'adjacency' ELSE 'plain_objective' END AS n FROM {part}) q""")
def _(d):
    rows = d.sql("SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'env_risk' WHEN 1 THEN 'zoning_gap' WHEN 2 THEN 'green_deviation' WHEN 3 THEN 'adjacency' ELSE 'plain_objective' END AS n FROM {part}")
    label, why = landuse.objective_meaning(F.col("n"))
    return rows.select("p_partkey", label.alias("label"), (why != vocab.OBJECTIVE_DEFAULT_TEXT).alias("explained"))


@query("p40_area_percent_format", """
SELECT pos, CASE WHEN a >= 1000000 THEN concat(rtrim(rtrim(format('{:.2f}', a / 1000000), '0'), '.'), ' km²')
  WHEN a >= 10000 THEN concat(rtrim(rtrim(format('{:.2f}', a / 10000), '0'), '.'), ' ha') ELSE concat(format('{:,}', cast(round(a) AS bigint)), ' m²') END AS area,
  concat(rtrim(rtrim(format('{:.1f}', p), '0'), '.'), '%') AS percent, concat('a, b, c', CASE WHEN pos % 2 = 0 THEN ' +2' ELSE '' END) AS ids
FROM (SELECT pos, (500e0 + 10 * (pos % 50)) * (1 + (pos % 3) * 40) * (1 + (pos % 2) * 99) AS a, (pos % 200) / 2e0 AS p FROM {lots}) q""")
def _(d):
    ids = F.when(F.col("pos") % 2 == 0, F.array(*[F.lit(x) for x in "abcde"])).otherwise(F.array(*[F.lit(x) for x in "abc"]))
    a = (F.lit(500.0) + (F.col("pos") % 50) * 10) * (F.lit(1) + (F.col("pos") % 3) * 40) * (F.lit(1) + (F.col("pos") % 2) * 99)
    return d.view("lots").select("pos", text.format_area(a).alias("area"), text.format_percent((F.col("pos") % 200) / 200.0).alias("percent"), text.preview_ids(ids).alias("ids"))


@query("p44_risk_only_scores", f"""
SELECT coalesce(apn, {PID}, feature_id) AS parcel_id, 0e0 AS residential, 0e0 AS commercial, 0e0 AS industrial, 0e0 AS green,
  round(coalesce({STRICT_RISK}, 0e0), 6) AS environmental_risk FROM {{props}} WHERE coalesce(apn, {PID}, feature_id) IS NOT NULL""")
def _(d):
    return area.risk_only_scores(d.features)


@query("p45_answer_cleaning", """
SELECT doc_id, trim(regexp_replace(trim(array_to_string(list_filter(string_split(concat('Question: what', chr(10), '**[Unknown, a.pdf]** ', text, chr(10), '*(note)*'), chr(10)),
  lambda l: NOT regexp_matches(trim(l), '^\\*?\\*?Question:') AND NOT starts_with(trim(l), '*(')), chr(10)), chr(10) || ' ' || chr(9) || chr(13)),
  '\\*\\*\\[.*?\\]\\*\\*\\s*', '', 'g'), chr(10) || ' ' || chr(9) || chr(13)) AS answer FROM {documents}""")
def _(d):
    raw = F.concat(F.lit("Question: what\n**[Unknown, a.pdf]** "), F.col("text"), F.lit("\n*(note)*"))
    return d.table("documents").select("doc_id", text.clean_answer(raw).alias("answer"))


@query("t01_suitability_rank", """
SELECT parcel_id, best_use, cast(rank AS int) AS rank, round(gap, 6) AS gap FROM (
  SELECT parcel_id, use, first_value(use) OVER w AS best_use, row_number() OVER w AS rank, first_value(s) OVER w - s AS gap,
    CASE pos % 4 WHEN 0 THEN 'residential' WHEN 1 THEN 'commercial' WHEN 2 THEN 'industrial' ELSE 'green' END AS assigned
  FROM (SELECT parcel_id, pos, 'residential' AS use, 0 AS o, s_residential AS s FROM {lots} UNION ALL SELECT parcel_id, pos, 'commercial', 1, s_commercial FROM {lots}
    UNION ALL SELECT parcel_id, pos, 'industrial', 2, s_industrial FROM {lots} UNION ALL SELECT parcel_id, pos, 'green', 3, s_green FROM {lots}) q
  WINDOW w AS (PARTITION BY parcel_id ORDER BY s DESC, o)) r WHERE use = assigned""")
def _(d):
    lots = d.view("lots")
    ranked = explain.suitability_rank({u: F.col(f"s_{u}") for u in vocab.LAND_USES})
    rows = lots.select("parcel_id", ranked.alias("r"), landuse.use_label((F.col("pos") % 4).cast("int")).alias("assigned"))
    place = F.array_position(F.transform("r", lambda x: x["use"]), F.col("assigned")).cast("int")
    return rows.select("parcel_id", F.get("r", F.lit(0))["use"].alias("best_use"), place.alias("rank"),
                       (F.get("r", place - 1)["neg"] - F.get("r", F.lit(0))["neg"]).alias("gap"))


@query("p32_assignment_explanation", f"""
SELECT plan, parcel_id, assigned_use, best_use, cast(rank AS int) AS rank, round(score, 6) AS score, round(best_score, 6) AS best_score,
  CASE WHEN r IS NULL THEN 'unknown' WHEN r >= 0.7e0 THEN 'high' WHEN r >= 0.4e0 THEN 'moderate' ELSE 'low' END AS risk_level, round(r, 6) AS environmental_risk,
  CASE WHEN best_score - score >= 0.25e0 THEN TRUE ELSE FALSE END AS much_better_exists, score < 0.3e0 AND assigned_use <> best_use AS trade_off,
  list_contains(string_split(allowed, ','), assigned_use) AS zoning_ok
FROM (SELECT plan, parcel_id, use AS assigned_use, s AS score, r, allowed, first_value(use) OVER w AS best_use, first_value(s) OVER w AS best_score,
    row_number() OVER w AS rank, own FROM (
    """ + " UNION ALL ".join(
        f"SELECT g.plan, g.parcel_id, {EXPLAIN_RISK} AS r, {planner_allowed_sql()} AS allowed, '{u}' AS use, {i} AS o, g.use_code = {i} AS own, "
        f"CASE WHEN coalesce({_OWN_STRICT['residential']}, {_OWN_STRICT['green']}) IS NOT NULL THEN coalesce({_OWN_STRICT.get(u, 'NULL')}, 0e0) "
        f"WHEN {EXPLAIN_RISK} IS NOT NULL THEN {_XS[u]} ELSE 0e0 END AS s FROM {{genes}} g JOIN {{props}} p ON g.pos = p.pos" for i, u in enumerate(vocab.LAND_USES))
    + ") q WINDOW w AS (PARTITION BY plan, parcel_id ORDER BY s DESC, o)) z WHERE own")
def _(d):
    rows = d.view("genes").withColumn("use", landuse.use_label(F.col("use_code")))
    out = explain.explain_assignments(rows, d.by_lot)
    trade = F.exists("warnings", lambda w: w.startswith("This looks like a plan-level trade-off"))
    return out.select("plan", "parcel_id", "assigned_use", "best_use", "rank", "score", "best_score", "risk_level", "environmental_risk",
                      F.exists("warnings", lambda w: w.contains("much higher suitability score")).alias("much_better_exists"), trade.alias("trade_off"),
                      F.exists("reasons", lambda r: r.startswith("Available zoning")).alias("zoning_ok"))


@query("p32_assignment_explanation_texts")
def _(d):
    """Full texts with neighbour context, for all plans."""
    from lotweave.operators.compat import assignment_lookup, local_context
    from lotweave.operators.spatial import neighbour_pairs

    rows = d.view("genes").withColumn("use", landuse.use_label(F.col("use_code")))
    ctx = local_context(neighbour_pairs(d.parcels, 250.0), assignment_lookup(rows, use="use"), d.parcels.select("parcel_id", "risk"))
    return explain.explain_assignments(rows, d.by_lot, {"residential": 40, "commercial": 20, "industrial": 10, "green": 30}, ctx)
