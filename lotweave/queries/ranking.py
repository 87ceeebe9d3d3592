"""Ranking, windows, top-k, fronts and badges."""

from __future__ import annotations

from pyspark.sql import functions as F

from lotweave.functions import vocab
from lotweave.operators import area, badges, ranking
from lotweave.plans import pareto, search
from lotweave.queries.aggregates import ACTIVE, CONSTRAINT_SQL
from lotweave.queries.geometry import haversine_sql
from lotweave.queries.joins import NEAR
from lotweave.queries.registry import query
from lotweave.queries.rules import PID

OBJ = ["o1", "o2", "o3"]


def _fronts(run: str) -> str:
    """Rank = longest chain of dominating distinct vectors, by repeated levels."""
    return f"""WITH RECURSIVE v AS (SELECT DISTINCT {run} AS run, o1, o2, o3 FROM {{individuals}}),
e AS (SELECT a.run, a.o1 AS a1, a.o2 AS a2, a.o3 AS a3, b.o1, b.o2, b.o3 FROM v a JOIN v b ON a.run = b.run AND a.o1 <= b.o1 AND a.o2 <= b.o2 AND a.o3 <= b.o3 AND (a.o1 < b.o1 OR a.o2 < b.o2 OR a.o3 < b.o3)),
chain AS (SELECT run, o1, o2, o3, 0 AS depth FROM v UNION SELECT e.run, e.o1, e.o2, e.o3, c.depth + 1 FROM chain c JOIN e ON c.run = e.run AND c.o1 = e.a1 AND c.o2 = e.a2 AND c.o3 = e.a3),
fronts AS (SELECT i.id, i.o1, i.o2, i.o3, c.run, max(c.depth) AS rank FROM {{individuals}} i JOIN chain c ON c.run = {run.replace('run', 'i.run') if run == 'run' else run} AND c.o1 = i.o1 AND c.o2 = i.o2 AND c.o3 = i.o3 GROUP BY ALL)"""


def ranked(d, one_run: bool = False):
    rows = d.view("individuals")
    if one_run:
        rows = rows.withColumn("run", F.lit("all"))
    return pareto.pareto_ranks(rows, "run", OBJ)


@query("t03_pareto_fronts", _fronts("'all'") + " SELECT id, cast(rank AS int) AS rank FROM fronts")
def _(d):
    return ranked(d, one_run=True).select("id", "rank")


@query("t03_skyline_distributed", "SELECT i.o1, i.o2, i.o3 FROM (SELECT DISTINCT o1, o2, o3 FROM {individuals}) i WHERE NOT EXISTS (SELECT 1 FROM {individuals} j WHERE j.o1 <= i.o1 AND j.o2 <= i.o2 AND j.o3 <= i.o3 AND (j.o1 < i.o1 OR j.o2 < i.o2 OR j.o3 < i.o3))".replace("{individuals} j", "(SELECT * FROM {individuals}) j"))
def _(d):
    rows = d.view("individuals").select(F.lit("all").alias("run"), *OBJ).distinct()
    return pareto.skyline(rows, "run", OBJ, block_rows=512).drop("run")


def _gain(o: str, tie: str) -> str:
    w = f"OVER (PARTITION BY run, rank ORDER BY {o}, {tie}id)"
    return f"CASE WHEN row_number() {w} = 1 OR lead({o}) {w} IS NULL OR n <= 2 THEN 1e300 WHEN hi_{o} = lo_{o} THEN 0e0 ELSE (lead({o}) {w} - lag({o}) {w}) / (hi_{o} - lo_{o}) END"


CROWDED = _fronts("run") + f""", sized AS (SELECT *, count(*) OVER p AS n, {", ".join(f"min({o}) OVER p AS lo_{o}, max({o}) OVER p AS hi_{o}" for o in OBJ)} FROM fronts WINDOW p AS (PARTITION BY run, rank)),
crowded AS (SELECT id, run, rank, o1, o2, o3, g1 + g2 + g3 AS g FROM (SELECT *, {_gain('o1', '')} AS g1, {_gain('o2', 'o1, ')} AS g2, {_gain('o3', 'o2, o1, ')} AS g3 FROM sized) q),
crowd AS (SELECT id, run, rank, CASE WHEN g >= 1e300 THEN 'inf' ELSE cast(round(g, 4) AS string) END AS crowding, CASE WHEN g >= 1e300 THEN 1e300 ELSE round(g, 9) END AS g FROM crowded)"""


def crowded(d):
    return pareto.crowding(ranked(d), ["run", "rank"], "id", OBJ)


@query("t04_crowding_distance", CROWDED + " SELECT id, run, cast(rank AS int) AS rank, g >= 1e300 AS at_end, CASE WHEN g < 1e300 THEN round(g, 4) END AS crowding FROM crowd")
def _(d):
    c = crowded(d)
    end = F.col("crowding") == float("inf")
    return c.select("id", "run", "rank", end.alias("at_end"), F.when(~end, F.round("crowding", 4)).alias("crowding"))


@query("t05_survivor_selection", CROWDED + " SELECT id, run, cast(place AS int) AS place FROM (SELECT id, run, row_number() OVER (PARTITION BY run ORDER BY rank, g DESC, id) AS place FROM crowd) q WHERE place <= 10")
def _(d):
    c = crowded(d).withColumn("crowding", F.when(F.col("crowding") < float("inf"), F.round("crowding", 9)).otherwise(F.lit(1e300)))
    return pareto.survivors(c, "run", "id", 10).select("id", "run", "place")


@query("t06_plan_selection", CROWDED + " SELECT id, run, cast(place - 1 AS int) AS plan FROM (SELECT id, run, row_number() OVER (PARTITION BY run ORDER BY g DESC, id) AS place FROM crowd WHERE rank = 0) q WHERE place <= 5")
def _(d):
    c = crowded(d).withColumn("crowding", F.when(F.col("crowding") < float("inf"), F.round("crowding", 9)).otherwise(F.lit(1e300)))
    return pareto.select_plans(c, "run", "id", 5).select("id", "run", "plan")


@query("u05_population_union", "SELECT run, count(*) AS n, count(DISTINCT k) AS parents FROM (SELECT run, id, 'p' AS k FROM {individuals} UNION ALL SELECT run, id + 1000000, 'o' FROM {individuals}) q GROUP BY run")
def _(d):
    parents = d.view("individuals").withColumn("k", F.lit("p"))
    both = parents.unionByName(parents.withColumn("id", F.col("id") + 1_000_000).withColumn("k", F.lit("o")))
    return both.groupBy("run").agg(F.count("*").alias("n"), F.countDistinct("k").alias("parents"))


@query("t02_nearby_limit", f"SELECT centre_id, count(*) AS n, round(max(distance_m), 3) AS farthest FROM ({NEAR}) r WHERE rank <= 150 GROUP BY centre_id")
def _(d):
    from lotweave.operators.nearby import nearest

    return nearest(d.parcels, d.parcels, 400.0, 150).groupBy("centre_id").agg(F.count("*").alias("n"), F.max("distance_m").alias("farthest"))


# many runs of plans: one run per nation, one plan per market segment
PLAN_RUNS = """SELECT run, row_number() OVER (PARTITION BY run ORDER BY seg) - 1 AS plan, seg, v AS environmental_risk, z AS zoning_penalty, f AS fragmentation FROM (
  SELECT c_nationkey AS run, c_mktsegment AS seg, avg(c_acctbal) / 10000e0 AS v, count(*) * 1e0 AS z, max(c_acctbal) / 10000e0 AS f FROM {customer} GROUP BY 1, 2) q"""
PLAN_USES = """SELECT r.run, r.plan, CASE c.c_custkey % 7 WHEN 0 THEN 'residential' WHEN 1 THEN 'Green' WHEN 2 THEN 'open space' WHEN 3 THEN 'commercial' WHEN 4 THEN 'industrial' WHEN 5 THEN '' ELSE 'Mixed-Use' END AS use_label
  FROM {customer} c JOIN ({runs}) r ON r.run = c.c_nationkey AND r.seg = c.c_mktsegment""".replace("{runs}", PLAN_RUNS)
GOAL = {"residential": 50.0, "green": 30.0, "park": 20.0}
SHARE = f"""SELECT run, plan, label, n * 1e0 / sum(n) OVER (PARTITION BY run, plan) AS share FROM (SELECT run, plan, regexp_replace(lower(trim(use_label)), '[ -]+', '_', 'g') AS label, count(*) AS n FROM ({PLAN_USES}) u GROUP BY 1, 2, 3) q"""
SHARES = f"""SELECT run, plan, sum(abs(share - CASE label WHEN 'residential' THEN 0.5e0 WHEN 'green' THEN 0.3e0 ELSE 0e0 END)) + 1 - sum(CASE label WHEN 'residential' THEN 0.5e0 WHEN 'green' THEN 0.3e0 ELSE 0 END) AS deviation,
  sum(CASE WHEN label IN ('green', 'open_space', 'conservation', 'park', 'parks') THEN share ELSE 0 END) AS green_share,
  sum(CASE WHEN label IN ('residential', 'commercial', 'industrial', 'mixed_use') THEN share ELSE 0 END) AS built_share FROM (SELECT * FROM ({SHARE}) s WHERE label <> '') t GROUP BY run, plan"""
NAMES = ["environmental_risk", "zoning_penalty", "fragmentation"]
SCALED = "CASE WHEN max({0}) OVER r - min({0}) OVER r > 1e-9 THEN ({0} - min({0}) OVER r) / (max({0}) OVER r - min({0}) OVER r) END"
TRADE = f"""SELECT *, (coalesce(a, 0) + coalesce(b, 0) + coalesce(c, 0) + coalesce(e, 0)) / nullif((a IS NOT NULL)::INT + (b IS NOT NULL)::INT + (c IS NOT NULL)::INT + (e IS NOT NULL)::INT, 0) AS overall FROM (
  SELECT p.run, p.plan, environmental_risk, zoning_penalty, fragmentation, deviation, green_share, built_share, {SCALED.format('environmental_risk')} AS a, {SCALED.format('zoning_penalty')} AS b,
    {SCALED.format('fragmentation')} AS c, {SCALED.format('deviation')} AS e FROM ({PLAN_RUNS}) p JOIN ({SHARES}) s ON s.run = p.run AND s.plan = p.plan WINDOW r AS (PARTITION BY p.run)) q"""


def _win(c: str, low: bool, ties: bool = True) -> str:
    lo, hi = f"min({c}) OVER r", f"max({c}) OVER r"
    best = lo if low else hi
    slack = f"greatest(abs({best}) * 0.02e0, 1e-9)" if ties else "1e-9"
    test = f"{c} <= {best} + {slack}" if low else f"{c} >= {best} - {slack}"
    return f"coalesce({hi} - {lo} > 1e-9 AND {test}, FALSE)"


BADGED = f"""SELECT run, plan, array_to_string(list_slice(list_filter([CASE WHEN w0 THEN '{vocab.BADGES[0][1]}' END, CASE WHEN w1 THEN '{vocab.BADGES[1][1]}' END, CASE WHEN w2 THEN '{vocab.BADGES[2][1]}' END,
  CASE WHEN w3 THEN '{vocab.BADGES[3][1]}' END, CASE WHEN w4 THEN '{vocab.BADGES[4][1]}' END, CASE WHEN w5 THEN '{vocab.BADGES[5][1]}' END, CASE WHEN w6 THEN '{vocab.BADGES[6][1]}' END], lambda b: b IS NOT NULL), 1, 3), ',') AS badges
FROM (SELECT run, plan, {_win('overall', True, False)} AS w0, {_win('environmental_risk', True)} AS w1, {_win('deviation', True)} AS w2, {_win('zoning_penalty', True)} AS w3, {_win('fragmentation', True)} AS w4,
  {_win('green_share', False)} AS w5, {_win('built_share', False)} AND NOT {_win('environmental_risk', False)} AS w6 FROM ({TRADE}) t WINDOW r AS (PARTITION BY run)) z"""


def _plan_runs(d):
    plans = d.sql(PLAN_RUNS)
    return plans.join(badges.share_facts(d.sql(PLAN_USES), GOAL), ["run", "plan"])


@query("t07_plan_badges", BADGED)
def _(d):
    return badges.plan_badges(_plan_runs(d), NAMES).withColumn("plan", F.col("plan").cast("bigint"))


@query("t08_overall_tradeoff", f"SELECT run, plan, round(overall, 6) AS overall FROM ({TRADE}) t")
def _(d):
    return badges.overall_scores(_plan_runs(d), NAMES).select("run", F.col("plan").cast("bigint").alias("plan"), "overall")


@query("a16_badge_mix_deviation", f"SELECT run, plan, round(deviation, 6) AS deviation, round(green_share, 6) AS green_share, round(built_share, 6) AS built_share FROM ({SHARES}) s")
def _(d):
    return badges.share_facts(d.sql(PLAN_USES), GOAL).withColumn("plan", F.col("plan").cast("bigint"))


LONG = " UNION ALL ".join(f"SELECT run, plan, '{n}' AS metric, {n} AS value FROM ({PLAN_RUNS}) p" for n in NAMES)


@query("t09_lowest_metric_winners", f"""
SELECT l.run, l.metric, l.plan, round(l.value, 6) AS value FROM ({LONG}) l JOIN (SELECT run, metric, min(value) AS lo, max(value) AS hi, count(*) AS n FROM ({LONG}) m GROUP BY 1, 2) b
ON b.run = l.run AND b.metric = l.metric WHERE n >= 2 AND hi - lo > 1e-9 AND l.value <= lo + 1e-9""")
def _(d):
    return ranking.lowest_winners(d.sql(PLAN_RUNS).drop("seg"), "run", NAMES).withColumn("plan", F.col("plan").cast("bigint"))


@query("t13_closest_neighbours", f"""
SELECT parcel_id, string_agg(concat(other, ':', cast(d AS string)), ' ' ORDER BY k) AS closest FROM (SELECT *, row_number() OVER (PARTITION BY parcel_id ORDER BY d, other) AS k FROM (
  SELECT a.parcel_id, b.parcel_id AS other, round({haversine_sql('a.lon', 'a.lat', 'b.lon', 'b.lat')}, 1) AS d, {haversine_sql('a.lon', 'a.lat', 'b.lon', 'b.lat')} AS x
  FROM {{lots}} a JOIN {{lots}} b ON a.pos <> b.pos AND abs(a.gx - b.gx) <= 2 AND abs(a.gy - b.gy) <= 2) q WHERE x <= 250) r WHERE k <= 5 GROUP BY parcel_id""")
def _(d):
    from lotweave.operators.spatial import neighbour_pairs

    p = neighbour_pairs(d.parcels, 250.0)
    both = p.unionAll(p.select(F.col("right_id").alias("left_id"), F.col("left_id").alias("right_id"), "distance_m"))
    near = ranking.top_k(both.select(F.col("left_id").alias("parcel_id"), F.col("right_id").alias("other"), F.round("distance_m", 1).alias("d")), ["parcel_id"], ["d", "other"], 5)
    rows = near.groupBy("parcel_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.concat_ws(":", "other", F.col("d").cast("string")).alias("t")))).alias("r"))
    return rows.select("parcel_id", F.array_join(F.transform("r", lambda x: x["t"]), " ").alias("closest"))


@query("t14_top_constraints", "SELECT key, label, count, protected, round(count * 1e0 / n, 6) AS share FROM (" + " UNION ALL ".join(
    f"SELECT '{k}' AS key, '{label}' AS label, count(*) FILTER (WHERE {CONSTRAINT_SQL[k]} <> 0) AS count, {str(kind == 'policy').upper()} AS protected, count(*) AS n FROM {{props}}"
    for k, label, _, kind in vocab.CONSTRAINTS) + ") q WHERE count > 0")
def _(d):
    return area.constraint_counts(d.features)


@query("t14_constraint_load", f"SELECT {ACTIVE} AS active, count(*) AS n FROM {{props}} GROUP BY 1")
def _(d):
    f = area.area_facts(d.features)
    flags = [F.col(f"c_{k}").cast("int") for k, *_ in vocab.CONSTRAINTS]
    return f.groupBy(sum(flags[1:], flags[0]).alias("active")).agg(F.count("*").alias("n"))


@query("t15_most_frequent_value", """
SELECT o_custkey, o_orderpriority AS mode FROM (SELECT o_custkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY count(*) DESC, min(o_orderkey)) AS k FROM {orders} GROUP BY 1, 2) q WHERE k = 1""")
def _(d):
    return ranking.most_frequent(d.table("orders"), ["o_custkey"], "o_orderpriority", "o_orderkey")


@query("t16_history_tail", """
SELECT user_id AS session_id, event_id, cast(k AS int) AS from_last, k <= 8 AS in_context FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM {events}) q WHERE k <= 20""")
def _(d):
    return ranking.history_tail(d.table("events").select(F.col("user_id").alias("session_id"), "event_id"), order="event_id")


@query("t17_first_plan_map", "SELECT parcel_id, use_label AS use FROM {assignments} WHERE plan = 0 AND use_label <> 'mixed_use'")
def _(d):
    return area.first_plan(d.view("assignments"))


@query("t18_tournament_winners")
def _(d):
    """Seat draws are hashed; the winner of each draw is never beaten by a rival of its draw (tested)."""
    members = crowded(d).select(F.col("run").alias("scenario_id"), F.col("id").alias("plan"), "rank", "crowding")
    return search.tournaments(members, search.SearchConfig(population_size=20), 1)


@query("t19_exact_size_sample")
def _(d):
    return ranking.exact_sample(d.table("orders").select("o_orderkey", "o_custkey"), "o_orderkey", 5000)


@query("t19_sample_below_limit", f"SELECT pos, coalesce({PID}, apn) AS id FROM {{props}}")
def _(d):
    rows = d.sql(f"SELECT pos, coalesce({PID}, apn) AS id FROM {{props}}")
    return ranking.exact_sample(rows, "pos", 1 << 30)
