"""Job and session state; the same functions run on streams (see the tests)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lotweave.functions import text
from lotweave.queries.registry import query
from lotweave.streaming import progress, sessions

STEPS = progress.STEPS
LATEST = ", ".join(f"coalesce(max_by(status, (ts, event_id)) FILTER (WHERE step = '{s}'), 'pending') AS {s}" for s in STEPS)
STATES = f"""SELECT job_id, {', '.join(STEPS)}, CASE WHEN failed THEN 'failed' WHEN done THEN 'completed' ELSE 'running' END AS status,
  CASE WHEN done AND NOT failed THEN 100 ELSE greatest(CASE WHEN environment = 'completed' THEN 30 ELSE 0 END, CASE WHEN zoning = 'completed' THEN 60 ELSE 0 END,
    CASE WHEN merge = 'completed' THEN 80 ELSE 0 END, CASE WHEN spatial = 'completed' THEN 100 ELSE 0 END) END AS progress,
  CASE WHEN done AND NOT failed THEN 'completed' ELSE stage END AS stage, created_at, updated_at FROM (SELECT *, {" OR ".join(f"{s} = 'failed'" for s in STEPS)} AS failed,
  {" AND ".join(f"{s} IN ('completed', 'skipped')" for s in STEPS)} AS done FROM (SELECT job_id, {LATEST}, max_by(step, (ts, event_id)) AS stage, min(ts) AS created_at, max(ts) AS updated_at
  FROM {{job_events}} WHERE step <> 'note' GROUP BY job_id) a) b"""


@query("w01_job_progress", f"SELECT job_id, {', '.join(STEPS)}, status, progress, stage FROM ({STATES}) s")
def _(d):
    return progress.job_states(d.view("job_events")).drop("created_at", "updated_at")


STEP_ROWS = f"SELECT job_id AS plan_id, step AS step_id, max_by(status, (ts, event_id)) AS status FROM {{job_events}} WHERE step <> 'note' GROUP BY 1, 2"
EDGE_ROWS = "SELECT 'zoning' AS step_id, 'environment' AS depends_on UNION ALL SELECT 'merge', 'environment' UNION ALL SELECT 'merge', 'zoning' UNION ALL SELECT 'spatial', 'merge'"


@query("w02_step_dependencies", f"""
SELECT s.plan_id, s.step_id, s.status, coalesce(r.ready, TRUE) AS can_run, CASE WHEN p.f THEN 'failed' WHEN p.c THEN 'completed' WHEN p.s THEN 'running' ELSE 'pending' END AS plan_status
FROM ({STEP_ROWS}) s LEFT JOIN (SELECT p.plan_id, e.step_id, bool_and(coalesce(d.status = 'completed', FALSE)) AS ready FROM (SELECT DISTINCT job_id AS plan_id FROM {{job_events}}) p CROSS JOIN ({EDGE_ROWS}) e
  LEFT JOIN ({STEP_ROWS}) d ON d.plan_id = p.plan_id AND d.step_id = e.depends_on GROUP BY 1, 2) r ON r.plan_id = s.plan_id AND r.step_id = s.step_id
JOIN (SELECT plan_id, bool_or(status = 'failed') AS f, bool_and(status = 'completed') AS c, bool_or(status <> 'pending') AS s FROM ({STEP_ROWS}) x GROUP BY 1) p ON p.plan_id = s.plan_id""")
def _(d):
    events = d.view("job_events").filter("step <> 'note'")
    steps = events.groupBy(F.col("job_id").alias("plan_id"), F.col("step").alias("step_id")).agg(F.max_by("status", F.struct("ts", "event_id")).alias("status"))
    edges = d.sql(f"SELECT p.plan_id, e.step_id, e.depends_on FROM (SELECT DISTINCT job_id AS plan_id FROM {{job_events}}) p CROSS JOIN ({EDGE_ROWS}) e")
    return progress.dependency_states(steps, edges)


@query("w03_job_retention", f"""
SELECT job_id, status FROM ({STATES}) s WHERE created_at >= (SELECT max(created_at) FROM ({STATES}) t) - INTERVAL 24 HOURS""")
def _(d):
    jobs = progress.job_states(d.view("job_events"))
    newest = jobs.agg(F.max("created_at").alias("now"))
    return progress.retained_jobs(jobs.crossJoin(F.broadcast(newest)), F.col("now"), 24).select("job_id", "status")


@query("w04_session_runs", """
SELECT user_id AS session_id, min(ts) AS started, max(ts) AS last_seen, count(*) AS turns FROM (SELECT *, sum(CASE WHEN gap THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM (
  SELECT user_id, ts, event_id, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= INTERVAL 24 HOURS, TRUE) AS gap FROM {events}) a) b GROUP BY user_id, run""")
def _(d):
    return sessions.session_runs(d.table("events").withColumnRenamed("user_id", "session_id"))


@query("w04_live_sessions", """
WITH g AS (SELECT user_id, ts, event_id, event_type, coalesce(ts - lag(ts) OVER w >= INTERVAL 24 HOURS, TRUE) AS gap FROM {events} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
n AS (SELECT *, sum(CASE WHEN gap THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM g),
r AS (SELECT user_id, run, min(ts) AS started, max(ts) AS last_seen, count(*) AS turns, max_by(CASE WHEN event_type = 'view' THEN concat('APN-', cast(event_id AS string)) END, (ts, event_id)) FILTER (WHERE event_type = 'view') AS parcel
  FROM n GROUP BY user_id, run),
l AS (SELECT user_id, max(run) AS run FROM n GROUP BY user_id)
SELECT r.user_id AS session_id, started, last_seen, turns, parcel FROM r JOIN l ON l.user_id = r.user_id AND l.run = r.run WHERE last_seen >= (SELECT max(ts) FROM {events}) - INTERVAL 24 HOURS""")
def _(d):
    e = d.table("events").select(F.col("user_id").alias("session_id"), "ts", "event_id", F.when(F.col("event_type") == "view", F.concat(F.lit("APN-"), F.col("event_id"))).alias("parcel"))
    newest = e.agg(F.max("ts").alias("now"))
    return sessions.live_sessions(e, newest)


@query("w04_session_history", """
SELECT user_id AS session_id, event_id, cast(k AS int) AS from_last FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM {events}) q WHERE k <= 20""")
def _(d):
    return sessions.session_history(d.table("events").withColumnRenamed("user_id", "session_id")).select("session_id", "event_id", "from_last")


@query("w05_progress_timeline", """
SELECT job_id, event_id, step, cast(row_number() OVER w AS int) AS place, round((epoch_us(ts) - epoch_us(min(ts) OVER (PARTITION BY job_id))) / 1e6, 3) AS elapsed_seconds,
  round((epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1e6, 3) AS step_seconds FROM {job_events} WINDOW w AS (PARTITION BY job_id ORDER BY ts, event_id)""")
def _(d):
    return progress.timeline(d.view("job_events"))


@query("w06_event_protocol", """
SELECT conv_id AS query_id, 'final' AS event, string_agg(text, '' ORDER BY turn) AS body FROM {conversations} WHERE role = 'assistant' GROUP BY conv_id""")
def _(d):
    c = d.table("conversations")
    asked = c.filter("role = 'assistant'").groupBy(F.col("conv_id").alias("query_id")).agg(text.routes(F.min_by("text", "turn")).alias("tools"))
    spoken = c.filter("role = 'assistant'").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("place"), "text")
    return progress.protocol_rows(asked, spoken).filter("event = 'final'").select("query_id", "event", "body")


@query("w07_late_events", """
SELECT count(*) AS late FROM (SELECT ts, max(ts) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS seen FROM {events}) q WHERE ts < seen - INTERVAL 1 HOUR""")
def _(d):
    """How many events would arrive behind a one-hour watermark, by arrival order (event id)."""
    from lotweave.operators.prefix import running_max

    e = running_max(d.table("events").select("event_id", "ts", F.lit(0).alias("all")), ["all"], "event_id", "ts", "seen")
    return e.filter(F.col("ts") < F.col("seen") - F.expr("INTERVAL 1 HOUR")).agg(F.count("*").alias("late"))
