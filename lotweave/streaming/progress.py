"""Job progress from step events, as batch or streaming aggregates.

Events: job_id, ts, event_id, step, status (pending, running, completed, failed, skipped).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotweave.functions import vocab
from lotweave.operators.prefix import carried, order_index

STEPS = tuple(s for s, _ in vocab.JOB_STEPS)


def _latest(step: str) -> Column:
    mine = F.col("step") == step
    order = F.when(mine, F.struct("ts", "event_id"))
    return F.coalesce(F.max_by(F.col("status"), order), F.lit("pending"))


def job_states(events: DataFrame, watermark: str | None = None) -> DataFrame:
    """Latest state per job: four step states, status, progress and stage.

    One aggregate, so the same call works on a stream; ``watermark`` then bounds how late an
    event may come.
    """
    source = events.withWatermark("ts", watermark) if watermark else events
    rows = source.filter(F.col("step").isin(*STEPS))
    states = rows.groupBy("job_id").agg(
        *[_latest(s).alias(s) for s in STEPS], F.max_by("step", F.struct("ts", "event_id")).alias("stage"),
        F.min("ts").alias("created_at"), F.max("ts").alias("updated_at"))
    done = [F.col(s).isin("completed", "skipped") for s in STEPS]
    failed = F.greatest(*[F.col(s) == "failed" for s in STEPS])
    finished = F.least(*done)
    progress = F.greatest(*[F.when(F.col(s) == "completed", F.lit(p)).otherwise(0) for s, p in vocab.JOB_STEPS])
    return states.select(
        "job_id", *STEPS,
        F.when(failed, "failed").when(finished, "completed").otherwise("running").alias("status"),
        F.when(finished & ~failed, 100).otherwise(progress).alias("progress"),
        F.when(finished & ~failed, "completed").otherwise(F.col("stage")).alias("stage"), "created_at", "updated_at")


def dependency_states(steps: DataFrame, edges: DataFrame) -> DataFrame:
    """Steps that may run (all dependencies completed) with their plan's status.

    ``steps``: plan_id, step_id, status; ``edges``: plan_id, step_id, depends_on.
    """
    needed = edges.join(steps.select("plan_id", F.col("step_id").alias("depends_on"), F.col("status").alias("_d")), ["plan_id", "depends_on"], "left")
    ready = needed.groupBy("plan_id", "step_id").agg(F.bool_and(F.coalesce(F.col("_d") == "completed", F.lit(False))).alias("_ready"))
    plan = steps.groupBy("plan_id").agg(
        F.bool_or(F.col("status") == "failed").alias("_f"), F.bool_and(F.col("status") == "completed").alias("_c"),
        F.bool_or(F.col("status") != "pending").alias("_s"))
    status = F.when(F.col("_f"), "failed").when(F.col("_c"), "completed").when(F.col("_s"), "running").otherwise("pending")
    return (steps.join(ready, ["plan_id", "step_id"], "left").join(plan.select("plan_id", status.alias("plan_status")), "plan_id")
            .select("plan_id", "step_id", "status", F.coalesce("_ready", F.lit(True)).alias("can_run"), "plan_status"))


def retained_jobs(jobs: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """Jobs young enough to keep."""
    return jobs.filter(F.col("created_at") >= now - F.expr(f"INTERVAL {hours} HOURS"))


def timeline(events: DataFrame) -> DataFrame:
    """Ordered events per job with seconds since the start and since the previous event.

    Events are cut into equal parts of a written order index, so a job with most of them spreads over all tasks.
    """
    rows = events.select("job_id", "event_id", "step", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.lit(1).alias("one"))
    start = rows.groupBy("job_id").agg(F.min("us").alias("start"))
    walk = ["job_id"], "us", ["event_id"]
    with_last = carried(order_index(rows, *walk), *walk, [("sum", "one", "place"), ("previous", "us", "before")]).join(start, "job_id")
    since = lambda c: F.round((F.col("us") - F.col(c)) / 1e6, 3)
    return with_last.select("job_id", "event_id", "step", F.col("place").cast("int").alias("place"), since("start").alias("elapsed_seconds"),
                            since("before").alias("step_seconds"))


def protocol_rows(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """Event rows of a query run: start, per-tool start and complete, text chunks, final.

    ``queries``: query_id, tools array; ``chunks``: query_id, place, text.
    """
    tools = queries.select("query_id", F.posexplode("tools").alias("i", "tool"))
    row = lambda df, seq, kind, body: df.select("query_id", seq.cast("bigint").alias("seq"), F.lit(kind).alias("event"), body.alias("body"))
    n = F.size("tools")
    final = chunks.groupBy("query_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("place", "text"))), lambda c: c["text"]), "").alias("text"))
    spoken = chunks.join(queries.select("query_id", n.alias("n")), "query_id")
    ends = queries.select("query_id", n.alias("n")).join(final, "query_id", "left")
    last = F.lit(1 << 40)
    return (row(queries, F.lit(0), "agent_start", F.lit("orchestrator"))
            .unionAll(row(queries, F.lit(1), "agent_complete", F.array_join("tools", ",")))
            .unionAll(row(tools, F.col("i") * 2 + 2, "agent_start", F.col("tool")))
            .unionAll(row(tools, F.col("i") * 2 + 3, "agent_complete", F.col("tool")))
            .unionAll(row(spoken, F.col("n") * 2 + 2 + F.col("place"), "text_chunk", F.col("text")))
            .unionAll(row(ends, last, "final", F.coalesce("text", F.lit("")))))
