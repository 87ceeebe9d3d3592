"""Chat session state: latest parcel context, capped history, expiry.

The clock is event time: a session ends 24 hours after its last event, and events later than
the watermark are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lotweave.operators.ranking import top_k

HISTORY = 20
TTL_HOURS = 24


def session_runs(events: DataFrame, ttl_hours: int = TTL_HOURS) -> DataFrame:
    """(session_id, start, end, turns) runs whose events follow each other within the expiry time."""
    w = F.session_window("ts", f"{ttl_hours} hours")
    return events.groupBy("session_id", w).agg(F.count("*").alias("turns"), F.max("ts").alias("last_seen")).select(
        "session_id", F.col("session_window.start").alias("started"), "last_seen", "turns")


def live_sessions(events: DataFrame, now, ttl_hours: int = TTL_HOURS) -> DataFrame:
    """Batch form: the run of each session that is still alive at the one-row table ``now`` (column ``now``).

    Parcel context is the last one set inside the run.
    """
    runs = session_runs(events, ttl_hours)
    latest = runs.groupBy("session_id").agg(F.max_by(F.struct("started", "last_seen", "turns"), "last_seen").alias("r")).select("session_id", "r.*")
    alive = latest.crossJoin(F.broadcast(now)).filter(F.col("last_seen") >= F.col("now") - F.expr(f"INTERVAL {ttl_hours} HOURS")).drop("now")
    inside = events.join(alive.select("session_id", "started"), "session_id").filter(F.col("ts") >= F.col("started"))
    context = inside.filter(F.col("parcel").isNotNull()).groupBy("session_id").agg(F.max_by("parcel", F.struct("ts", "event_id")).alias("parcel"))
    return alive.join(context, "session_id", "left")


def session_history(events: DataFrame, keep: int = HISTORY) -> DataFrame:
    """Last ``keep`` turns per session."""
    return top_k(events, ["session_id"], [F.desc("ts"), F.desc("event_id")], keep, "from_last")


OUTPUT = "parcel string, turns long, history array<string>, last_seen timestamp, expired boolean"
STATE = "parcel string, turns long, history array<string>, last_ms long"


def _step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState, keep: int, ttl_ms: int) -> Iterator[pd.DataFrame]:
    parcel, turns, history, last = state.get if state.exists else (None, 0, [], 0)
    history = list(history)
    if state.hasTimedOut:
        state.remove()
        expired = True
    else:
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        for ts, place, text in zip(rows["ts"], rows["parcel"], rows["text"]):
            now = int(ts.timestamp() * 1000)
            if last and now - last > ttl_ms:
                parcel, turns, history = None, 0, []
            parcel = place if isinstance(place, str) else parcel
            turns, last = turns + 1, max(last, now)
            history = (history + [text])[-keep:]
        state.update((parcel, turns, history, last))
        state.setTimeoutTimestamp(max(last + ttl_ms, state.getCurrentWatermarkMs() + 1))
        expired = False
    yield pd.DataFrame({"session_id": [key[0]], "parcel": [parcel], "turns": [turns], "history": [history],
                        "last_seen": [pd.Timestamp(last, unit="ms")], "expired": [expired]})


def session_stream(events: DataFrame, watermark: str = "1 hour", keep: int = HISTORY, ttl_hours: int = TTL_HOURS) -> DataFrame:
    """Streaming form: keyed state per session, history capped, removed when the expiry time passes.

    ``events`` is a stream of (session_id, ts, event_id, parcel, text).
    """
    def step(key, batches, state):
        return _step(key, batches, state, keep, ttl_hours * 3_600_000)

    kind = events.schema["session_id"].dataType.simpleString()
    return events.withWatermark("ts", watermark).groupBy("session_id").applyInPandasWithState(
        step, f"session_id {kind}, {OUTPUT}", STATE, "update", GroupStateTimeout.EventTimeTimeout)


def write_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Start writing a stream to one parquet folder per batch until the input is used up.

    A batch that runs again replaces its own folder, so retries leave no duplicates.
    """
    def save(df: DataFrame, epoch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(save).start()
