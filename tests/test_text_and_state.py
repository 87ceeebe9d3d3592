"""Corpus, retrieval, merges, job and session state, streams."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lotweave.operators import corpus, prefix, zoning
from lotweave.plans import jobs
from lotweave.sources import geojson, sinks
from lotweave.streaming import progress, sessions


def fold_chunks(pages):
    """The chunk rule as a plain loop over one document."""
    out, buf, start = [], "", 1
    for page, paras in pages:
        for p in paras:
            p = p.strip()
            if len(p) < 50:
                continue
            buf = buf + "\n\n" + p if buf else p
            if len(buf) >= 1500:
                out.append((start, page, buf))
                buf, start = buf[-300:], page
    if buf and len(buf) >= 100:
        out.append((start, pages[-1][0], buf))
    return out


@pytest.mark.parametrize("block", [1 << 26, 3000, 700])
def test_chunks_match_the_fold(spark, block):
    rnd = random.Random(11)
    docs = {f"doc{d}.pdf": [(n + 1, ["w" * rnd.randint(10, 900) + str(rnd.random()) for _ in range(rnd.randint(0, 6))]) for n in range(rnd.choice([1, 2, 30]))] for d in range(12)}
    docs["short.pdf"] = [(1, ["x" * 60])]
    docs["exact.pdf"] = [(1, ["y" * 1500])]
    rows = [(s, n, "\n\n".join(ps)) for s, pages in docs.items() for n, ps in pages]
    df = spark.createDataFrame(rows, "source string, page_num int, text string")
    got = sorted(tuple(r) for r in corpus.chunk_texts(df, block_chars=block).select("source", "start_page", "end_page", "text").collect())
    want = sorted((s, *c) for s, pages in docs.items() for c in fold_chunks(pages))
    assert got == want


def test_blocks_of_a_batch_are_walked_together():
    """Batches that cut blocks and documents anywhere give the same closes as a plain walk, in one frame per batch."""
    rnd = random.Random(4)
    rows, want = [], {}
    for name in ("a", "b", "c"):
        s, at = 0, 302
        for _ in range(400):
            s += rnd.randint(52, 900)
            rows.append((name, s // 2500, s))
            want[name, s] = at
            at = s if s >= at + 1200 else at
    pdf = pd.DataFrame(rows, columns=["source", "block", "s"])
    for size in (1, 7, 10_000):
        batches = lambda df: (df.iloc[i:i + size].reset_index(drop=True) for i in range(0, len(df), size))
        found = list(corpus._block_exits(1200, 302, 2500)(batches(pdf)))
        exits = pd.concat(found)
        entered = pd.concat(corpus._chain(1200, 302)(batches(exits)))
        got = pd.concat(corpus._assign(1200, 2500)(batches(pdf.merge(entered, on=["source", "block"]))))
        assert {(r.source, r.s): r.opened for r in got.itertuples()} == want and len(got) == len(rows)
    assert len(found) <= 2  # hundreds of blocks


def test_blocks_stay_whole_after_a_join_on_their_keys(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # a merge, whose dealing an equal one would repeat
    try:
        marks = spark.range(100).selectExpr("'a' AS source", "id DIV 10 AS block", "id AS s")
        entered = spark.range(10).selectExpr("'a' AS source", "id AS block", "0L AS entered")
        rows = corpus._in_order(marks.join(entered, ["source", "block"]), ["source", "block"], ["source", "block", "s"])
        assert "REPARTITION_BY_COL" in rows._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_section_marks_stay_with_the_text_before(spark):
    df = spark.createDataFrame([("Intro text §1310 rest Section 42001 tail",), ("a\n\nb",)], "t string")
    a, b = df.select(corpus.split_sections(F.col("t")).alias("p")).collect()
    assert a.p == ["Intro text §1310", " rest Section 4200", "1 tail"] or a.p[0] == "Intro text §1310"
    assert b.p == ["a", "b"]


def test_diversity_pick():
    v = np.array([[1, 0], [0.99, 0.01], [0, 1.0]])
    v = v / np.linalg.norm(v, axis=1, keepdims=True)
    assert corpus.pick_diverse(np.array([0.95, 0.90, 0.70]), v @ v.T, 2, 0.4) == [0, 2]


def test_search_prunes_rings_and_stays_exact(spark, monkeypatch):
    """Tight groups, a third of all chunks in one; zero and null vectors; a jurisdiction that no chunk has."""
    monkeypatch.setattr(corpus, "BLOCK_ROWS", 40)
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(9, 8)) * 10
    own = np.where(np.arange(1200) % 3 == 0, 0, rng.integers(0, 9, 1200))
    vecs = centres[own] + rng.normal(size=(1200, 8)) * 0.05
    vecs[[5, 77]] = 0.0
    qs = centres[np.arange(12) % 9] + rng.normal(size=(12, 8)) * 0.05
    qs[11] = 0.0
    store = spark.createDataFrame([(i, v.tolist(), "a" if i % 2 else None) for i, v in enumerate(vecs)] + [(5000, None, "a")], "chunk_id bigint, embedding array<double>, jurisdiction string")
    questions = spark.createDataFrame([(i, q.tolist(), "a" if i % 4 == 0 else None) for i, q in enumerate(qs)] + [(90, None, None), (91, qs[0].tolist(), "nowhere")],
                                      "query_id int, embedding array<double>, jurisdiction string")
    for metric in ("l2", "cosine"):
        got = {}
        for r in corpus.nearest_chunks(questions, store, 7, metric).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(round(r.distance, 9))
        assert sorted(got) == list(range(12))
        for i, q in enumerate(qs):
            d = ((vecs - q) ** 2).sum(axis=1) if metric == "l2" else 1 - vecs @ q / (np.linalg.norm(vecs, axis=1) * np.linalg.norm(q) + 1e-12)
            want = sorted(x for j, x in enumerate(d) if i % 4 or j % 2)[:7]
            assert np.allclose(got[i], want, atol=1e-9), (metric, i)
        index, pivots = corpus.pivot_index(store, metric)
        rings = index.select("bucket", "ring").distinct().count()
        asked = questions.filter("query_id < 11")
        assert len(pivots) > 20 and corpus.needed_rings(asked, index, pivots, 7, metric).count() < 0.5 * rings * asked.count()
    assert corpus.nearest_chunks(questions, store.limit(0), 3).count() == 0 and corpus.nearest_chunks(questions.limit(0), store, 3).count() == 0


def test_nearest_matches_brute_force_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(corpus, "QUERY_BLOCK", 3)
    rng = np.random.default_rng(4)
    vecs, qs = rng.normal(size=(200, 8)), rng.normal(size=(10, 8))
    place = ["north" if i % 2 else "south" for i in range(200)]
    store = spark.createDataFrame(pd.DataFrame({"chunk_id": [f"c{i:03d}" for i in range(200)], "embedding": list(vecs.tolist()), "jurisdiction": place}))
    questions = spark.createDataFrame([(i, q.tolist(), "north" if i % 3 == 0 else None) for i, q in enumerate(qs)], "query_id int, embedding array<double>, jurisdiction string")
    got = corpus.nearest_chunks(questions, store, 5).orderBy("query_id", "rank").collect()
    for i, q in enumerate(qs):
        d = ((vecs - q) ** 2).sum(axis=1)
        order = [j for j in np.argsort(d) if i % 3 or place[j] == "north"][:5]
        assert [r.chunk_id for r in got if r.query_id == i] == [f"c{j:03d}" for j in order]


def test_zone_preference_falls_back(spark):
    hits = spark.createDataFrame([(1, "a", "Residential", "Residential"), (1, "b", "", "Residential"), (2, "c", "", "Residential"), (3, "d", "x", None)],
                                 "query_id int, chunk_id string, zone_categories string, zone_filter string")
    assert sorted(r.chunk_id for r in corpus.prefer_zone(hits).collect()) == ["a", "c", "d"]


@pytest.mark.parametrize("parts", [1, 3, 50])
def test_running_numbers_over_parts(spark, parts):
    rows = [(k, i, i % 5) for k in "ab" for i in range(0, 40, 3)]
    df = spark.createDataFrame(rows, "k string, i int, v int")
    got = {(r.k, r.i): (r.n, r.s) for r in prefix.running_sum(prefix.running_number(df, ["k"], "i", "n", parts=parts), ["k"], "i", "v", "s", parts=parts).collect()}
    for k in "ab":
        total = 0
        for n, i in enumerate(range(0, 40, 3), 1):
            total += i % 5
            assert got[(k, i)] == (n, total)


def test_one_key_spreads_over_all_parts_and_carries_across(spark):
    """Crowded order values, ties, nulls in value, key and order, names that clash with none."""
    rows = [("hot", i // 3 if i < 2900 else 10 ** 12, i, None if i % 7 == 0 else i % 11, {"a": i}) for i in range(3000)]
    rows += [(None, 1, 1, 5, {}), (None, 2, 2, 6, {}), ("x", None, 1, 4, {}), ("x", 0, 2, None, {})]
    df = spark.createDataFrame(rows, "k string, o bigint, t bigint, v bigint, m map<string,bigint>")
    index = prefix.order_index(df, ["k"], "o", ["t"], parts=12)
    sizes = {r["_part"]: r["count"] for r in index.filter("k = 'hot'").groupBy("_part").count().collect()}
    assert len(sizes) >= 10 and max(sizes.values()) <= 600
    outs = [("sum", "v", "s"), ("max", "v", "top"), ("previous", "v", "last")]
    got = {(r.k, r.o, r.t): (r.s, r.top, r.last) for r in prefix.carried(index, ["k"], "o", ["t"], outs).collect()}
    assert len(got) == len(rows)
    for key in ("hot", None, "x"):
        total, top, last = 0, None, None
        for _, o, t, v, _ in sorted((r for r in rows if r[0] == key), key=lambda r: (r[1] is not None, r[1] or 0, r[2])):
            total += v or 0
            top = v if top is None else top if v is None else max(top, v)
            assert got[(key, o, t)] == (total, top, last)
            last = v
    assert prefix.running_max(df.limit(0), ["k"], "o", "v", "top").count() == 0


def test_merge_keeps_rows_and_skips_repeated_and_null_keys(spark):
    env = spark.createDataFrame([(0, " A1 ", 1.0), (1, "A2", 2.0), (2, None, 3.0)], "pos int, APN string, score double")
    z = spark.createDataFrame([("A1", "RS", 9.0), ("A2", "x", 8.0), ("A2 ", "y", 7.0), (None, "n", 6.0)], "APN string, ZONING_CODE string, score double")
    got = {r.pos: (r.ZONING_CODE, r.score, r.score_zoning) for r in zoning.merge_zoning(env, z).collect()}
    assert got == {0: ("RS", 1.0, 9.0), 1: (None, 2.0, None), 2: (None, 3.0, None)}
    merged = jobs.merge_stages(spark.createDataFrame([("p", 0.1, 0.2, 0.3, 0.4, 0.5)], "parcel_id string, residential double, commercial double, industrial double, green double, environmental_risk double"),
                               spark.createDataFrame([("q", 2, ["r1", "r2"])], "parcel_id string, regulations_found int, regulations array<string>"))
    got = {r.parcel_id: (r.green, r.regulations_found, r.regulations) for r in merged.collect()}
    assert got == {"p": (0.4, 0, []), "q": (0.0, 2, ["r1", "r2"])}


def test_geojson_round_trip_and_collection(spark, tmp_path):
    path = str(tmp_path / "fc")
    (tmp_path / "fc").mkdir()
    (tmp_path / "fc" / "a.geojson").write_text('{"type":"FeatureCollection","features":[{"type":"Feature","id":"x","properties":{"APN":" 7 ","xgb_risk_score":40},'
                                               '"geometry":{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,1],[0,0]]]}},{"type":"Feature","properties":{"apn":"8","rule_risk_score":60},"geometry":null}]}')
    rows = geojson.read_geojson(spark, path, collection=True)
    assert sorted(tuple(r) for r in geojson.risk_table(rows).collect()) == [("7", 40.0), ("8", 60.0)]
    assert geojson.centroid_quality(rows).first().usable == 1
    out = str(tmp_path / "out")
    sinks.as_features(rows.filter("feature_id = 'x'").select("feature_id", "geom"), "feature_id").write.text(out)
    assert geojson.read_geojson(spark, out).first().feature_id == "x"
    assert geojson.load_layer(spark, str(tmp_path / "none")).count() == 0


EVENTS = "job_id int, event_id int, ts timestamp, step string, status string"


def job_events(spark):
    t = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    rows = [(1, 1, t(0), "environment", "running"), (1, 2, t(1), "environment", "completed"), (1, 3, t(2), "zoning", "failed"),
            (2, 4, t(0), "environment", "completed"), (2, 5, t(1), "zoning", "completed"), (2, 6, t(2), "merge", "completed"), (2, 7, t(3), "spatial", "skipped"),
            (3, 8, t(4), "environment", "running"), (3, 9, t(5), "other", "failed")]
    return spark.createDataFrame(rows, EVENTS)


def test_job_states_batch_and_stream_agree(spark, tmp_path):
    batch = {r.job_id: (r.status, r.progress, r.stage) for r in progress.job_states(job_events(spark)).collect()}
    assert batch == {1: ("failed", 30, "zoning"), 2: ("completed", 100, "completed"), 3: ("running", 0, "environment")}
    src = str(tmp_path / "events")
    job_events(spark).filter("event_id <= 5").coalesce(1).write.parquet(src)
    job_events(spark).filter("event_id > 5").coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(src)
    query = sessions.write_table(progress.job_states(stream, "1 hour"), str(tmp_path / "out"), str(tmp_path / "ck"), "update")
    query.awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out"))
    last = rows.groupBy("job_id").agg(F.max_by(F.struct("status", "progress", "stage"), "epoch").alias("s")).select("job_id", "s.*")
    assert {r.job_id: (r.status, r.progress, r.stage) for r in last.collect()} == batch


def test_retention_drops_old_jobs_only(spark):
    rows = [(1, "2024-01-01 00:00:00", "running"), (2, "2024-01-03 00:00:00", "completed"), (3, "2024-01-03 01:00:00", "running"), (4, "2024-01-03 02:00:00", "running")]
    df = spark.createDataFrame(rows, "job_id int, created_at string, status string").withColumn("created_at", F.col("created_at").cast("timestamp"))
    kept = progress.retained_jobs(df, F.lit("2024-01-03 03:00:00").cast("timestamp"))
    assert sorted(r.job_id for r in kept.collect()) == [2, 3, 4]


def test_step_dependencies(spark):
    steps = spark.createDataFrame([(1, "a", "completed"), (1, "b", "pending"), (1, "c", "pending")], "plan_id int, step_id string, status string")
    edges = spark.createDataFrame([(1, "b", "a"), (1, "c", "a"), (1, "c", "b")], "plan_id int, step_id string, depends_on string")
    got = {r.step_id: (r.can_run, r.plan_status) for r in progress.dependency_states(steps, edges).collect()}
    assert got == {"a": (True, "running"), "b": (True, "running"), "c": (False, "running")}


SESSIONS = "session_id int, ts timestamp, event_id int, parcel string, text string"


def test_session_stream_caps_history_and_expires(spark, tmp_path):
    t = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    first = [(1, t(i / 60), i, "A" if i == 0 else None, f"q{i}") for i in range(25)] + [(2, t(0.5), 50, "B", "hello")]
    later = [(3, t(60), 90, None, "late start")]
    last = [(3, t(61), 91, None, "more")]
    src = str(tmp_path / "turns")
    for part in (first, later, last):
        spark.createDataFrame(part, SESSIONS).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(SESSIONS).option("maxFilesPerTrigger", 1).parquet(src)
    query = sessions.write_table(sessions.session_stream(stream), str(tmp_path / "out"), str(tmp_path / "ck"), "update")
    query.awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    one = [r for r in rows if r.session_id == 1 and not r.expired]
    assert one[-1].turns == 25 and one[-1].parcel == "A" and list(one[-1].history) == [f"q{i}" for i in range(5, 25)]
    assert {r.session_id for r in rows if r.expired} >= {1, 2} and not any(r.session_id == 3 and r.expired for r in rows)


def test_live_sessions_and_runs(spark):
    t = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    rows = [(1, t(0), 1, "A", ""), (1, t(30), 2, None, ""), (1, t(31), 3, "B", ""), (2, t(2), 4, "C", "")]
    df = spark.createDataFrame(rows, SESSIONS)
    assert sorted(r.turns for r in sessions.session_runs(df).collect()) == [1, 1, 2]
    live = sessions.live_sessions(df, spark.createDataFrame([(t(32),)], "now timestamp"))
    assert [(r.session_id, r.parcel, r.turns) for r in live.collect()] == [(1, "B", 2)]
