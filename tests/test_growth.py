"""Steps that must not cost more than their rows: plans and results of the cheaper forms."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lotweave.functions import geometry as g
from lotweave.functions.coerce import collapse_first
from lotweave.operators import shapes
from lotweave.sources import geojson


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def round_ring(n, rnd, clockwise=False, closed=True):
    at = sorted(rnd.uniform(0, 2 * math.pi) for _ in range(n))
    pts = [(100 * math.cos(t), 60 * math.sin(t)) for t in at][::-1 if clockwise else 1]
    return pts + pts[:1] if closed else pts


def area(pts):
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(pts, pts[1:] + pts[:1], strict=True))) / 2


def test_buffers_of_mixed_rings_work_on_columns(spark):
    rnd = random.Random(5)
    rings = [round_ring(n, rnd, c, o) for n in (5, 6, 9, 30) for c in (False, True) for o in (False, True)]
    odd = [None, [], [[]], [[[]]], [[rings[0]], [rings[0]]], [[rings[0], rings[0]]], [[[(0.0, 0.0), (None, 1.0), (1.0, 1.0), (0.0, 0.0)]]]]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate([[[r]] for r in rings] + odd)], f"k bigint, geom {g.GEOM_TYPE}")
    rows = rows.withColumn("geom", g.unmercator(F.col("geom"))).coalesce(1)
    done, rejects = shapes.buffer_zones(rows, 10.0, steps=32, key="k")
    assert "MapInArrow" in executed(done) and "MapInPandas" not in executed(done)
    got = {r.k: [(p.x, p.y) for p in r.geom[0][0]] for r in done.collect()}
    assert sorted(got) == list(range(len(rings))) and sorted(r.k for r in rejects.collect()) == list(range(len(rings), len(rings) + len(odd)))
    for k, pts in got.items():
        ring = rings[k] if rings[k][0] != rings[k][-1] else rings[k][:-1]
        edge = sum(math.dist(a, b) for a, b in zip(ring, ring[1:] + ring[:1], strict=True))
        assert pts[0] == pts[-1]
        assert area(pts[:-1]) == pytest.approx(area(ring) + 10 * edge + math.pi * 100, rel=1e-3)


def test_centroids_neither_sort_nor_shuffle_properties(spark):
    square = [[[(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0), (0.0, 0.0)]]]
    far = [[[(500.0, 0.0), (501.0, 0.0), (501.0, 1.0), (500.0, 0.0)]]]
    ids = lambda a: {"APN": a} if a else {}
    rows = spark.createDataFrame([(3, ids("a"), square), (1, ids("a"), far), (2, ids("a"), square), (4, ids("b"), far), (5, ids(None), square), (None, ids("c"), square)],
                                 f"pos bigint, props map<string,string>, geom {g.GEOM_TYPE}")
    got = geojson.parcel_centroids(rows.withColumn("feature_id", F.lit(None).cast("string")))
    assert sorted((r.parcel_id, r.pos, r.lon, r.props) for r in got.collect()) == [("a", 2, 0.5, {"APN": "a"}), ("c", None, None, None)]
    slim = got.select("parcel_id", "lon", "lat")
    assert "SortAggregate" not in executed(slim) and "HashAggregate" in executed(slim)
    assert "map_filter" not in optimized(slim) and optimized(slim).count("radians") == 0


def test_first_rows_keep_their_columns_together(spark):
    rows = spark.createDataFrame([("a", 2, "x", 1.0), ("a", 1, None, 2.0), ("b", None, "y", 3.0), (None, 5, "z", None)], "k string, o int, t string, v double")
    want = {("a", 1, None, 2.0), ("b", None, None, None), (None, 5, "z", None)}
    assert {tuple(r) for r in collapse_first(rows, ["k"], "o").collect()} == want
    assert {tuple(r) for r in collapse_first(rows, ["k"], "o", F.col("v") > 1).collect()} == {("a", 1, None, 2.0), ("b", None, None, None)}


def test_feature_texts_are_cut_out_once(spark):
    rows = spark.createDataFrame([(1, "{}")], "pos bigint, value string").repartition(1)
    assert optimized(geojson.parse_features(rows)).count("get_json_object") == 5


def test_repair_of_a_long_ring(spark):
    """Repeated neighbours are found in one walk; the cleaned ring was made again for every corner."""
    n = 30_000
    ring = F.transform(F.sequence(F.lit(0), F.lit(2 * n - 1)), lambda i: F.struct(
        F.cos(F.floor(i / 2) * (2 * math.pi / n)).alias("x"), F.sin(F.floor(i / 2) * (2 * math.pi / n)).alias("y")))
    made = spark.range(1).select(g.repair(F.array(F.array(ring)), F.when(F.col("id") >= 0, "Polygon")).alias("geom"))
    assert made.select(F.size(g.vertices(F.col("geom"))).alias("n")).first().n == n + 1


def test_pipeline_stages_take_texts_in_small_batches(spark):
    import corpus_pipeline as cp
    import pyarrow as pa

    def rows(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.num_rows]})

    old = spark.conf.get(cp.ARROW_SETTING)
    try:
        for set_to, most in (("10000", cp.ARROW_ROWS), ("0", cp.ARROW_ROWS), ("300", 300)):
            spark.conf.set(cp.ARROW_SETTING, set_to)
            counts = [r.n for r in cp.in_small_batches(lambda s, d, p: d.mapInArrow(rows, "n bigint"))(spark, spark.range(0, 5_000, 1, 1), "").collect()]
            assert max(counts) == most and sum(counts) == 5_000
    finally:
        spark.conf.set(cp.ARROW_SETTING, old)


def test_order_indexes_hold_no_texts(spark, monkeypatch):
    """Pages and paragraphs are numbered without their texts, equal ones included; each gets its own number."""
    from lotweave.operators import corpus, prefix

    indexed, made = [], prefix.order_index
    monkeypatch.setattr(prefix, "order_index", lambda df, *rest: indexed.append(df.columns) or made(df, *rest))
    words = [f"{i} " + "w" * 700 for i in range(6)]
    docs = [("a", 1, words[0]), ("a", 1, words[0]), ("a", 1, words[1]), ("a", None, words[2]), ("b", 5, None), (None, 1, words[3]), (None, 1, words[3])]
    pages = geojson.regulation_pages(spark.createDataFrame(docs, "source string, page_id int, text string").repartition(3))
    got = sorted((r.source or "", r.page_num, r.text) for r in pages.collect())
    tied = {t for s, n, t in got if s == "a" and n > 1}
    assert [(s, n) for s, n, _ in got] == [("", 1), ("", 2), ("a", 1), ("a", 2), ("a", 3), ("a", 4), ("b", 1)]
    assert got[0][2] == got[1][2] == words[3] and got[2][2] == words[2] and tied == {words[0], words[1]} and got[-1][2] == ""
    assert [t for s, n, t in got if s == "a"].count(words[0]) == 2
    chunks = sorted((r.source, r.start_page, r.end_page, r.text.count("w" * 700)) for r in corpus.chunk_texts(pages).collect())
    assert chunks == [("a", 1, 3, 3), ("a", 3, 4, 1)]
    twice = spark.createDataFrame([("c", 1, words[4])] * 3, "source string, page_num int, text string")
    assert sorted(r.text.count("w" * 700) for r in corpus.chunk_texts(twice).collect()) == [0, 3]
    assert len(indexed) == 3 and not any({"text", "para"} & set(c) for c in indexed)
