"""Predicates, measures, cell joins and derived shapes against brute force."""

import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lotweave.functions import geometry as g
from lotweave.functions.rings import ring_crosses
from lotweave.operators import cells, shapes, spatial


def poly(*pts, holes=()):
    ring = lambda ps: [(float(x), float(y)) for x, y in (*ps, ps[0])]
    return [[ring(pts), *[ring(h) for h in holes]]]


def square(x, y, size=1.0):
    return poly((x, y), (x + size, y), (x + size, y + size), (x, y + size))


def frame(spark, shapes_):
    return spark.createDataFrame(list(enumerate(shapes_)), f"pos bigint, geom {g.GEOM_TYPE}")


L_SHAPE = poly((0, 0), (3, 0), (3, 1), (1, 1), (1, 3), (0, 3))
RING = poly((0, 0), (9, 0), (9, 9), (0, 9), holes=[((3, 3), (6, 3), (6, 6), (3, 6))])
CASES = [  # a, b, intersects, touches
    (square(0, 0), square(1, 0), True, True),
    (square(0, 0), square(1, 1), True, True),
    (square(0, 0), square(0.5, 0.5), True, False),
    (square(0, 0), square(0, 0), True, False),
    (square(0, 0, 3), square(1, 1), True, False),
    (square(0, 0), square(2, 2), False, False),
    (L_SHAPE, square(1, 1), True, True),
    (L_SHAPE, square(1.5, 1.5), False, False),
    (L_SHAPE, square(2, 0.5), True, False),
    (RING, square(4, 4), False, False),
    (RING, square(3, 3, 3), True, True),
    (RING, square(2, 2), True, False),
    (square(0, 0), [[[(0.5, 0.5)]]], True, False),
    (square(0, 0), [[[(-1.0, 0.5), (2.0, 0.5)]]], True, False),
    (poly((0, 0), (2, 2), (0, 4)), poly((2, 2), (4, 0), (4, 4)), True, True),
]


def test_predicates(spark):
    rows = spark.createDataFrame([(i, a, b) for i, (a, b, *_) in enumerate(CASES)], f"i int, a {g.GEOM_TYPE}, b {g.GEOM_TYPE}")
    got = rows.select("i", g.intersects(F.col("a"), F.col("b")).alias("x"), g.touches(F.col("a"), F.col("b")).alias("t"),
                      g.intersects(F.col("b"), F.col("a")).alias("y")).orderBy("i").collect()
    assert [(r.x, r.t) for r in got] == [(c[2], c[3]) for c in CASES]
    assert all(r.x == r.y for r in got)


def test_measures(spark):
    rows = frame(spark, [L_SHAPE, RING, [[[(0.0, 0.0), (4.0, 0.0)]]], [[[(2.0, 3.0)]]]])
    got = rows.select(g.planar_area(F.col("geom")).alias("a"), g.centroid(F.col("geom")).alias("c"), g.bounds(F.col("geom")).alias("b")).collect()
    assert [round(r.a, 9) for r in got] == [5.0, 72.0, 0.0, 0.0]
    assert got[1].c.x == pytest.approx(4.5) and got[2].c.x == pytest.approx(2.0) and (got[3].c.x, got[3].c.y) == (2.0, 3.0)
    assert got[0].c.x == pytest.approx((3 * 1.5 + 2 * 0.5) / 5)
    cap = frame(spark, [poly((0, 0), (1, 0), (1, 1), (0, 1))]).select(g.geodesic_area(F.col("geom"))).first()[0]
    assert cap == pytest.approx(12_308_778_361, rel=1e-4)  # one square degree at the equator on WGS84


def boxes(spark, n, seed, big=0.1):
    rnd = random.Random(seed)
    out = []
    for _ in range(n):
        size = rnd.uniform(20, 60) if rnd.random() < big else rnd.uniform(0.01, 2)
        # a third of all boxes crowd one corner
        x, y = (rnd.uniform(0, 1), rnd.uniform(0, 1)) if rnd.random() < 0.33 else (rnd.uniform(-50, 50), rnd.uniform(-50, 50))
        out.append(square(x, y, size))
    return out


def hits(a, b):
    (ax, ay), (ax1, ay1) = a[0][0][0], a[0][0][2]
    (bx, by), (bx1, by1) = b[0][0][0], b[0][0][2]
    return ax <= bx1 and bx <= ax1 and ay <= by1 and by <= ay1


@pytest.mark.parametrize("leaf", [2048, 5])
def test_box_pairs_match_brute_force(spark, monkeypatch, leaf):
    monkeypatch.setattr(cells, "LEAF", leaf)  # with 5, most cells are crowded
    a, b = boxes(spark, 150, 1), boxes(spark, 120, 2, big=0.3)
    left, right = spatial.with_box(frame(spark, a)), spatial.with_box(frame(spark, b))
    got = cells.box_pairs(left, right).select("l.pos", F.col("r.pos").alias("q")).collect()
    want = {(i, j) for i, s in enumerate(a) for j, t in enumerate(b) if hits(s, t)}
    assert len(got) == len(want) and {tuple(r) for r in got} == want


@pytest.mark.parametrize("leaf", [2048, 5])
def test_self_pairs_match_brute_force(spark, monkeypatch, leaf):
    monkeypatch.setattr(cells, "LEAF", leaf)  # with 5, most cells are crowded
    a = boxes(spark, 200, 3)
    got = cells.self_box_pairs(spatial.with_box(frame(spark, a)), "pos").select("l.pos", F.col("r.pos").alias("q")).collect()
    want = {(i, j) for i in range(200) for j in range(i + 1, 200) if hits(a[i], a[j])}
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_stacked_boxes(spark, monkeypatch):
    """Many shapes on one spot, which no quadtree can part."""
    monkeypatch.setattr(cells, "LEAF", 4)
    a = [[[[(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0), (0.0, 0.0)]]]] * 30 + boxes(spark, 20, 6)
    flat = spatial.with_box(frame(spark, a))
    got = cells.self_box_pairs(flat, "pos").select("l.pos", F.col("r.pos").alias("q")).collect()
    want = {(i, j) for i in range(50) for j in range(i + 1, 50) if hits(a[i], a[j])}
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_one_crowded_cell_is_spread(spark):
    """400,000 points of one cell against a few centres: more than 100 tasks, a bounded part each."""
    n = 400_000
    pts = spark.range(n).select(F.col("id").alias("pos"), (F.lit(0.0001) + (F.col("id") % 1000) * 2e-6).alias("lon"), (F.lit(0.0001) + F.floor(F.col("id") / 1000) * 5e-6).alias("lat"))
    centres = spark.createDataFrame([(k, 0.0003 * k, 0.0002 * k) for k in range(1, 6)], "pos bigint, lon double, lat double")
    before = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    for c, v in zip(before, ("400", "false", "-1"), strict=True):
        spark.conf.set(c, v)
    try:
        found = cells.radius_pairs(pts, centres, 600.0).withColumn("task", F.spark_partition_id())
        per = found.groupBy("task").agg(F.count_distinct("l.pos").alias("n")).collect()
        assert found.count() == 5 * n
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    assert len(per) > 100 and max(r.n for r in per) <= 8 * cells.LEAF


def haversine(a, b):
    p1, p2 = math.radians(a[1]), math.radians(b[1])
    h = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(math.radians(b[0] - a[0]) / 2) ** 2
    return 6_371_000 * 2 * math.atan2(math.sqrt(h), math.sqrt(1 - h))


@pytest.mark.parametrize("leaf", [2048, 5])
def test_radius_pairs_wrap_and_high_latitudes(spark, monkeypatch, leaf):
    monkeypatch.setattr(cells, "LEAF", leaf)  # with 5, most cells are crowded
    rnd = random.Random(5)
    pts = [(rnd.choice([179.99, -179.99, 0.0, 10.0]) + rnd.uniform(-0.008, 0.008), rnd.choice([0.0, 60.0, 89.9, -89.95]) + rnd.uniform(-0.04, 0.04)) for _ in range(160)]
    pts = [((x + 180) % 360 - 180, max(min(y, 90.0), -90.0)) for x, y in pts]
    df = spark.createDataFrame([(i, f"p{i}", x, y) for i, (x, y) in enumerate(pts)], "pos bigint, parcel_id string, lon double, lat double")
    got = {(r.a, r.b) for r in cells.radius_pairs(df, df, 3000.0).select(F.col("l.pos").alias("a"), F.col("r.pos").alias("b")).collect()}
    want = {(i, j) for i in range(160) for j in range(160) if haversine(pts[i], pts[j]) <= 3000.0}
    assert got == want


def test_radius_arguments(spark):
    df = spark.createDataFrame([(0, "a", 0.0, 0.0)], "pos bigint, parcel_id string, lon double, lat double")
    assert spatial.neighbour_pairs(df, 0).count() == 0 and spatial.neighbour_pairs(df, None).count() == 0
    with pytest.raises(ValueError):
        spatial.nearby(df, df, 9000)


def test_missing_geometry_has_no_edges(spark):
    rows = spark.createDataFrame([(0, square(0, 0)), (1, None), (2, None), (3, square(1, 0))], f"pos bigint, geom {g.GEOM_TYPE}")
    assert [tuple(r) for r in spatial.adjacency(rows).collect()] == [(0, 3)]
    assert [tuple(r) for r in spatial.adjacency(rows, "intersects").collect()] == [(0, 3)]


def metric(spark, pts_shapes):
    """Shapes near the origin, given in metres."""
    df = spark.createDataFrame([(f"p{i}", s) for i, s in enumerate(pts_shapes)], f"parcel_id string, geom {g.GEOM_TYPE}")
    return df.withColumn("geom", g.unmercator(F.col("geom")))


def test_buffers_and_subdivision(spark):
    rows = metric(spark, [square(0, 0, 100), L_SHAPE])
    done, rejects = shapes.buffer_zones(rows, 10.0, steps=64)
    area = done.select(g.planar_area(F.col("geom"))).first()[0]
    assert area == pytest.approx(100 * 100 + 4 * 100 * 10 + math.pi * 100, rel=1e-3)
    assert [r.parcel_id for r in rejects.collect()] == ["p1"]
    cut = shapes.subdivide(metric(spark, [poly((0, 0), (100, 0), (0, 100))]), 1000.0, 100.0).collect()
    assert sum(r.area for r in cut) == pytest.approx(5000, rel=1e-6) and all(r.area >= 100 for r in cut)
    with pytest.raises(ValueError):
        shapes.subdivide(rows, 10.0, 20.0)


def test_voronoi_matches_nearest_point_areas(spark):
    rnd = random.Random(7)
    pts = [(rnd.uniform(0, 40), rnd.uniform(0, 40)) if i % 3 else (rnd.uniform(900, 1000), rnd.uniform(0, 1000)) for i in range(120)]
    rows = metric(spark, [square(x, y, 0.5) for x, y in pts])
    got = {r.parcel_id: r.area for r in shapes.voronoi(rows, per_tile=4, most=8).collect()}
    whole = {r.parcel_id: r.area for r in shapes.voronoi(rows, per_tile=10_000, most=10_000).collect()}
    assert len(got) == 120 and got.keys() == whole.keys()
    assert all(got[k] == pytest.approx(whole[k], rel=1e-6, abs=1e-6) for k in got)
    xs, ys = [x for x, _ in pts], [y for _, y in pts]
    total = (max(xs) + 0.5 - min(xs)) * (max(ys) + 0.5 - min(ys))
    assert sum(got.values()) == pytest.approx(total, rel=1e-6)


def brute_crossing(points):
    turn = lambda a, b, p: (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])
    edges = list(zip(points[:-1], points[1:], strict=True))
    return any(turn(*e, f[0]) * turn(*e, f[1]) < 0 and turn(*f, e[0]) * turn(*f, e[1]) < 0 for i, e in enumerate(edges) for f in edges[i + 1:])


def star(n, rnd, wobble=0.0):
    pts = [(math.cos(2 * math.pi * (i + wobble * rnd.random()) / n) * (r := 1 + rnd.random()), math.sin(2 * math.pi * i / n) * r) for i in range(n)]
    return [*pts, pts[0]]


def test_large_rings_cross_like_all_pairs():
    rnd = random.Random(5)
    seen = set()
    for n in (3, 70, 150, 300):
        for wobble in (0.0, 0.5, 3.0):
            ring = star(n, rnd, wobble)
            seen.add(want := brute_crossing(ring))
            assert ring_crosses(np.array(ring)) == want, (n, wobble)
    assert seen == {True, False}
    grid = [(float(i % 2 * 50), float(i)) for i in range(200)]  # long edges side by side
    assert not ring_crosses(np.array([*grid, (60.0, 200.0), (60.0, -1.0), grid[0]]))
    assert ring_crosses(np.array([*grid, (25.0, -1.0), grid[0]]))


def test_ring_of_a_hundred_thousand_corners(spark):
    ring = star(100_000, random.Random(1))
    bad = [*ring[:50_000], (0.0, 9.0), *ring[50_000:]]
    begin = time.time()
    assert not ring_crosses(np.array(ring)) and ring_crosses(np.array(bad))
    assert time.time() - begin < 30
    small = poly((0, 0), (1, 1), (1, 0), (0, 1))
    shapes_ = [[[ring]], [[bad]], square(0, 0), small, [[star(90, random.Random(2)), small[0][0]]]]
    df = frame(spark, shapes_)
    got = {r.pos: r.bad for r in df.select("pos", g.self_crossing(F.col("geom"), F.lit("Polygon")).alias("bad")).collect()}
    assert got == {0: False, 1: True, 2: False, 3: True, 4: True}
    assert not df.filter(g.self_crossing(F.col("geom"), F.lit("LineString"))).count()
