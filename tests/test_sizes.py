"""Work that has to be spread over tasks, and sides that must not be collected on the driver."""

import pytest
from pyspark.sql import functions as F

from lotweave.functions import landuse
from lotweave.functions.coerce import Fields
from lotweave.operators import cells, shapes
from lotweave.queries import views


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def one_file(spark, tmp_path_factory):
    """12,288 customers in one file, one of them without a key and two with the same one."""
    folder = str(tmp_path_factory.mktemp("one-file"))
    rows = spark.range(12_288).select(
        F.when(F.col("id") > 0, F.greatest(F.col("id"), F.lit(2))).alias("c_custkey"), (F.col("id") % 25).cast("int").alias("c_nationkey"),
        (F.col("id") % 9000).cast("double").alias("c_acctbal"), F.lit("BUILDING").alias("c_mktsegment"))
    rows.coalesce(1).write.parquet(f"{folder}/customer.parquet")
    return folder


def test_rows_of_one_file_are_dealt_to_several_tasks(spark, one_file):
    lots = views.Data(spark, one_file).view("lots")
    per_task = lots.groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert len(per_task) >= 3 and max(r["count"] for r in per_task) <= 2 * views.ROWS_A_TASK
    assert sum(r["count"] for r in per_task) == 12_288
    assert lots.filter("pos is null").count() == 1 and lots.filter("pos = 2").count() == 2


def test_large_sides_of_a_radius_join_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(cells, "FEW_SHAPES", 10, raising=False)
    points = spark.range(60).select(F.col("id").alias("pos"), (F.col("id") % 10 / 1000).alias("lon"), (F.floor(F.col("id") / 10) / 1000).alias("lat"))
    pairs = cells.radius_pairs(points, points, 120.0)
    assert "BroadcastHashJoin" not in plan(pairs)
    # the lattice step is 111 m: every point with itself and its neighbours in a row or column
    assert pairs.count() == 60 + 2 * (9 * 6 + 10 * 5)
    few = points.limit(3)
    assert "BroadcastHashJoin" in plan(cells.radius_pairs(few, points, 120.0))


def test_blocks_of_cells_make_up_a_large_parcel(spark):
    side = 0.01
    geom = [[[(0.0, 0.0), (side, 0.0), (side, side), (0.0, side), (0.0, 0.0)], [(0.001, 0.001), (0.002, 0.001), (0.002, 0.002), (0.001, 0.002), (0.001, 0.001)]]]
    rows = spark.createDataFrame([("a", geom), ("b", None)], f"parcel_id string, geom {shapes.POLYGON}")
    got = shapes.subdivide(rows, 1000.0, 100.0)
    pieces = got.collect()
    whole = shapes.g.planar_area(shapes.g.mercator(F.col("geom")))
    assert len(pieces) > 4 * shapes.CELLS
    assert len({p.subdivision_id for p in pieces}) == len(pieces)
    lost = rows.select(whole).first()[0] - sum(p.area for p in pieces)
    assert 0 <= lost < 100.0 * 50  # only slivers beside the hole are left out
    assert all(r[0] == pytest.approx(r[1], rel=1e-9) for r in got.select("area", shapes.g.planar_area(F.col("geom"))).collect())


def test_allowed_uses_split_each_text_once(spark):
    rows = [(1, {"ZONING_CODE": "mixed-use"}), (2, {"allowed_uses": "park; retail"}), (3, {"ALLOWED_USES": "Mixed"}), (4, {"zoning": "RS-1-7"}), (5, {}), (6, None)]
    df = spark.createDataFrame(rows, "pos bigint, props map<string,string>")
    f = Fields(df)
    for rule, texts in ((landuse.comparison_allowed_uses, 3), (landuse.report_allowed_uses, 5)):
        out = df.select("pos", rule(f).alias("u"))
        assert plan(out).count("split(") <= 2 * texts
    comparison, report = ({r.pos: r.u for r in df.select("pos", rule(f).alias("u")).collect()} for rule in (landuse.comparison_allowed_uses, landuse.report_allowed_uses))
    assert comparison[2] == ["commercial", "green"] and comparison[3] == ["residential", "commercial"] and comparison[5] is None and comparison[6] is None
    assert comparison[1] == ["residential", "commercial"] == report[1]


def test_filters_of_rules_stay_above_the_dealing(spark, one_file):
    lots = views.Data(spark, one_file).view("lots")
    kept = lots.filter("regexp_replace(parcel_id, '[0-9]', 'x') <> ''").select("pos", F.spark_partition_id().alias("task"))
    assert "RoundRobinPartitioning" not in plan(kept) and kept.select("task").distinct().count() >= 3
