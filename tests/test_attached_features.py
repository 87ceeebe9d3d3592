"""Planning features of every feature, with and without id and centroid."""

import hashlib
import os

import pytest

from lotweave.operators import scoring
from lotweave.queries import QUERIES
from tools.check_oracles import check, connect

FOLDER = "/root/testdata/sf0.001"


def fallback(parcel, field, low, high):
    return low + (high - low) * (int(hashlib.sha256(f"{parcel}:{field}".encode()).hexdigest()[:8], 16) / 0xFFFFFFFF)


def test_features_without_id_and_with_centroid(spark):
    rows = [(0, None, {"centroid": '{"x": -117.5, "y": 32.25}', "aqi_mean": "40"}), (1, "F1", {}), (2, None, {"centroid": '{"x": 1}'})]
    got = scoring.attach_features(spark.createDataFrame(rows, "pos bigint, feature_id string, props map<string,string>")).collect()
    assert sorted(((r.parcel_id, r.lon, r.lat) for r in got), key=str) == sorted([(None, -117.5, 32.25), ("F1", None, None), (None, 1.0, None)], key=str)
    for r in got:
        assert r.soil_sand_pct == pytest.approx(fallback(r.parcel_id, "soil_sand_pct", 10.0, 80.0))
        assert r.aqi_mean == pytest.approx(40.0 if r.lon == -117.5 else fallback(r.parcel_id, "aqi_mean", 20.0, 150.0))


def test_query_returns_every_feature(spark):
    if not os.path.isdir(FOLDER):
        pytest.skip("driver tables not present")
    status, note, _ = check(spark, connect(FOLDER), FOLDER, "p11_attach_features")
    assert status == "ok", note
    rows = QUERIES["p11_attach_features"](spark, FOLDER)
    assert rows.count() == spark.read.parquet(f"{FOLDER}/customer.parquet").count() and rows.filter("parcel_id IS NULL").count() > 0
