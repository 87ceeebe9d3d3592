"""FeatureCollections cut at every byte."""

import json

import pytest

from lotweave.sources import feature_collections as fc
from lotweave.sources.geojson import read_geojson

TRICKY = [
    {"type": "FeatureCollection", "name": 'x ] } { [ "features": [', "features": [
        {"type": "Feature", "id": 1, "properties": {"a": 'say "hi" {', "b": "back\\", "c": "é ]"}, "geometry": {"type": "Point", "coordinates": [1, 2]}},
        {"type": "Feature", "id": 2, "properties": {"features": [{"no": 1}, [{}]], "d": "\\\\\" }"}, "geometry": None}, {}, {"id": "z" * 50}],
     "after": {"features": [{"id": "no"}]}, "more": [{"id": "no"}]},
    {"features": []}, {"bbox": [[{"features": [1]}]], "features": [{"id": 9}]}, {"type": "Feature"}, [], "text",
]


def read(path, width):
    parts = fc.ranges(str(path), width)
    found = {(r.number, guess): (ends, closed, left) for r in parts for guess, ends, closed, left in fc.survey(r)}
    out = []
    for r, (in_string, depth, inside) in zip(parts, fc.starts(found, parts), strict=True):
        r.in_string, r.depth, r.inside = in_string, depth, inside
        out += [json.loads(text) for _, text in fc.cut_features(r)]
    return out


@pytest.mark.parametrize("piece", [1 << 20, 7])
@pytest.mark.parametrize("indent", [None, 1])
def test_every_range_width(tmp_path, monkeypatch, indent, piece):
    monkeypatch.setattr(fc, "READ_BYTES", piece)
    for k, whole in enumerate(TRICKY):
        path = tmp_path / f"{k}.json"
        path.write_text(json.dumps(whole, ensure_ascii=False, indent=indent))
        want = whole.get("features", []) if isinstance(whole, dict) else []
        for width in [*range(1, 40), 64, 101, 1 << 20]:
            assert read(path, width) == want, (k, width)


def test_reader_spreads_one_file(spark, tmp_path):
    features = [{"type": "Feature", "id": i, "properties": {"name": f'n{i} "{{['}, "geometry": {"type": "Point", "coordinates": [i, 0]}} for i in range(500)]
    (tmp_path / "layer.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    rows = fc.collection_rows(spark, str(tmp_path), 4096)
    assert rows.rdd.getNumPartitions() > 8 and [json.loads(r.value)["id"] for r in rows.orderBy("pos").collect()] == list(range(500))
    layer = read_geojson(spark, str(tmp_path), collection=True).orderBy("pos").collect()
    assert [r.feature_id for r in layer] == [str(i) for i in range(500)] and layer[7].props["name"] == 'n7 "{['
    empty = tmp_path / "none"
    empty.mkdir()
    assert fc.collection_rows(spark, str(empty)).count() == 0


def test_many_small_ranges_share_tasks(spark, tmp_path):
    """A task is not started for each range, and the reader that goes to every task holds no list of all ranges."""
    features = [{"type": "Feature", "id": i, "properties": {"name": f'n{i} "{{['}, "geometry": None} for i in range(900)]
    for k in range(3):
        (tmp_path / f"{k}.geojson").write_text(json.dumps({"features": features[300 * k:300 * k + 300]}))
    parts = fc.ranges(str(tmp_path), 64)
    assert len(parts) > 4 * fc.TASKS
    shared = fc.tasks_of(parts)
    assert fc.TASKS // 2 < len(shared) <= fc.TASKS and [r for t in shared for r in t.parts] == parts
    reader = fc._Reader({"path": str(tmp_path), "rangebytes": "64", "states": ";".join(["0,0,0"] * len(parts))})
    assert len(reader.partitions()) == len(shared) and not reader.states
    rows = fc.collection_rows(spark, str(tmp_path), 64)
    assert rows.rdd.getNumPartitions() == len(shared)
    assert [json.loads(r.value)["id"] for r in rows.orderBy("pos").collect()] == list(range(900))


def test_bytes_read_follow_the_range(tmp_path, monkeypatch):
    path = tmp_path / "layer.json"
    path.write_text(json.dumps({"features": [{"id": i} for i in range(2_000)]}))
    read_bytes = []
    plain = fc.chunks

    def counted(*args):
        for at, data in plain(*args):
            read_bytes.append(len(data))
            yield at, data

    monkeypatch.setattr(fc, "chunks", counted)
    assert [i["id"] for i in read(path, 500)] == list(range(2_000))
    assert sum(read_bytes) < 20 * path.stat().st_size  # both surveys and the read, with their context
