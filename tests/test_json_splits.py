"""Feature collections read in splits against the document parsed whole."""

import json

import pytest

from headwater.sources import json_splits as J
from headwater.sources.geojson import read_geojson


def write(path, document, **more):
    path.write_text(json.dumps(document, **more), encoding="utf-8")
    return str(path)


def features(n):
    odd = ['plain', 'with } and { and [ ]', 'quote " and \\ backslash \\" }', "ünï 日本", ""]
    out = []
    for k in range(n):
        ring = [[k, 0], [k + 1, 0], [k + 1, 1], [k, 0]]
        kind = {"type": "Polygon", "coordinates": [ring] * (1 + k % 3)} if k % 4 else {"type": "MultiPolygon", "coordinates": [[ring], [ring]]}
        out.append({"type": "Feature", "id": k, "properties": {"name": odd[k % 5], "nested": {"a": [1, {"b": "}"}]}, odd[k % 4] + "k": None}, "geometry": kind})
    return out


@pytest.mark.parametrize("size", [300, 1 << 27])
@pytest.mark.parametrize("indent", [None, 2])
def test_any_split_gives_the_same_features(spark, tmp_path, size, indent):
    document = {"type": "FeatureCollection", "name": "a } \" features", "meta": {"x": {"y": [1, {"z": 2}]}, "list": [{"q": {}}]}, "features": features(23), "bbox": [0, 0, 1, 1], "after": {"features": [{"no": {}}]}}
    path = write(tmp_path / "c.json", document, indent=indent, ensure_ascii=False)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    try:
        head, rows = J.collection(spark, path)
        got = [json.loads(r["feature"]) for r in rows.orderBy("ord").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == document["features"] and [r["ord"] for r in rows.orderBy("ord").collect()] == list(range(23))
    assert head["type"] == "FeatureCollection" and head["features"] == [] and head["bbox"] == [0, 0, 1, 1]
    assert head["meta"] == {"x": 0, "list": 0} and head["after"] == {"features": 0} and head["name"] == document["name"]


def test_empty_and_other_documents(spark, tmp_path):
    head, rows = J.collection(spark, write(tmp_path / "e.json", {"features": [], "type": "FeatureCollection", "crs": {}}))
    assert head == {"features": [], "type": "FeatureCollection", "crs": {}} and rows.count() == 0
    with pytest.raises(ValueError, match="crs"):
        read_geojson(spark, write(tmp_path / "x.json", {"type": "FeatureCollection", "crs": {"type": "name"}, "features": features(2)}))
    (one,) = read_geojson(spark, write(tmp_path / "f.json", features(2)[1])).collect()
    assert one["feature_id"] == "1" and one["kind"] == "Polygon"
    with pytest.raises(ValueError, match="not a GeoJSON"):
        read_geojson(spark, write(tmp_path / "n.json", {"a": 1}))
