import csv
import json

import pytest
import yaml

from headwater import cli
from headwater.config import load_config
from headwater.plans.catchments import build_catchments
from headwater.sinks import to_geometry, write_bbox_csv
from tests.shapes import UNIT_FIELDS, square, write_shapefile, write_units

ROWS = [(1, 3, 0, 0, 1), (2, 3, 0, 1, 1), (3, 0, 0, 0, 0), (4, 3, 2, 1, 0)]
PROJECTS = [("UPPER", 1, 0.5, 1.5), ("LOWER", 3, 0.5, 0.5)]


def config(tmp_path, projects=PROJECTS, **extra):
    path = tmp_path / "projects.yaml"
    path.write_text(yaml.safe_dump({"dataset": {"region": "na"}, "projects": [{"id": i, "name": f"Project {i}", **extra, "outlet": {"hybas_id": u, "lon": x, "lat": y}} for i, u, x, y in projects]}))
    return path


def build(spark, tmp_path, rows=ROWS, projects=PROJECTS, **options):
    return build_catchments(spark, load_config(config(tmp_path, projects)), write_units(tmp_path / "units.shp", rows), **options)


def test_local_catchments(spark, tmp_path):
    made = build(spark, tmp_path)
    upper, lower = made["features"]
    p = lower["properties"]
    assert upper["properties"]["hybas_ids"] == [1] and upper["properties"]["down"] == "LOWER"
    assert (p["hybas_ids"], p["up"], p["above"], p["down"], p["unit_count"], p["part"]) == ([2, 3], ["UPPER"], ["UPPER"], None, 2, "local")
    assert p["area_local"] == pytest.approx(24613.9071125, abs=1e-4) and p["area"] == p["area_local"]
    assert lower["geometry"]["type"] == "MultiPolygon" and p["outlet_source"] is None
    assert made["metadata"]["local_cutoffs"] == ["UPPER", "LOWER"] and made["metadata"]["repaired_geometry_count"] == 0
    assert all(len(v) == 64 for v in made["metadata"]["source_sha256"].values())


def test_total_part_and_filter(spark, tmp_path):
    (f,) = build(spark, tmp_path, part="total", project_ids=["lower"])["features"]
    p = f["properties"]
    assert p["hybas_ids"] == [1, 2, 3] and p["area"] == p["area_total"] > p["area_local"]


def test_nested_projects(spark, tmp_path):
    rows = [ROWS[0], ROWS[1], (3, 5, 0, 0, 0), (5, 0, 0, 0, -1)]
    last = build(spark, tmp_path, rows, [*PROJECTS, ("LAST", 5, 0.5, -0.5)])["features"][2]["properties"]
    assert (last["hybas_ids"], last["up"], last["above"]) == ([5], ["LOWER"], ["UPPER", "LOWER"])
    assert last["area_local"] == pytest.approx(12308.7783615, abs=1e-4)


@pytest.mark.parametrize(
    ("rows", "projects", "options", "text"),
    [
        (ROWS, [("UPPER", 1, 5, 5), PROJECTS[1]], {}, "UPPER.*outside"), (ROWS, [("UPPER", 999, 0, 0)], {}, "999"), (ROWS, PROJECTS, {"project_ids": ["nobody"]}, "nobody"), (ROWS, PROJECTS, {"project_ids": []}, "at least one"),
        ([(1, 3, 0, 0, 1), (3, 1, 0, 0, 0)], PROJECTS, {}, "cycle"), ([(1, 999, 0, 0, 1), (3, 0, 0, 0, 0)], PROJECTS, {}, "999"), (ROWS, PROJECTS, {"part": "half"}, "part"),
    ],
)
def test_bad_inputs(spark, tmp_path, rows, projects, options, text):
    with pytest.raises(ValueError, match=text):
        build(spark, tmp_path, rows, projects, **options)


def test_repaired_units_are_listed(spark, tmp_path):
    bow = [(0, 0), (2, 2), (2, 0), (0, 2), (0, 0)]
    shp = write_shapefile(tmp_path / "units.shp", UNIT_FIELDS, [((1, 0, 0), [bow]), ((2, 0, 0), [square(5, 5)])])
    made = build_catchments(spark, load_config(config(tmp_path, [("BOW", 1, 2.0, 1.0)])), shp)
    assert made["metadata"]["repaired_hybas_ids"] == [1] and made["features"][0]["geometry"]["type"] == "MultiPolygon"


def collection(ring, part="local", **more):
    geometry = to_geometry([[ring]])
    return {"features": [{"properties": {"id": "EXAMPLE", "name": "Example", "part": part, "area": -1, "lat": -80, "lon": -100, **more}, "geometry": geometry}]}


def test_bbox_csv(spark, tmp_path):
    out = tmp_path / "deep" / "x.csv"
    assert write_bbox_csv(spark, collection(square(0, 0), project_code="EX"), out) == 1
    rows = list(csv.reader(out.open(newline="")))
    assert rows[1] == ["EX", "Example local incremental catchment", "-0.3000", "1.3000", "-0.3000", "1.3000", "0.5000", "0.5000", "12308.8", "0.3"]
    near = [(0.00006, 0.00004), (0.00006, 1.00006), (1.00004, 1.00006), (1.00004, 0.00004), (0.00006, 0.00004)]
    write_bbox_csv(spark, collection(near, "total"), out, 0)
    assert list(csv.reader(out.open(newline="")))[1][:6] == ["EXAMPLE", "Example total upstream catchment", "0.0000", "1.0001", "0.0000", "1.0001"]
    out.write_text("keep")
    for bad in (-1, float("nan"), float("inf")):
        with pytest.raises(ValueError):
            write_bbox_csv(spark, collection(square(0, 0)), out, bad)
    with pytest.raises(ValueError):
        write_bbox_csv(spark, collection(square(179.5, 0)), out)
    assert out.read_text() == "keep"


def test_command_line(spark, tmp_path, capsys):
    shp, yml = write_units(tmp_path / "u.shp", [(1, 0, 0, 0, 0)]), config(tmp_path, [("DAM", 1, 0.5, 0.5)])
    out, table = tmp_path / "o" / "c.geojson", tmp_path / "o" / "c.csv"
    assert cli.main(["build", str(yml), "--source", str(shp), "--output", str(out), "--csv-output", str(table), "--include-virtual"]) == 0
    made = json.loads(out.read_text())
    assert made["metadata"]["include_virtual_connections"] is True and made["features"][0]["properties"]["part"] == "local"
    assert "DAM" in table.read_text() and "12308.8" in table.read_text()
    before = shp.with_suffix(".dbf").read_bytes()
    for extra in (["--output", str(shp.with_suffix(".dbf"))], ["--output", str(out), "--csv-output", str(shp.with_suffix(".dbf"))], ["--output", str(out), "--csv-output", str(out)]):
        assert cli.main(["build", str(yml), "--source", str(shp), *extra]) == 2
    assert shp.with_suffix(".dbf").read_bytes() == before
    assert cli.main(["build", str(tmp_path / "none.yaml"), "--source", str(shp), "--output", str(tmp_path / "n.geojson")]) == 2
    assert not (tmp_path / "n.geojson").exists() and "headwater:" in capsys.readouterr().err
