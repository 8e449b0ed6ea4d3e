import io
import json
import zipfile

import numpy as np
import pytest

from headwater import cli
from headwater.functions.geodesic import destination, distance_m, ring_area_km2
from headwater.functions.projection import equal_area, equal_area_inverse
from headwater.plans import compare as C
from headwater.sources import archive as A
from headwater.sources.crs import crs_code
from tests.shapes import MERCATOR, WGS84, square, write_shapefile


def geojson(path, *features):
    rows = [{"type": "Feature", "properties": {"area": -1, **p}, "geometry": {"type": "Polygon", "coordinates": [[list(q) for q in r] for r in rings]}} for p, rings in features]
    path.write_text(json.dumps({"type": "FeatureCollection", "features": rows}))
    return path


FRAME = [square(0, 0, 2), square(0.5, 0.5)]


def test_geojson_layer_and_identifiers(spark, tmp_path):
    path = geojson(tmp_path / "layer.geojson", ({"id": "a", "name": "Alpha"}, FRAME), ({"id": " ", "name": "Beta"}, [square(5, 5)]), ({"id": 0}, [square(7, 7)]), ({}, [square(9, 9)]))
    rows = C.load_features(spark, path).orderBy("ord").collect()
    assert [(r["id"], r["name"]) for r in rows] == [("a", "Alpha"), ("Beta", "Beta"), ("0", "0"), ("layer", "layer")]
    assert len(rows[0]["geom"][0]) == 2


def test_shapefile_layer_in_mercator(spark, tmp_path):
    side = 111319.49079327357
    ring = [(0, 0), (0, 111325.1428663849), (side, 111325.1428663849), (side, 0), (0, 0)]
    shp = write_shapefile(tmp_path / "m.shp", [("id", "C", 8), ("name", "C", 8)], [(("x", "Straße"), [ring])], MERCATOR)
    (row,) = C.load_features(spark, shp).collect()
    xs, ys = [p["x"] for p in row["geom"][0][0]], [p["y"] for p in row["geom"][0][0]]
    assert (min(xs), min(ys), max(xs), max(ys)) == pytest.approx((0, 0, 1, 1), abs=1e-7) and row["name"] == "Straße"
    assert C.select_project(C.load_features(spark, shp), " STRASSE ").count() == 1
    shp.with_suffix(".prj").unlink()
    with pytest.raises(ValueError):
        C.load_features(spark, shp)


def test_bad_layers(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"type": "Point", "coordinates": [0, 0]}')
    geojson(tmp_path / "far.json", ({"id": "a"}, [square(179.5, 0)]))
    geojson(tmp_path / "bow.json", ({"id": "a"}, [[(0, 0), (2, 2), (2, 0), (0, 2), (0, 0)]]))
    (tmp_path / "e.json").write_text('{"type": "FeatureCollection", "features": []}')
    (tmp_path / "c.json").write_text('{"type": "FeatureCollection", "crs": {"type": "name"}, "features": []}')
    for name, text in (("p.json", "polygon"), ("far.json", "bounds"), ("bow.json", "crosses itself"), ("e.json", "empty"), ("c.json", "crs"), ("x.txt", "supported")):
        with pytest.raises(ValueError, match=text):
            C.load_features(spark, tmp_path / name)
    assert crs_code(WGS84) == 4326 and crs_code(MERCATOR) == 3857
    with pytest.raises(ValueError):
        crs_code(WGS84.replace("WGS_1984", "NAD_1983"))


def test_comparison_measures_geometry(spark, tmp_path):
    a, b = geojson(tmp_path / "a.geojson", ({"id": "p", "name": "Dam & co", "lat": 1, "LON": 1}, FRAME)), geojson(tmp_path / "b.geojson", ({"id": "P", "name": "Dam"}, FRAME))
    expected = ring_area_km2(square(0, 0, 2)[::-1]) - ring_area_km2(square(0.5, 0.5)[::-1])
    shown = {}
    for mode in ("lonlat", "projected"):
        report = C.plot_comparison(spark, [a, b], tmp_path / f"{mode}.svg", coordinates=mode)
        assert report["areas_km2"] == pytest.approx({"a": expected, "b": expected}, abs=1e-6)
        assert (report["project"], report["coordinate_display"], report["basemap"], report["output"]) == ("Dam & co", mode, "none", str(tmp_path / f"{mode}.svg"))
        shown[mode] = (tmp_path / f"{mode}.svg").read_text()
    assert "Dam &amp; co" in shown["lonlat"] and "Easting" in shown["projected"] and "Longitude" in shown["lonlat"] and "evenodd" in shown["lonlat"]
    assert shown["lonlat"].count('class="legend"') == 3 and shown["lonlat"].count('class="marker"') == 1 and 'class="scale"' in shown["projected"] and 'class="north"' in shown["projected"]
    two = geojson(tmp_path / "two.geojson", ({"id": "p", "name": "One", "lat": 1, "lon": 1}, FRAME), ({"id": "q", "name": "Two", "lat": 9, "lon": 9}, [square(8, 8)]))
    many = C.plot_comparison(spark, [two, b], tmp_path / "many.svg", labels=["x", "y"])
    assert many["project"] == "All projects" and 'class="marker"' not in (tmp_path / "many.svg").read_text()
    chosen = C.plot_comparison(spark, [two, b], tmp_path / "one.svg", project="P", title="Own title")
    assert chosen["project"] == "One" and "Own title" in (tmp_path / "one.svg").read_text() and 'class="marker"' in (tmp_path / "one.svg").read_text()
    for bad in ({"coordinates": "x"}, {"labels": ["one"]}, {"labels": ["s", "s"]}, {"project": "nobody"}, {"basemap": "odd"}):
        with pytest.raises(ValueError):
            C.plot_comparison(spark, [a, b], tmp_path / "n.svg", **bad)
    assert not (tmp_path / "n.svg").exists()


def test_backgrounds():
    assert C.add_basemap("none") == ""
    for style in ("terrain", "sepia"):
        with pytest.raises(ValueError, match="basemap"):
            C.add_basemap(style)


def test_figures_by_project(spark, tmp_path, capsys):
    a, b = geojson(tmp_path / "a.json", ({"id": "overview"}, [square(0, 0)])), geojson(tmp_path / "b.json", ({"id": "OVERVIEW"}, [square(0, 0)]))
    out = tmp_path / "figs"
    assert cli.main(["plot", str(a), str(b), "--by-project", "--output-dir", str(out)]) == 0
    assert sorted(p.name for p in out.iterdir()) == ["overview-2.svg", "overview.svg"]
    with pytest.raises(FileExistsError):
        C.plot_by_project(spark, [a, b], out)
    with pytest.raises(ValueError, match="same project ids"):
        C.plot_by_project(spark, [a, geojson(tmp_path / "c.json", ({"id": "other"}, [square(0, 0)]))], tmp_path / "g")
    assert cli.main(["plot", str(a), "--by-project"]) == 2 and cli.main(["plot", str(a), "--output-dir", "x"]) == 2


def test_markers(spark):
    rows = [(0, 0, "A", {"DAM_LAT": "1", "lat": "5", "lon": "2"}), (0, 1, "B", {"dam_lat": None, "lat": "5", "lon": "2"}), (1, 0, "C", {"lat": "1.0", "Longitude": "2"}), (1, 1, "D", {"lat": "95", "lon": "0"})]
    got = C.markers(spark.createDataFrame(rows, "layer int, ord int, name string, properties map<string,string>")).collect()
    assert {(r["lon"], r["lat"], r["name"], r["valid"]) for r in got} == {(2.0, 1.0, "A", True), (0.0, 95.0, "D", False)}


def test_scales_and_ticks():
    assert C.nice_length(730) == 500 and C.nice_length(0.21) == pytest.approx(0.2) and C.tick_label(-118.5, "x") == "118.5°W" and (C.tick_label(0, "y"), C.tick_label(0, "x"), C.tick_label(-2, "y")) == ("0°N", "0°E", "2°S")


def test_geodesic_and_projection_round_trips():
    rng = np.random.default_rng(3)
    lon, lat, azimuth, metres = rng.uniform(-180, 180, 200), rng.uniform(-80, 80, 200), rng.uniform(-180, 180, 200), rng.uniform(1, 5e6, 200)
    to = destination(lon, lat, azimuth, metres)
    assert distance_m(lon, lat, *to) == pytest.approx(metres, abs=1e-5)
    quarter = destination(0, 0, 0, 10001965.729)[1][0]
    assert quarter == pytest.approx(90, abs=1e-6) and destination(0, 0, 90, 111319.49079327357)[0][0] == pytest.approx(1, abs=1e-9)
    for lon0, lat0 in ((10, 50), (-120, 0), (0, -75)):
        near = lon0 + rng.uniform(-5, 5, 50), np.clip(lat0 + rng.uniform(-5, 5, 50), -89, 89)
        assert np.allclose(equal_area_inverse(*equal_area(*near, lon0, lat0), lon0, lat0), near, atol=1e-9)


NAMES = [f"hybas_na_lev12_v1c{s}" for s in A.SUFFIXES]


def archived(change=None, names=NAMES):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for n in names:
            z.writestr(n, f"original-{n[-3:]}")
        if change:
            change(z)
    return data.getvalue()


def getter(payload, calls):
    def get(url, to):
        calls.append(url)
        to.write_bytes(payload)

    return get


def test_download_and_reuse(tmp_path):
    calls = []
    get = getter(archived(lambda z: z.writestr("../escape", "x")), calls)
    shp = A.download_dataset("na", 12, "1c", tmp_path / "d", get)
    assert shp.read_text() == "original-shp" and not (tmp_path / "escape").exists()
    A.download_dataset("na", 12, "1c", tmp_path / "d", get)
    home = tmp_path / "d" / "hybas_na_lev12_v1c"
    told = json.loads((home / "manifest.json").read_text())
    assert shp.parent == home and len(calls) == 1 and set(told["sha256"]) == {*NAMES, "hybas_na_lev12_v1c.zip"} and len(told["sha256"][NAMES[0]]) == 64 and told["source_url"] == calls[0]
    for k, target in enumerate((shp.name, "hybas_na_lev12_v1c.zip", "manifest.json")):
        (home / target).write_text("tampered")
        A.download_dataset("na", 12, "1c", tmp_path / "d", get)
        assert len(calls) == 2 + k and shp.read_text() == "original-shp"
    (home / "manifest.json").rename(tmp_path / "elsewhere.json")
    (home / "manifest.json").symlink_to(tmp_path / "elsewhere.json")
    A.download_dataset("na", 12, "1c", tmp_path / "d", get)
    assert len(calls) == 5 and not (home / "manifest.json").is_symlink()
    (tmp_path / "e").mkdir()
    (tmp_path / "e" / home.name).symlink_to(home)
    with pytest.raises(ValueError, match="symbolic link"):
        A.download_dataset("na", 12, "1c", tmp_path / "e", get)


def test_bad_downloads_publish_nothing(tmp_path):
    broken = bytearray(archived())
    broken[broken.find(b"original-shp")] ^= 1
    link = zipfile.ZipInfo(NAMES[0])
    link.external_attr = 0o120777 << 16
    payloads = [b"no zip", archived(names=NAMES[1:]), bytes(broken), archived(lambda z: z.writestr(link, "elsewhere"), NAMES[1:])]
    for payload in payloads:
        with pytest.raises(ValueError, match="archive"):
            A.download_dataset("na", 12, "1c", tmp_path, getter(payload, []))

    def fails(url, to):
        raise OSError("reset")

    with pytest.raises(OSError, match="download"):
        A.download_dataset("na", 12, "1c", tmp_path, fails)
    for bad in (("xx", 12, "1c"), ("na", True, "1c"), ("na", 12, "2")):
        with pytest.raises(ValueError):
            A.download_dataset(*bad, tmp_path, fails)
    assert not list(tmp_path.iterdir())
