"""Layer comparison: load, select, dissolve, measure, and draw as SVG."""

from __future__ import annotations

import json
import math
import textwrap
from collections.abc import Iterator
from pathlib import Path
from xml.sax.saxutils import escape

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headwater.functions.geodesic import destination, distance_m
from headwater.functions.projection import equal_area, equal_area_inverse
from headwater.functions.text import casefolded, stem_of
from headwater.operators import geometry as G
from headwater.plans.lineage import cut
from headwater.sources.crs import sidecar_code, to_degrees
from headwater.sources.geojson import read_geojson
from headwater.sources.shapefile import read_shapes

# Names that may hold a marker's latitude and longitude, in order.
MARKERS = (("dam_lat", "latitude", "lat"), ("dam_lon", "longitude", "lon"))
COLOURS = ("#1b6ca8", "#c8553d", "#2e8b57", "#8e44ad", "#b8860b", "#444444")
DASHES = ("", "8 4", "2 3", "8 3 2 3")
BASEMAPS = ("none", "terrain", "light")


def load_features(spark: SparkSession, path: str | Path, id_field: str = "id", name_field: str = "name") -> DataFrame:
    """(ord, id, name, properties, geom) of a GeoJSON or shapefile layer in WGS84 degrees; any violation is a ValueError."""
    path = Path(path)
    suffix = path.suffix.lower()
    if suffix == ".shp":
        code = sidecar_code(path)
        layer = to_degrees(read_shapes(spark, path), code).select(F.col("oid").alias("ord"), F.lit(None).cast("string").alias("feature_id"), "properties", F.when(F.col("geom").isNotNull(), "Polygon").alias("kind"), "geom")
    elif suffix in (".json", ".geojson"):
        layer = read_geojson(spark, path)
    else:
        raise ValueError(f"{path}: only GeoJSON and shapefiles are supported")
    layer = cut(layer)
    if layer.isEmpty():
        raise ValueError(f"{path}: the layer is empty")
    if layer.filter("kind is null or kind not in ('Polygon', 'MultiPolygon') or geom is null").count():
        raise ValueError(f"{path}: only polygons can be compared")
    shapes = G.repaired(layer, "ord").select("ord", F.col("geom").alias("shape"), (F.col("repaired") | F.col("broken")).alias("invalid"))
    filled = lambda c: c.isNotNull() & (F.length(F.regexp_replace(c, r"[\s\p{Z}]+", "")) > 0)
    given, name = F.col("properties")[id_field], F.col("properties")[name_field]
    identifier = F.when(filled(given), given).when(filled(F.col("feature_id")), F.col("feature_id")).when(name.isNotNull(), name).otherwise(F.lit(path.stem))
    out = cut(layer.join(shapes, "ord").select("ord", identifier.alias("id"), F.when(filled(name), name).otherwise(identifier).alias("name"), "properties", F.col("shape").alias("geom"), "invalid"))
    if out.filter("invalid").count():
        raise ValueError(f"{path}: a polygon is empty or crosses itself")
    outside = F.exists("geom", lambda p: F.exists(p, lambda r: F.exists(r, lambda q: (F.abs(q["x"]) > 180) | (F.abs(q["y"]) > 90) | F.isnan(q["x"]) | F.isnan(q["y"]))))
    if out.filter(outside).count():
        raise ValueError(f"{path}: coordinates outside WGS84 bounds")
    return out.drop("invalid")


def select_project(layer: DataFrame, project: str | None) -> DataFrame:
    """Rows whose id or name is ``project``, white space around and letter case aside; they must share one id."""
    if project is None:
        return layer
    key = project.strip().casefold()
    bare = lambda c: casefolded(F.regexp_replace(F.col(c), r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    found = layer.withColumn("_id", bare("id")).withColumn("_name", bare("name")).filter((F.col("_id") == key) | (F.col("_name") == key)).drop("_id", "_name")
    n = found.select(casefolded("id").alias("k")).distinct().count()
    if n != 1:
        raise ValueError(f"project {project} {'is not in a layer' if n == 0 else 'is ambiguous'}")
    return found


def layer_areas(layers: DataFrame) -> DataFrame:
    """(label, area_km2): the ellipsoidal area of each label's dissolved polygons, whatever areas are stored."""
    lines = G.edges(layers.withColumn("member", F.monotonically_increasing_id()), "label", "member")
    merged = G.dissolve(lines, "label")
    return G.polygon_area_sum_km2(G.edges(merged, "label"), "label")


def same_ids(left: DataFrame, right: DataFrame) -> DataFrame:
    """Ids (case-folded) that only one of two layers has."""
    a, b = (d.select(casefolded("id").alias("id")).distinct() for d in (left, right))
    return a.exceptAll(b).union(b.exceptAll(a))


def markers(layers: DataFrame) -> DataFrame:
    """(lon, lat, layer, ord, name, valid): distinct points that properties give, each of the first feature with it.

    Of the names that may hold a coordinate the first one present counts, even when it is null; then there is no marker.
    """
    lower = F.transform_keys("properties", lambda k, _: F.lower(k))
    pick = lambda names: F.coalesce(*[F.when(F.map_contains_key("p", F.lit(n)), F.struct(F.col("p")[n].alias("v"))) for n in names])["v"]
    rows = layers.withColumn("p", lower).select("layer", "ord", "name", pick(MARKERS[0]).alias("lat"), pick(MARKERS[1]).alias("lon")).filter("lat is not null and lon is not null")
    numbers = rows.select("layer", "ord", "name", F.expr("try_cast(lat as double)").alias("lat"), F.expr("try_cast(lon as double)").alias("lon"))
    return numbers.groupBy("lon", "lat").agg(F.min(F.struct("layer", "ord", "name")).alias("first")).select("lon", "lat", "first.*", (F.abs("lon").between(0, 180) & F.abs("lat").between(0, 90)).alias("valid"))


def nice_length(target: float) -> float:
    """The largest 1, 2 or 5 times a power of ten that is not above ``target``."""
    power = 10.0 ** math.floor(math.log10(target))
    return max(m * power for m in (1, 2, 5) if m * power <= target)


def tick_label(value: float, axis: str) -> str:
    """Degrees with the hemisphere's letter."""
    return f"{abs(value):g}\N{DEGREE SIGN}{('W' if axis == 'x' else 'S') if value < 0 else ('E' if axis == 'x' else 'N')}"


def add_basemap(style: str = "terrain") -> str:
    """The attribution of a background of map tiles: empty for ``none``; other styles need a library that fetches tiles, which is not installed."""
    if style not in BASEMAPS:
        raise ValueError(f"basemap must be one of {', '.join(BASEMAPS)}")
    if style != "none":
        raise ValueError("basemap tiles need an optional library that is not installed")
    return ""


def _check(paths, output, labels, coordinates, basemap):
    if coordinates not in ("lonlat", "projected"):
        raise ValueError("coordinates must be lonlat or projected")
    add_basemap(basemap)
    if not paths:
        raise ValueError("there is nothing to compare")
    if output is not None and Path(output).suffix.lower() not in (".png", ".pdf", ".svg"):
        raise ValueError("figures are PNG, PDF or SVG")
    labels = [Path(p).stem for p in paths] if labels is None else list(labels)
    if len(labels) != len(paths):
        raise ValueError("one label per input is needed")
    if len(set(labels)) != len(labels):
        raise ValueError("labels must be unique")
    return labels


def plot_comparison(spark: SparkSession, paths, output, project=None, labels=None, id_field="id", name_field="name", title=None, coordinates="lonlat", basemap="none", tile_cache=None) -> dict:
    """Draw layers over each other; returns {project, areas_km2, output, coordinate_display, basemap}: the name of the project (of a
    selection, or of a first layer with one feature; else ``All projects``), areas by label, the file, and the two modes as given."""
    labels = _check(paths, output, labels, coordinates, basemap)
    layers = [load_features(spark, p, id_field, name_field) for p in paths]
    return _figure(spark, layers, labels, Path(output), project, title, coordinates, basemap)


def _figure(spark, layers, labels, output, project, title, coordinates, basemap) -> dict:
    picked = [select_project(x, project).withColumn("label", F.lit(label)).withColumn("layer", F.lit(k)) for k, (x, label) in enumerate(zip(layers, labels, strict=True))]
    every = picked[0]
    for other in picked[1:]:
        every = every.unionByName(other)
    every = cut(every)
    counts = {r["layer"]: r for r in every.groupBy("layer").agg(F.count("*").alias("n"), F.min_by("name", "ord").alias("first")).collect()}
    areas = {r["label"]: r["area_km2"] for r in layer_areas(every).collect()}
    areas = {label: areas[label] for label in labels}
    dots = markers(every)
    if not dots.filter("NOT coalesce(valid, false)").isEmpty():
        raise ValueError("a marker's coordinates are not finite degrees")
    heading = counts[0]["first"] if project is not None or counts[0]["n"] == 1 else "All projects"
    if output.suffix.lower() != ".svg":
        raise ValueError("PNG and PDF figures need an optional library that is not installed; use .svg")
    whole = G.union_planar(G.edges(every.select(F.lit(1).alias("k"), "geom"), "k"), "k").first()
    output.parent.mkdir(parents=True, exist_ok=True)
    named = {k for k, r in counts.items() if project is not None or r["n"] == 1}
    with output.open("w", encoding="utf-8") as f:
        # shapes and markers pass through one at a time
        f.writelines(_svg(every.orderBy("layer", "ord").toLocalIterator(), labels, areas, dots.orderBy("layer", "ord").toLocalIterator(), named, title or heading, coordinates, whole))
    return {"project": heading, "areas_km2": areas, "output": str(output), "coordinate_display": coordinates, "basemap": basemap}


def _svg(rows, labels, areas, dots, named, title, coordinates, whole) -> Iterator[str]:
    lon0, lat0 = whole["cx"], whole["cy"]

    def place(lon, lat):
        if coordinates == "projected":
            x, y = equal_area(lon, lat, lon0, lat0)
            return x / 1000, y / 1000
        return np.asarray(lon, float), np.asarray(lat, float)

    corners = place([whole["west"], whole["east"], whole["west"], whole["east"]], [whole["south"], whole["south"], whole["north"], whole["north"]])
    x0, x1, y0, y1 = corners[0].min(), corners[0].max(), corners[1].min(), corners[1].max()
    mx, my = 0.12 * max(x1 - x0, 1e-9), 0.12 * max(y1 - y0, 1e-9)
    x0, x1, y0, y1 = x0 - mx, x1 + mx, y0 - my, y1 + my
    aspect = 1 / max(0.05, math.cos(math.radians(lat0))) if coordinates == "lonlat" else 1.0
    width = min(max(6.6, 7.2 * (x1 - x0) / ((y1 - y0) * aspect)), 13) * 72
    height = width * (y1 - y0) * aspect / (x1 - x0)
    sx, sy = width / (x1 - x0), height / (y1 - y0)
    to = lambda x, y: (60 + (x - x0) * sx, 50 + (y1 - y) * sy)
    notes = [f"{label}: {areas[label]:,.1f} km\N{SUPERSCRIPT TWO}" for label in labels]
    size = f'width="{width + 120:.0f}" height="{height + 120 + 16 * len(notes):.0f}"'
    head = "".join(f'<text x="60" y="{18 + 16 * k}" font-weight="bold">{escape(line)}</text>' for k, line in enumerate(textwrap.wrap(title, 70)[:2]))
    yield f'<svg xmlns="http://www.w3.org/2000/svg" {size} font-family="sans-serif" font-size="12">{head}<rect x="60" y="50" width="{width:.2f}" height="{height:.2f}" fill="none" stroke="#999"/>'
    for r in rows:
        colour, dash = COLOURS[r["layer"] % len(COLOURS)], DASHES[r["layer"] % len(DASHES)]
        path = []
        for polygon in r["geom"]:
            for ring in polygon:
                px, py = to(*place([p["x"] for p in ring], [p["y"] for p in ring]))
                path.append("M" + "L".join(f"{a:.2f},{b:.2f}" for a, b in zip(px, py, strict=True)) + "Z")
        yield (f'<path d="{"".join(path)}" fill="{colour}" fill-opacity="0.14" fill-rule="evenodd" stroke="{colour}" stroke-dasharray="{dash}"><title>{escape(r["name"])}</title></path>')
    marked = False
    for d in dots:
        marked = True
        a, b = to(*place(d["lon"], d["lat"]))
        yield f'<circle cx="{a:.2f}" cy="{b:.2f}" r="4"/>'
        if d["layer"] in named:
            yield f'<text class="marker" x="{a + 6:.2f}" y="{b - 6:.2f}">{escape(d["name"])}</text>'
    for axis, low, high in (("x", x0, x1), ("y", y0, y1)):
        step = nice_length((high - low) / 2)
        for v in np.arange(math.ceil(low / step) * step, high, step)[:5]:
            a, b = to(v if axis == "x" else x0, v if axis == "y" else y0)
            text = tick_label(round(float(v), 9), axis) if coordinates == "lonlat" else f"{v:g} km"
            yield (f'<text class="tick" x="{a - (0 if axis == "x" else 45):.2f}" y="{b + (16 if axis == "x" else 0):.2f}">{text}</text>')
    # scale bar along the parallel near the lower left corner, north arrow along the meridian near the upper left one
    def degrees(x, y):
        return equal_area_inverse(x * 1000, y * 1000, lon0, lat0) if coordinates == "projected" else (x, y)

    left, low = x0 + 0.07 * (x1 - x0), y0 + 0.075 * (y1 - y0)
    lon, lat = degrees(left, low)
    metres = float(distance_m(lon, lat, *degrees(left + 0.22 * (x1 - x0), low))[0]) or 1000.0
    bar = nice_length(metres / 1000) * 1000
    (ax, ay), (bx, by) = to(left, low), to(*(float(np.squeeze(v)) for v in place(*destination(lon, lat, 90, bar))))
    yield f'<path class="scale" d="M{ax:.2f},{ay:.2f}L{bx:.2f},{by:.2f}" stroke="black" stroke-width="3"/><text x="{ax:.2f}" y="{ay - 7:.2f}">{bar / 1000:g} km</text>'
    top = y0 + 0.82 * (y1 - y0)
    (ax, ay), (bx, by) = to(left, top), to(*(float(np.squeeze(v)) for v in place(*destination(*degrees(left, top), 0, 1000))))
    norm = math.hypot(bx - ax, by - ay) or 1.0
    ux, uy = (bx - ax) / norm, (by - ay) / norm
    tx, ty = ax + 30 * ux, ay + 30 * uy
    yield f'<path class="north" d="M{ax:.2f},{ay:.2f}L{tx:.2f},{ty:.2f}m{-8 * ux - 4 * uy:.2f},{-8 * uy + 4 * ux:.2f}L{tx:.2f},{ty:.2f}l{-8 * ux + 4 * uy:.2f},{-8 * uy - 4 * ux:.2f}" stroke="black" fill="none"/>'
    yield f'<text x="{tx - 4:.2f}" y="{ty - 4:.2f}">N</text>'
    for k, note in enumerate(notes):
        yield f'<text x="60" y="{90 + height + 16 * k:.2f}" fill="{COLOURS[k % len(COLOURS)]}">{escape(note)}</text>'
    for k, entry in enumerate([*labels, "Dam reference"][: len(labels) + marked]):
        at, colour = 66 + 16 * k, COLOURS[k % len(COLOURS)]
        sign = f'<rect x="{width - 90:.2f}" y="{at - 9}" width="14" height="9" fill="{colour}" fill-opacity="0.5" stroke="{colour}" stroke-dasharray="{DASHES[k % len(DASHES)]}"/>' if k < len(labels) else f'<circle cx="{width - 83:.2f}" cy="{at - 5}" r="4"/>'
        yield f'{sign}<text class="legend" x="{width - 70:.2f}" y="{at}">{escape(entry)}</text>'
    axis = "Longitude / latitude (degrees)" if coordinates == "lonlat" else "Easting / northing (km)"
    yield f'<text x="60" y="{74 + height:.2f}">{axis}</text></svg>\n'


def plot_by_project(spark: SparkSession, paths, output_dir, labels=None, id_field="id", name_field="name", title=None, coordinates="lonlat", basemap="none", tile_cache=None, suffix=".svg") -> list[Path]:
    """One figure a project; every layer is read once. Nothing is written if ids differ or a target exists."""
    labels = _check(paths, None, labels, coordinates, basemap)
    layers = [load_features(spark, p, id_field, name_field) for p in paths]
    for other in layers[1:]:
        if not same_ids(layers[0], other).isEmpty():
            raise ValueError("the inputs do not have the same project ids")
    ids = [r["id"] for r in layers[0].groupBy("id").agg(F.min("ord").alias("o")).orderBy("o").collect()]
    targets = [Path(output_dir) / f"{stem_of(i)}{suffix}" for i in ids]
    if len({t.name.casefold() for t in targets}) != len(targets):
        raise ValueError("project ids give the same file name")
    for t in targets:
        if t.exists():
            raise FileExistsError(f"{t} exists")
    for i, t in zip(ids, targets, strict=True):
        _figure(spark, layers, labels, t, i, title, coordinates, basemap)
    return targets


def overview_path(folder: str | Path, suffix: str = ".svg") -> Path:
    """overview, overview-2, ... : the first name that no file of the folder has, letter case aside."""
    taken = {p.name.casefold() for p in Path(folder).iterdir()} if Path(folder).is_dir() else set()
    k = 1
    while (name := f"overview{'' if k == 1 else f'-{k}'}{suffix}").casefold() in taken:
        k += 1
    return Path(folder) / name


def report_text(report: dict) -> str:
    return json.dumps(report, indent=2, ensure_ascii=False, allow_nan=False)
