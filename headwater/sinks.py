"""Outputs: GeoJSON documents, bounding-box summaries as CSV, and collision guards.

Rows are checked, measured and formatted by Spark; the driver only writes them to the one file that is asked for, a
partition of finished rows at a time."""

from __future__ import annotations

import csv
import json
import math
import textwrap
from collections.abc import Iterable
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from headwater.functions.text import fixed, padded_limit
from headwater.operators.geometry import area_km2, edges, planar, repaired
from headwater.plans.lineage import cut
from headwater.sources.geojson import parsed_features

# Fixed values of the CSV format.
COLUMNS = [
    "ProjectCode", "PolygonName", "MinLatitude", "MaxLatitude", "MinLongitude", "MaxLongitude", "CentroidLatitude", "CentroidLongitude",
    "AreaKm2", "BufferDegreesApplied",
]
SUFFIX = {"local": "local incremental catchment", "total": "total upstream catchment"}


def check_buffer(buffer: float | int) -> None:
    if not (math.isfinite(buffer) and buffer >= 0):
        raise ValueError(f"a margin of {buffer} degrees can't be put around a box")


def bbox_rows(features: DataFrame, buffer: float | int = 0.3) -> DataFrame:
    """The CSV's ten text columns of features (ord, id, project_code, name, part, geom), measured from the geometry, with ``ord``."""
    check_buffer(buffer)
    edge_rows = edges(features, "ord")
    shapes = planar(edge_rows, "ord").join(area_km2(edge_rows, "ord"), "ord")

    def limit(name: str, most: int, low: bool):
        @F.pandas_udf(StringType())
        def shown(values: pd.Series) -> pd.Series:
            return values.map(lambda v: padded_limit(v, buffer, most, low))

        return shown(name)

    cy, cx = fixed(4, "cy", "cx")
    (area,) = fixed(1, "area_km2")
    suffix = F.when(F.col("part") == "local", SUFFIX["local"]).when(F.col("part") == "total", SUFFIX["total"])
    return features.join(shapes, "ord").select(
        "ord", F.coalesce("project_code", "id").alias(COLUMNS[0]), F.concat_ws(" ", "name", suffix).alias(COLUMNS[1]),
        limit("south", 90, True).alias(COLUMNS[2]), limit("north", 90, False).alias(COLUMNS[3]), limit("west", 180, True).alias(COLUMNS[4]), limit("east", 180, False).alias(COLUMNS[5]),
        cy.alias(COLUMNS[6]), cx.alias(COLUMNS[7]), area.alias(COLUMNS[8]), F.lit(str(buffer)).alias(COLUMNS[9]),
    )


def to_geometry(polygons: Iterable) -> dict:
    """GeoJSON of polygons of (x, y) rings."""
    out = [[[[float(x), float(y)] for x, y in ring] for ring in polygon] for polygon in polygons]
    return {"type": "Polygon", "coordinates": out[0]} if len(out) == 1 else {"type": "MultiPolygon", "coordinates": out}


def summary_features(spark: SparkSession, collection: dict) -> DataFrame:
    """(ord, id, project_code, name, part, geom) of a GeoJSON collection, one text a feature, parsed and checked by Spark."""
    texts = [(k, json.dumps(f)) for k, f in enumerate(collection["features"])]
    parsed = parsed_features(spark.createDataFrame(texts, "ord int, feature string"))
    text = lambda name: F.col("properties")[name].alias(name)
    rows = parsed.select("ord", text("id"), text("project_code"), text("name"), text("part"), "geom").join(repaired(parsed, "ord").select("ord", "repaired", "broken"), "ord")
    corner = lambda q: (F.abs(q["x"]) <= 180) & (F.abs(q["y"]) <= 90)
    on_earth = F.forall("geom", lambda polygon: F.forall(polygon, lambda ring: F.forall(ring, corner)))
    faults = (
        (F.col("geom").isNull() | F.col("broken") | F.col("repaired"), "no valid polygon"), (~F.coalesce(on_earth, F.lit(False)), "coordinates off the globe"),
        (~F.coalesce(F.col("part").isin(*SUFFIX), F.lit(False)), "neither a local nor a total catchment"),
    )
    rows = cut(rows.withColumn("fault", F.coalesce(*[F.when(bad, F.lit(what)) for bad, what in faults])))
    if row := rows.filter("fault is not null").orderBy("ord").first():
        raise ValueError(f"feature {row['id']} can't be summarised: {row['fault']}")
    return rows.select("ord", "id", "project_code", "name", "part", "geom")


def write_bbox_rows(features: DataFrame, output: str | Path, buffer: float | int = 0.3) -> int:
    """Write the summary of checked features (``bbox_rows``) as one CSV file; every row is known before the file is opened. Returns their number."""
    rows = cut(bbox_rows(features, buffer).orderBy("ord"))
    output, n = Path(output), 0
    output.parent.mkdir(parents=True, exist_ok=True)
    with output.open("w", newline="", encoding="utf-8") as f:
        out = csv.writer(f)
        out.writerow(COLUMNS)
        for n, row in enumerate(rows.select("ord", *COLUMNS).orderBy("ord").toLocalIterator(), 1):  # noqa: B007
            out.writerow(row[1:])
    return n


def write_bbox_csv(spark: SparkSession, collection: dict, output: str | Path, buffer_degrees: float | int = 0.3) -> int:
    """``write_bbox_rows`` of a GeoJSON collection."""
    check_buffer(buffer_degrees)
    return write_bbox_rows(summary_features(spark, collection), output, buffer_degrees)


def write_geojson(document: dict, output: str | Path, features: Iterable[dict] | None = None) -> int:
    """Write a collection, indented; ``features`` may be an iterator, of which one is held at a time. Returns their number."""
    shown = lambda value: json.dumps(value, indent=2, ensure_ascii=False, allow_nan=False)
    features = document["features"] if features is None else features
    head = shown({k: v for k, v in document.items() if k != "features"})
    staged, n = Path(output).with_name(Path(output).name + ".part"), 0
    staged.parent.mkdir(parents=True, exist_ok=True)
    try:
        with staged.open("w", encoding="utf-8") as f:
            f.write(head[:-2] + ',\n  "features": [')
            for feature in features:
                f.write((",\n" if n else "\n") + textwrap.indent(shown(feature), "    "))
                n += 1
            f.write("\n  ]\n}\n" if n else "]\n}\n")
        staged.replace(output)
    finally:
        staged.unlink(missing_ok=True)
    return n


def guard_outputs(source: str | Path, config: str | Path, output: str | Path, csv_output: str | Path | None = None) -> None:
    """Raise ValueError if an output would overwrite an input, or the other output."""
    inputs = {Path(source).with_suffix(s).resolve() for s in (".shp", ".shx", ".dbf", ".prj")} | {Path(config).resolve()}
    if Path(output).resolve() in inputs:
        raise ValueError("the output would overwrite an input")
    if csv_output is not None and Path(csv_output).resolve() in inputs | {Path(output).resolve()}:
        raise ValueError("the CSV output would overwrite an input or the other output")
