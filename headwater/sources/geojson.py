"""GeoJSON layers: a collection, a feature or a bare geometry, parsed by Spark's JSON functions."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from headwater.operators.geometry import GEOMETRY
from headwater.sources.json_splits import collection

_RINGS = "array<array<array<double>>>"


def _geometry(kind, coordinates):
    point = lambda p: F.struct(F.get(p, 0).alias("x"), F.get(p, 1).alias("y"))
    polygon = lambda rings: F.transform(rings, lambda ring: F.transform(ring, point))
    one = F.array(polygon(F.from_json(coordinates, _RINGS)))
    many = F.transform(F.from_json(coordinates, f"array<{_RINGS}>"), polygon)
    return F.when(kind == "Polygon", one).when(kind == "MultiPolygon", many).otherwise(F.lit(None).cast(GEOMETRY))


def geometry_json(geom: Column | str) -> Column:
    """The GeoJSON text of a geometry: a Polygon if it is one, else a MultiPolygon."""
    geom = F.col(geom) if isinstance(geom, str) else geom
    arrays = F.transform(geom, lambda polygon: F.transform(polygon, lambda ring: F.transform(ring, lambda p: F.array(p["x"], p["y"]))))
    text = lambda kind, coordinates: F.to_json(F.struct(F.lit(kind).alias("type"), coordinates.alias("coordinates")))
    return F.when(F.size(geom) == 1, text("Polygon", F.get(arrays, 0))).otherwise(text("MultiPolygon", arrays))


def read_geojson(spark: SparkSession, path: str | Path) -> DataFrame:
    """(ord, feature_id, properties, kind, geom): features in document order. ``properties`` maps names to JSON texts.

    A collection is read by a task a split of its file; a document of one feature or geometry by one task.
    """
    document, found = collection(spark, str(path))
    if isinstance(document, dict) and document.get("type") == "FeatureCollection":
        if document.get("crs"):
            raise ValueError(f"{path}: a legacy crs member is not supported")
        return parsed_features(found)
    text = spark.read.text(str(path), wholetext=True).select(F.col("value"))
    top = text.select("value", F.get_json_object("value", "$.type").alias("type"), F.get_json_object("value", "$.crs").alias("crs"))
    if (row := top.select("type", "crs").first()) is None or row["type"] is None:
        raise ValueError(f"{path}: not a GeoJSON document")
    if row["crs"] not in (None, "null", "{}", "", "false", "0", "[]"):
        raise ValueError(f"{path}: a legacy crs member is not supported")
    if row["type"] == "Feature":
        features = top.select(F.lit(0).alias("ord"), F.col("value").alias("feature"))
    else:
        features = top.select(F.lit(0).alias("ord"), F.concat(F.lit('{"type":"Feature","properties":{},"geometry":'), F.col("value"), F.lit("}")).alias("feature"))
    return parsed_features(features)


def parsed_features(features: DataFrame) -> DataFrame:
    """(ord, feature_id, properties, kind, geom) of rows (ord, feature), a feature's text each."""
    kind, coordinates = F.get_json_object("feature", "$.geometry.type"), F.get_json_object("feature", "$.geometry.coordinates")
    return features.select(
        "ord", F.get_json_object("feature", "$.id").alias("feature_id"),
        F.coalesce(F.from_json(F.get_json_object("feature", "$.properties"), "map<string,string>"), F.create_map().cast("map<string,string>")).alias("properties"),
        kind.alias("kind"), _geometry(kind, coordinates).alias("geom"),
    )
