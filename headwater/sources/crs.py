"""Coordinate systems of layers, by the text beside them."""

from __future__ import annotations

import re
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headwater.functions.projection import mercator_to_degrees
from headwater.operators.geometry import GEOMETRY


def crs_code(wkt: str) -> int:
    """4326 or 3857 for the WKT of WGS 84 or of web Mercator on it; ValueError for any other."""
    flat = re.sub(r"[\s_]+", "", wkt).upper()
    geographic = flat.startswith(("GEOGCS[", "GEOGCRS[", "GEODCRS["))
    wgs84 = bool(re.search(r'"(D?WGS84|DWGS1984|WGS1984|WORLDGEODETICSYSTEM1984(ENSEMBLE)?)"', flat))
    unit = re.search(r'(?:ANGLE)?UNIT\["DEGREE"', flat)
    if geographic and wgs84 and unit:
        return 4326
    if flat.startswith(("PROJCS[", "PROJCRS[")) and wgs84 and re.search(r'"(POPULARVISUALISATION)?PSEUDO-MERCATOR"|AUXILIARYSPHERE|"EPSG","?3857"?|POPULARVISUALISATIONPSEUDOMERCATOR', flat):
        return 3857
    raise ValueError("only WGS 84 degrees (EPSG:4326) and web Mercator (EPSG:3857) are supported")


def sidecar_code(shp: str | Path) -> int:
    prj = Path(shp).with_suffix(".prj")
    if not prj.exists():
        raise ValueError(f"{shp}: a .prj file is needed")
    return crs_code(prj.read_text(encoding="utf-8", errors="replace"))


def to_degrees(layer: DataFrame, code: int, geom: str = "geom") -> DataFrame:
    if code == 4326:
        return layer

    @F.pandas_udf(GEOMETRY)
    def moved(column: pd.Series) -> pd.Series:
        def ring(points):
            x, y = mercator_to_degrees([p["x"] for p in points], [p["y"] for p in points])
            return [{"x": float(a), "y": float(b)} for a, b in zip(np.atleast_1d(x), np.atleast_1d(y), strict=True)]

        return column.map(lambda g: None if g is None else [[ring(r) for r in polygon] for polygon in g])

    return layer.withColumn(geom, moved(geom))
