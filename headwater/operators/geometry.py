"""Polygon layers as DataFrames. A geometry is an array of polygons, a polygon an array of closed rings (the first its
shell), a ring an array of (x, y). Measures are sums over directed edges, so they aggregate partially before a shuffle."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from headwater.functions.geodesic import edge_areas
from headwater.operators import arrangement, linework, overlay, rings
from headwater.operators.arrangement import boundary_edges
from headwater.plans.lineage import cut

#: Boundary edges of a union that are put together in one task; larger unions are noded and assembled by joins.
WHOLE = 200_000
GEOMETRY = "array<array<array<struct<x:double,y:double>>>>"


def ring_sign(ring: Column) -> Column:
    """Twice the signed planar area of a closed ring, about its first point."""
    first = F.get(ring, 0)
    dx = lambda i: F.get(ring, i)["x"] - first["x"]
    dy = lambda i: F.get(ring, i)["y"] - first["y"]
    steps = F.sequence(F.lit(0), F.greatest(F.size(ring) - 2, F.lit(0)))
    return F.aggregate(steps, F.lit(0.0), lambda acc, i: acc + F.coalesce(dx(i) * dy(i + 1) - dx(i + 1) * dy(i), F.lit(0.0)))


def with_shapes(rows: DataFrame, shapes: DataFrame, key: str = "unit") -> DataFrame:
    """``rows`` with the geometry of their ``key``, which is never broadcast: Spark judges a table by its compressed files and an array by one element,
    so shapes that pass for a few MB can take hundreds in the driver."""
    return rows.join(shapes.hint("merge"), key)


def oriented(geom: Column | str) -> Column:
    """Shells counterclockwise, holes clockwise."""
    turn = lambda ring, k: F.when((ring_sign(ring) < 0) == (k == 0), F.reverse(ring)).otherwise(ring)
    return F.transform(geom, lambda polygon: F.transform(polygon, turn))


def edges(features: DataFrame, *keys: str, geom: str = "geom") -> DataFrame:
    """(keys, poly, ring, seq, x1, y1, x2, y2): directed edges of oriented rings, in ring order."""
    keys = list(keys)
    polygons = features.select(*keys, F.posexplode(oriented(geom)).alias("poly", "rings"))
    rings = polygons.select(*keys, "poly", F.posexplode("rings").alias("ring", "points"))
    # each vertex with the next one of its ring
    pairs = F.arrays_zip(F.slice("points", F.lit(1), F.size("points") - 1).alias("a"), F.slice("points", F.lit(2), F.size("points")).alias("b"))
    found = rings.filter("size(points) > 1").select(*keys, "poly", "ring", F.posexplode(pairs).alias("seq", "e"))
    out = found.select(*keys, "poly", "ring", "seq", F.col("e.a.x").alias("x1"), F.col("e.a.y").alias("y1"), F.col("e.b.x").alias("x2"), F.col("e.b.y").alias("y2"))
    return out.filter("x1 <> x2 OR y1 <> y2")


@F.pandas_udf(DoubleType())
def _geodesic(x1: pd.Series, y1: pd.Series, x2: pd.Series, y2: pd.Series) -> pd.Series:
    return pd.Series(-edge_areas(x1, y1, x2, y2) / 1e6)


def area_km2(edge_rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, area_km2): ellipsoidal area of oriented edges."""
    return edge_rows.withColumn("_km2", _geodesic("x1", "y1", "x2", "y2")).groupBy(*keys).agg(F.abs(F.sum("_km2")).alias("area_km2"))


def polygon_area_sum_km2(edge_rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, area_km2): the sum of the areas of single polygons."""
    each = edge_rows.withColumn("_km2", _geodesic("x1", "y1", "x2", "y2")).groupBy(*keys, "poly").agg(F.abs(F.sum("_km2")).alias("_km2"))
    return each.groupBy(*keys).agg(F.sum("_km2").alias("area_km2"))


def planar(edge_rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, west, south, east, north, planar_area, cx, cy): bounds, area and centroid in coordinate units."""
    first = edge_rows.groupBy(*keys).agg(F.min("x1").alias("west"), F.min("y1").alias("south"), F.max("x1").alias("east"), F.max("y1").alias("north"))
    # an outer join, as its left side is never broadcast: edges that pass for a few MB may be hundreds
    moved = edge_rows.dropna(subset=list(keys)).join(first, list(keys), "left")
    px, qx, py, qy = F.col("x1") - F.col("west"), F.col("x2") - F.col("west"), F.col("y1") - F.col("south"), F.col("y2") - F.col("south")
    cross = px * qy - qx * py
    sums = moved.groupBy(*keys, "west", "south", "east", "north").agg(F.sum(cross).alias("c"), F.sum((px + qx) * cross).alias("mx"), F.sum((py + qy) * cross).alias("my"))
    return sums.select(*keys, "west", "south", "east", "north", (F.col("c") / 2).alias("planar_area"), (F.col("west") + F.col("mx") / (3 * F.col("c"))).alias("cx"), (F.col("south") + F.col("my") / (3 * F.col("c"))).alias("cy"))


def covers(points: DataFrame, edge_rows: DataFrame, point_keys: list[str], join: list[str]) -> DataFrame:
    """(point_keys, covered): is each point (lon, lat) inside or on the geometry whose keys it shares? Points without one are not."""
    on = points.join(edge_rows, join)
    cross = (F.col("x2") - F.col("x1")) * (F.col("lat") - F.col("y1")) - (F.col("lon") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    within = F.col("lon").between(F.least("x1", "x2"), F.greatest("x1", "x2")) & F.col("lat").between(F.least("y1", "y2"), F.greatest("y1", "y2"))
    spans = (F.col("y1") > F.col("lat")) != (F.col("y2") > F.col("lat"))
    right = F.when(F.col("y2") > F.col("y1"), cross > 0).otherwise(cross < 0)
    tested = on.groupBy(*point_keys).agg(F.bool_or((cross == 0) & within).alias("touch"), (F.sum((spans & right).cast("int")) % 2 == 1).alias("inside"))
    return points.select(*point_keys).join(tested, point_keys, "left").select(*point_keys, F.coalesce(F.col("touch") | F.col("inside"), F.lit(False)).alias("covered"))


def dissolve(edge_rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, geom): the union of each key's polygons."""
    return assembled(boundary_edges(edge_rows, *keys), *keys)


def assembled(boundary: DataFrame, *keys: str) -> DataFrame:
    """(keys, geom) of ``boundary_edges``: polygons of each key's union.

    Inner edges have cancelled in a distributed aggregation. Where neighbours' edges don't match (overlaps, vertices on another's edge, a
    shell within another polygon), edges are noded and kept by how many polygons lie on their two sides. That count is the same before and after
    opposite edges cancel, so nothing but the boundary is needed. Unions of up to WHOLE boundary edges are put together in a task each. Larger ones are
    noded in grid cells and their rings ranked in tasks of bounded size: only the finished row is in one place.
    """
    boundary = cut(boundary)
    large = boundary.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") > WHOLE).select(*keys)
    if large.isEmpty():
        return _whole(boundary, *keys)
    # fewer than one in WHOLE of the edges are such keys
    small = _whole(boundary.join(large, list(keys), "left_anti"), *keys)
    return small.unionByName(rings.polygons(arrangement.union_boundary(boundary.join(large, list(keys), "left_semi"), *keys), *keys))


def union_planar(edge_rows: DataFrame, *keys: str) -> DataFrame:
    """``planar`` of each key's union, whose polygons may overlap: from the union's boundary edges, without rings."""
    return planar(arrangement.union_boundary(edge_rows, *keys), *keys)


def _whole(boundary: DataFrame, *keys: str) -> DataFrame:
    keys = list(keys)
    types = {f.name: f.dataType.simpleString() for f in boundary.schema.fields}

    def assemble(rows: pd.DataFrame) -> pd.DataFrame:
        polygons = overlay.assembled(rows[["x1", "y1", "x2", "y2"]].to_numpy(), rows["times"].to_numpy())
        return pd.DataFrame({**{k: [rows[k].iloc[0]] for k in keys}, "geom": [_structs(polygons)]})

    return boundary.groupBy(*keys).applyInPandas(assemble, ", ".join([*(f"`{k}` {types[k]}" for k in keys), f"geom {GEOMETRY}"]))


def repaired(features: DataFrame, *keys: str, geom: str = "geom") -> DataFrame:
    """(keys, geom, repaired, broken): valid geometries as they are; others rebuilt from their linework; ``broken`` where nothing is left."""
    keys = list(keys)
    types = {f.name: f.dataType.simpleString() for f in features.schema.fields}
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys)

    def run(batches):
        for batch in batches:
            geoms, fixed, broken = [], [], []
            for g in batch.column(len(keys)).to_pylist():
                polygons = [[np.array([(p["x"], p["y"]) for p in ring], float).reshape(-1, 2) for ring in polygon] for polygon in (g or [])]
                ok = overlay.is_valid(polygons)
                made = polygons if ok else linework.repaired(polygons)
                geoms.append(_structs(made))
                fixed.append(not ok)
                broken.append(not made)
            columns = [*batch.columns[: len(keys)], pa.array(geoms, batch.schema.field(len(keys)).type), pa.array(fixed), pa.array(broken)]
            yield pa.RecordBatch.from_arrays(columns, [*keys, "geom", "repaired", "broken"])

    return features.select(*keys, geom).mapInArrow(run, f"{schema}, geom {GEOMETRY}, repaired boolean, broken boolean")


def _structs(polygons) -> list:
    return [[[{"x": x, "y": y} for x, y in ring.tolist()] for ring in polygon] for polygon in polygons]
