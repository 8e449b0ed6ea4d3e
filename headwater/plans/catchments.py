"""Catchments of configured projects: network, membership, dissolved shapes and measures, as one plan of joins and
aggregations over all projects at once."""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from headwater.config import Config
from headwater.operators import geometry as G
from headwater.operators import graph as N
from headwater.plans.lineage import cut
from headwater.sources.archive import SUFFIXES, sha256_file
from headwater.sources.crs import sidecar_code
from headwater.sources.dbf import fields_of, read_dbf
from headwater.sources.geojson import geometry_json
from headwater.sources.shapefile import decoded_shapes

# Fixed values of the output's metadata.
METADATA = {
    "dataset": "HydroBASINS standard", "area_units": "km2", "area_method": "WGS84 ellipsoidal polygon area",
    "delineation": "Whole outlet subbasin plus upstream units; no dam-wall split",
}
REQUIRED = ("HYBAS_ID", "NEXT_DOWN", "ENDO")


def catchments(units: DataFrame, projects: DataFrame, shapes: DataFrame, part: str = "local", include_virtual: bool = False, selected: list[str] | None = None) -> DataFrame:
    """One row a selected project: network, members, measures and the dissolved ``part``.

    ``shapes`` is (unit, geom), repaired. The selection filters rows at the end: cutoffs and links always use all projects.
    """
    links = cut(N.effective_downstream(units, include_virtual))
    nearest = N.nearest_project(links, projects)
    network = cut(N.project_edges(links, nearest, projects))
    closure = N.project_closure(network)
    local = cut(N.local_members(nearest, projects))
    wanted = projects if selected is None else projects.filter(F.lower("id").isin([s.lower() for s in selected]))
    # the boundary of a total is what is left of those of the local catchments in it, so units are only taken apart once
    parts = cut(G.boundary_edges(G.edges(G.with_shapes(local, shapes), "id"), "id"))
    within = closure.union(projects.select("id", F.col("id").alias("above"))).join(wanted.select("id"), "id", "left_semi")
    whole_parts = within.join(parts.withColumnRenamed("id", "above").hint("merge"), "above").drop("above")
    lines = parts.join(wanted.select("id"), "id", "left_semi").withColumn("part", F.lit("local")).unionByName(G.boundary_edges(whole_parts, "id").withColumn("part", F.lit("total")))
    merged = cut(G.assembled(lines, "id", "part"))
    areas = G.area_km2(G.edges(merged, "id", "part"), "id", "part").groupBy("id").pivot("part", ["local", "total"]).agg(F.first("area_km2"))
    areas = areas.select("id", F.col("local").alias("area_local"), F.col("total").alias("area_total"))
    members = local if part == "local" else N.total_members(local, closure)
    chosen = members.join(wanted.select("id"), "id", "left_semi").groupBy("id").agg(F.array_sort(F.collect_list("unit")).alias("hybas_ids"), F.count("*").alias("unit_count"))
    shape = merged.filter(F.col("part") == part).select("id", "geom")
    rows = wanted.join(N.project_network(network, closure).drop("ord"), "id").join(areas, "id").join(chosen.hint("merge"), "id")
    return G.with_shapes(rows, shape, "id").withColumn("part", F.lit(part)).withColumn("area", F.col(f"area_{part}"))


def check_outlets(projects: DataFrame, units: DataFrame, shapes: DataFrame) -> None:
    """Raise ValueError for the first configured project whose unit is missing or does not cover its point."""
    row = projects.join(units.select(F.col("unit").alias("hybas_id")), "hybas_id", "left_anti").orderBy("ord").first()
    if row:
        raise ValueError(f"{row['id']}: unit {row['hybas_id']} does not exist")
    points = projects.select("ord", "id", F.col("hybas_id").alias("unit"), "lon", "lat")
    row = G.covers(points, G.edges(shapes, "unit"), ["ord", "id", "unit"], ["unit"]).filter("NOT covered").orderBy("ord").first()
    if row:
        raise ValueError(f"{row['id']}: outlet reference point is outside unit {row['unit']}")


#: Order of a feature's own properties, fixed values of the output; configured metadata comes before them.
PROPERTIES = ("id", "name", "lat", "lon", "area", "area_local", "area_total", "up", "above", "down", "part", "hybas_id", "hybas_ids", "unit_count", "outlet_source", "outlet_reference")


def selection(config: Config, project_ids: list[str] | None) -> list[str] | None:
    """Case-folded ids of the projects to put out, None for all."""
    if project_ids is None:
        return None
    known, wanted = {p.id.casefold() for p in config.projects}, {p.casefold() for p in project_ids}
    if not wanted:
        raise ValueError("the list of projects to build must name at least one")
    if strange := sorted(wanted - known):
        raise ValueError(f"no such project is configured: {', '.join(strange)}")
    return sorted(wanted)


def build_features(spark: SparkSession, config: Config, source: str | Path, part: str = "local", project_ids: list[str] | None = None) -> tuple[DataFrame, dict]:
    """(features, metadata) of the catchments of a shapefile's units; any violation is a ValueError.

    Features are rows (ord, project_code, geom and PROPERTIES). Geometry is decoded for the needed units only.
    """
    source = Path(source)
    if part not in ("local", "total"):
        raise ValueError(f"{part} is no part of a catchment: local or total")
    selected = selection(config, project_ids)
    if sidecar_code(source) != 4326:
        raise ValueError("the units must be in WGS84 degrees")
    attributes = source.with_suffix(".dbf")
    if not set(REQUIRED) <= set(fields_of(attributes)[3]):
        raise ValueError(f"the units need the columns {', '.join(REQUIRED)}")
    virtual = config.dataset.include_virtual_connections
    projects = config.frame(spark)
    table = read_dbf(spark, attributes, f"oid long, {', '.join(f'{c} string' for c in REQUIRED)}")
    units = cut(table.select("oid", whole("HYBAS_ID").alias("unit"), whole("NEXT_DOWN").alias("next_down"), whole("ENDO").cast("int").alias("endo")))
    if units.filter("unit is null or next_down is null or endo is null").count():
        raise ValueError("HYBAS_ID, NEXT_DOWN and ENDO must be numbers in every row")
    links = cut(N.effective_downstream(units, virtual))
    N.check_network(units, links)
    missing = projects.join(units.select(F.col("unit").alias("hybas_id")), "hybas_id", "left_anti").orderBy("ord").first()
    if missing:
        raise ValueError(f"{missing['id']}: unit {missing['hybas_id']} does not exist")
    nearest = cut(N.nearest_project(links, projects))
    network = N.project_edges(links, nearest, projects)
    members = N.total_members(N.local_members(nearest, projects), N.project_closure(network))
    if selected is not None:
        members = members.filter(F.lower("id").isin(selected))
    needed = members.select("unit").union(projects.select("hybas_id")).distinct()
    shapes = cut(G.repaired(decoded_shapes(units.join(needed, "unit", "left_semi").select("unit", "oid"), source), "unit"))
    if (row := shapes.filter("broken").agg(F.min("unit")).first())[0] is not None:
        raise ValueError(f"the shape of unit {row[0]} is empty or can't be made valid")
    check_outlets(projects, units, shapes)
    mended = [r["unit"] for r in shapes.filter("repaired").select("unit").orderBy("unit").collect()]
    rows = catchments(units, projects, shapes.select("unit", "geom"), part, virtual, selected)
    rows = cut(rows.withColumnRenamed("source", "outlet_source").withColumnRenamed("reference", "outlet_reference").select("ord", "project_code", "geom", *PROPERTIES).orderBy("ord"))
    meta = {
        **METADATA, "region": config.dataset.region, "level": config.dataset.level, "version": config.dataset.version, "source_url": config.dataset.url,
        "include_virtual_connections": virtual, "local_cutoffs": [p.id for p in config.projects],
        "repaired_geometry_count": len(mended), "repaired_hybas_ids": mended,
        "source_sha256": {s: sha256_file(source.with_suffix(s)) for s in SUFFIXES},
    }
    return rows, meta


def whole(name: str) -> Column:
    """An attribute as a whole number; null where it is none. All 64 bits are exact, whether or not zero decimals are written."""
    exact = F.expr(f"try_cast(regexp_replace(`{name}`, '[.]0*$', '') AS bigint)")
    return F.coalesce(exact, F.expr(f"try_cast(try_cast(`{name}` AS double) AS bigint)"))


def features_of(rows: DataFrame, config: Config) -> Iterator[dict]:
    """GeoJSON features of ``build_features``' rows, in configured order, a partition at a time."""
    extra = {p.id: p.metadata for p in config.projects}
    for row in rows.withColumn("geometry", geometry_json("geom")).drop("geom").orderBy("ord").toLocalIterator():
        yield {"type": "Feature", "id": row["id"], "properties": extra[row["id"]] | {k: row[k] for k in PROPERTIES}, "geometry": json.loads(row["geometry"])}


def build_catchments(spark: SparkSession, config: Config, source: str | Path, part: str = "local", project_ids: list[str] | None = None) -> dict:
    """``build_features`` as one GeoJSON collection, for callers who want it whole; the command line streams it instead."""
    rows, meta = build_features(spark, config, source, part, project_ids)
    return {"type": "FeatureCollection", "metadata": meta, "features": list(features_of(rows, config))}
