"""Drainage networks: integrity, nearest project, catchment membership and the project network.

``units`` has (unit, next_down, endo); ``projects`` has (ord, id, hybas_id, ...). Every unit drains into at most one other
(0: none), so the network is a forest and a unit belongs to the local catchment of the first project at or below it.
All walks down are done at once by pointer doubling: one equi-join a round, as many rounds as the logarithm of the depth.

Walks converge on few targets. A round's join has one row a unit on the side that is looked up, so Spark splits a crowded target's
walks over tasks by itself (adaptive skew join) and copies that one row. What is looked up among all units is merged, never broadcast: a million
units take few MB in compressed files, by which Spark judges, and a hundred in the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headwater.plans.lineage import cut


def effective_downstream(units: DataFrame, include_virtual: bool = False) -> DataFrame:
    """(unit, down): virtual links (endo 2) count as none unless they are included."""
    virtual = (F.col("endo") == 2) & ~F.lit(include_virtual)
    return units.select(F.col("unit").cast("long").alias("unit"), F.when(virtual, F.lit(0)).otherwise(F.col("next_down")).cast("long").alias("down"))


def missing_downstream(links: DataFrame) -> DataFrame:
    """Links to units that do not exist."""
    return links.filter("down <> 0").join(links.select(F.col("unit").alias("down")), "down", "left_anti").select("unit", "down")


def _doubled(jumps: DataFrame, stop: str) -> DataFrame:
    """One round: every jump (unit, to) that has not reached ``stop`` becomes the jump of its target."""
    ahead = jumps.select(F.col("unit").alias("to"), F.col("to").alias("further"))
    live = jumps.filter(f"NOT ({stop})").join(ahead.hint("merge"), "to", "left").select("unit", F.coalesce("further", F.lit(0).cast("long")).alias("to"), *[c for c in jumps.columns if c not in ("unit", "to")])
    return jumps.filter(stop).unionByName(live)


def units_into_cycles(links: DataFrame) -> DataFrame:
    """Units whose walk down never ends: those with a jump left after 2**k steps, 2**k at least the number of units."""
    jumps, n, reach = links.select("unit", F.col("down").alias("to")), links.count(), 1
    while True:
        jumps = cut(jumps)
        if reach > n or jumps.filter("to <> 0").isEmpty():
            return jumps.filter("to <> 0").select("unit")
        jumps, reach = _doubled(jumps, "to = 0"), reach * 2


def nearest_project(links: DataFrame, projects: DataFrame) -> DataFrame:
    """(unit, project_unit): the first project unit at or below each unit, 0 where there is none. Links must be acyclic."""
    own = projects.select(F.col("hybas_id").cast("long").alias("unit"), F.lit(True).alias("found")).distinct()
    jumps = links.join(own, "unit", "left").select("unit", F.when(F.col("found"), F.col("unit")).otherwise(F.col("down")).alias("to"))
    done = "to = 0 OR arrived"
    jumps = jumps.join(own.select(F.col("unit").alias("to"), F.col("found").alias("arrived")), "to", "left").select("unit", "to", F.coalesce("arrived", F.lit(False)).alias("arrived"))
    while True:
        jumps = cut(jumps)
        if jumps.filter(f"NOT ({done})").isEmpty():
            return jumps.select("unit", F.col("to").alias("project_unit"))
        ahead = jumps.select(F.col("unit").alias("to"), F.col("to").alias("further"), F.col("arrived").alias("there"))
        live = jumps.filter(f"NOT ({done})").join(ahead.hint("merge"), "to", "left").select("unit", F.coalesce("further", F.lit(0).cast("long")).alias("to"), F.coalesce("there", F.lit(False)).alias("arrived"))
        jumps = jumps.filter(done).unionByName(live)


def local_members(nearest: DataFrame, projects: DataFrame) -> DataFrame:
    """(id, unit): each unit with the first project at or below it."""
    named = projects.select("id", F.col("hybas_id").cast("long").alias("project_unit"))
    return nearest.join(named, "project_unit").select("id", "unit")


def project_edges(links: DataFrame, nearest: DataFrame, projects: DataFrame) -> DataFrame:
    """(ord, id, down): each project with the next project below it, null where there is none."""
    at = projects.select("ord", "id", F.col("hybas_id").cast("long").alias("unit")).join(links, "unit")
    below = nearest.select(F.col("unit").alias("down"), "project_unit")
    named = projects.select(F.col("hybas_id").cast("long").alias("project_unit"), F.col("id").alias("down_id"))
    return at.join(below.hint("merge"), "down", "left").join(named, "project_unit", "left").select("ord", "id", F.col("down_id").alias("down"))


def project_closure(edges: DataFrame) -> DataFrame:
    """(id, above): every pair of a project and one upstream of it, which is the result that ``above`` lists, by repeated composition."""
    pairs = cut(edges.filter("down is not null").select(F.col("down").alias("id"), F.col("id").alias("above")))
    known = pairs.count()
    while known:
        longer = pairs.alias("a").join(pairs.alias("b"), F.col("a.above") == F.col("b.id")).select("a.id", "b.above")
        pairs = cut(pairs.union(longer).distinct())
        before, known = known, pairs.count()
        if known == before:
            break
    return pairs


def total_members(local: DataFrame, closure: DataFrame) -> DataFrame:
    """(id, unit): the local catchments of a project and of all projects above it."""
    above = local.withColumnRenamed("id", "above")
    return local.union(closure.join(above, "above").select("id", "unit"))


def project_network(edges: DataFrame, closure: DataFrame) -> DataFrame:
    """(ord, id, down, up, above): neighbours as arrays in configured order."""
    named = edges.select(F.col("id").alias("above"), F.col("ord").alias("above_ord"), F.col("down").alias("above_down"))
    listed = closure.join(named, "above").groupBy("id").agg(
        F.array_sort(F.collect_list(F.struct("above_ord", "above", (F.col("above_down").eqNullSafe(F.col("id"))).alias("direct")))).alias("rows")
    )
    empty = F.array().cast("array<string>")
    rows = edges.join(listed, "id", "left")
    return rows.select(
        "ord", "id", "down",
        F.coalesce(F.transform(F.filter("rows", lambda r: r["direct"]), lambda r: r["above"]), empty).alias("up"),
        F.coalesce(F.transform("rows", lambda r: r["above"]), empty).alias("above"),
    )


def duplicates(rows: DataFrame, *keys: str) -> DataFrame:
    """Keys that more than one row has, and how many have them."""
    return rows.groupBy(*keys).agg(F.count("*").alias("times")).filter("times > 1")


def check_network(units: DataFrame, links: DataFrame) -> None:
    """Raise ValueError for repeated units, missing downstream units and cycles; the smallest offending unit is named."""
    if row := duplicates(units, "unit").agg(F.min("unit")).first():
        if row[0] is not None:
            raise ValueError(f"Duplicate unit {row[0]}")
    if (row := missing_downstream(links).agg(F.min("down")).first())[0] is not None:
        raise ValueError(f"Missing downstream unit {row[0]}; a complete regional dataset is needed")
    if (row := units_into_cycles(links).agg(F.min("unit")).first())[0] is not None:
        raise ValueError(f"Downstream cycle reached from unit {row[0]}")
