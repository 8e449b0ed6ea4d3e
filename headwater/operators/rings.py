"""Rings and polygons from directed boundary edges, by list ranking instead of walking: no task holds a ring.

Every edge finds the one after it at its end, by angle. Edges are dealt to tasks by place (Morton order), where those that follow each other
within a task become paths; only paths, a small share of the edges, go on, and are contracted in turn. If that stops helping, pointer doubling finds for each
path the least path of its ring and how far it is to the ring's end. Rings that pass a vertex more than once
are cut there (each part gets the edge that follows in it) and ranked again.

Holes belong to the shell of their own boundary walk if there is one, else to what lies next to their leftmost vertex on the left: the shell of
that edge's walk, or, if that walk is a hole's too, what lies next to it in turn.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from headwater.plans.lineage import cut

#: Edges that a task puts into paths.
CHUNK = 1 << 18
_LINE = ("x1", "y1", "x2", "y2")


def following(edges: DataFrame, *keys: str) -> DataFrame:
    """(keys, edge, next, x, y): which edge goes on at each edge's end (x, y), the first one clockwise from where it came, so the same inside stays on the left."""
    place = [*keys, "x", "y"]
    arriving = edges.select(*keys, F.col("x2").alias("x"), F.col("y2").alias("y"), F.atan2(F.col("y1") - F.col("y2"), F.col("x1") - F.col("x2")).alias("turn"), "edge", F.lit(None).cast("long").alias("leaving"))
    leaving = edges.select(*keys, F.col("x1").alias("x"), F.col("y1").alias("y"), F.atan2(F.col("y2") - F.col("y1"), F.col("x2") - F.col("x1")).alias("turn"), F.lit(None).cast("long").alias("edge"), F.col("edge").alias("leaving"))
    around = Window.partitionBy(*place).orderBy("turn")
    before = F.last("leaving", ignorenulls=True).over(around.rowsBetween(Window.unboundedPreceding, -1))
    last = F.last("leaving", ignorenulls=True).over(around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = arriving.unionByName(leaving).withColumn("next", F.coalesce(before, last))
    return rows.filter("edge is not null").select(*keys, "edge", "next", "x", "y")


def _morton(bounds) -> list:
    """A column that is close for places that are close: 16 bits of x and y in turn."""
    x0, y0, x1, y1 = bounds

    def spread(c, low, high):
        v = F.floor((F.col(c) - low) / max(high - low, 1e-300) * 65535).cast("int")
        for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
            v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(mask)
        return v.cast("long")

    return spread("x", x0, x1).bitwiseOR(F.shiftleft(spread("y", y0, y1), 1))


def paths(edge: np.ndarray, follows: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(path, place in it, is it the last of it?) of edges and the edges that follow them: maximal paths among these, named by their first edge; a whole ring begins at its least edge.

    An edge takes ``size`` places.
    """
    order = np.argsort(edge)
    at = np.minimum(np.searchsorted(edge, follows, sorter=order), len(edge) - 1)
    there = order[at]
    to = np.where(edge[there] == follows, there, -1)
    entered = np.zeros(len(edge), bool)
    entered[to[to >= 0]] = True
    steps, path, place, last = to.tolist(), np.full(len(edge), -1, np.int64), np.zeros(len(edge), np.int64), np.zeros(len(edge), bool)
    seen = bytearray(len(edge))
    for first in [*np.flatnonzero(~entered).tolist(), *order.tolist()]:
        if seen[first]:
            continue
        walk, k = [], first
        while k >= 0 and not seen[k]:
            seen[k] = 1
            walk.append(k)
            k = steps[k]
        path[walk], place[walk] = edge[first], np.cumsum(size[walk]) - size[walk]
        last[walk[-1]] = True
    return path, place, last


def _contracted(items: DataFrame, n: int, bounds) -> DataFrame:
    """(edge, path, place, further, x, y, size) of ``n`` rows (edge, next, x, y, size): those that follow each other within a task as paths.

    The last row of a path has what follows it, its end and its size; the others have nulls.
    """

    def chain(batches):
        held = [pa.Table.from_batches([b]) for b in batches if b.num_rows]
        if held:
            table = pa.concat_tables(held)
            edge, follows, size = (table.column(c).to_numpy() for c in ("edge", "next", "size"))
            path, place, last = paths(edge, follows, size)
            ends = [pa.array(table.column(c).to_numpy(), mask=~last) for c in ("x", "y")]
            whole = pa.array(place + size, mask=~last)
            yield pa.RecordBatch.from_arrays([pa.array(edge), pa.array(path), pa.array(place), pa.array(follows, mask=~last), *ends, whole], ["edge", "path", "place", "further", "x", "y", "size"])

    tasks = n // CHUNK + 1
    near = items.coalesce(1) if tasks == 1 else items.withColumn("z", _morton(bounds)).repartitionByRange(tasks, "z", "edge")
    return near.select("edge", "next", "x", "y", "size").mapInArrow(chain, "edge long, path long, place long, further long, x double, y double, size long")


def ranked(links: DataFrame) -> DataFrame:
    """(edge, ring, seq, n) of a written table of (edge, next, x, y): each edge's ring (named by a path of it), its place in the ring, and the ring's edges.

    Edges that follow each other in a task become paths, and these again, until CHUNK are left at most and one task has them all. Should a step leave more than half (places
    that tell nothing about what follows), the rest is ranked by pointer doubling.
    """
    n, missing, *bounds = links.agg(F.count("*"), F.count_if(F.col("next").isNull()), F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
    if missing:
        raise ValueError("boundary edges do not close")
    if not n:
        return links.select("edge", F.col("edge").alias("ring"), F.lit(0).cast("long").alias("seq"), F.lit(0).cast("long").alias("n"))
    items, levels, starts = links.select("edge", "next", "x", "y", F.lit(1).cast("long").alias("size")), [], None
    while starts is None:
        placed = cut(_contracted(items, n, bounds))
        # a path goes on with the first edge of another one, or of itself
        ends = placed.filter("further is not null").select(F.col("path").alias("edge"), F.col("further").alias("next"), "x", "y", "size")
        levels.append((placed.select("edge", "path", "place"), ends.filter("edge = next").select(F.col("edge").alias("path"), F.col("edge").alias("ring"), F.lit(0).cast("long").alias("start"), F.col("size").alias("n"))))
        items, before = ends.filter("edge <> next"), n
        n = items.count()
        if not n:
            starts = levels[-1][1]
        elif 2 * n > before:
            rest = items.select(F.col("edge").alias("path"), F.col("next").alias("to"), F.col("size").alias("length"))
            starts = cut(levels[-1][1].unionByName(_path_ranks(cut(rest.coalesce(n // CHUNK + 1)))))
    for k in range(len(levels) - 1, -1, -1):
        placed, _ = levels[k]
        found = placed.join(starts, "path").select("edge", "ring", (F.col("start") + F.col("place")).alias("seq"), "n")
        if k:
            starts = levels[k - 1][1].unionByName(found.select(F.col("edge").alias("path"), "ring", F.col("seq").alias("start"), "n"))
    return found


def _path_ranks(chains: DataFrame) -> DataFrame:
    """(path, ring, start, n) of paths (path, to, length) that form rings: by pointer doubling."""
    state = chains.select("path", "to", F.col("path").alias("ring"))
    while not chains.isEmpty():
        # the least path among twice as many; once no path sees a lesser one, all have seen all of their ring
        ahead = state.select(F.col("path").alias("to"), F.col("to").alias("further"), F.col("ring").alias("theirs"))
        state = cut(state.join(ahead, "to").select("path", F.col("further").alias("to"), F.least("ring", "theirs").alias("ring"), (F.col("theirs") < F.col("ring")).alias("less")))
        if state.filter("less").isEmpty():
            break
    # how far it is to the end of the ring, which is before its least path
    named = chains.join(state.select("path", "ring"), "path")
    rest = named.select("path", "ring", F.when(F.col("to") != F.col("ring"), F.col("to")).alias("to"), F.col("length").alias("left"))
    while True:
        rest = cut(rest)
        if rest.filter("to is not null").isEmpty():
            break
        ahead = rest.select(F.col("path").alias("to"), F.col("to").alias("further"), F.col("left").alias("more"))
        rest = rest.join(ahead, "to", "left").select("path", "ring", F.col("further").alias("to"), (F.col("left") + F.coalesce("more", F.lit(0))).alias("left"))
    whole = rest.filter("path = ring").select("ring", F.col("left").alias("n"))
    return rest.join(whole, "ring").select("path", "ring", (F.col("n") - F.col("left")).alias("start"), "n")


def ring_edges(boundary: DataFrame, *keys: str) -> DataFrame:
    """(keys, edge, x1, y1, x2, y2, walk, ring, seq, n): every boundary edge with its boundary walk, its ring and its place in the ring.

    Rings pass no vertex twice. ``boundary`` has directed edges (keys, x1, y1, x2, y2) with the inside on the left that begin and end equally
    often at each vertex; if they don't, it is a ValueError.
    """
    keys = list(keys)
    edges = cut(boundary.select(*keys, *_LINE).withColumn("edge", F.monotonically_increasing_id()))
    links = cut(following(edges, *keys))
    found = cut(edges.join(ranked(links), "edge"))
    crowded = found.groupBy("ring", "x1", "y1").agg(F.count("*").alias("visits")).filter("visits > 1").select("ring", "x1", "y1")
    pinched = cut(found.join(crowded, ["ring", "x1", "y1"]).select("ring", "x1", "y1", "seq", "n", "edge"))
    if pinched.isEmpty():
        return found.withColumn("walk", F.col("ring"))
    visits = Window.partitionBy("ring", "x1", "y1").orderBy("seq")
    earlier = F.coalesce(F.lag("edge").over(visits), F.last("edge").over(visits.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    # the edge that comes in goes on where the visit before it went out
    again = pinched.select("ring", F.pmod(F.col("seq") - 1, F.col("n")).alias("seq"), earlier.alias("instead"))
    touched = found.join(crowded.select("ring").distinct(), "ring", "left_semi")
    mended = touched.join(again, ["ring", "seq"], "left").select("edge", "instead").join(links, "edge").select("edge", F.coalesce("instead", "next").alias("next"), "x", "y")
    parts = ranked(cut(mended))
    once = found.join(crowded.select("ring").distinct(), "ring", "left_anti").withColumn("walk", F.col("ring"))
    return once.unionByName(touched.select(*keys, "edge", *_LINE, F.col("ring").alias("walk")).join(parts, "edge").select(*once.columns))


def ring_measures(rings: DataFrame, *keys: str) -> DataFrame:
    """(keys, ring, walk, n, area, length): of each ring, its signed area (shells above 0, holes below)."""
    first = rings.filter("seq = 0").select("ring", F.col("x1").alias("ox"), F.col("y1").alias("oy"))
    moved = rings.join(first, "ring")
    ax, ay, bx, by = F.col("x1") - F.col("ox"), F.col("y1") - F.col("oy"), F.col("x2") - F.col("ox"), F.col("y2") - F.col("oy")
    return moved.groupBy(*keys, "ring", "walk", "n").agg((F.sum(ax * by - bx * ay) / 2).alias("area"), F.sum(F.hypot(bx - ax, by - ay)).alias("length"))


def _left_of(rings: DataFrame, walks: DataFrame, keys: list[str]) -> DataFrame:
    """(walk, beside): the walk of the edge next to each of ``walks``' leftmost vertex, to its left, a little above."""
    ends = rings.join(walks, "walk", "left_semi").groupBy(*keys, "walk").agg(F.min(F.struct(F.col("x1").alias("x"), F.col("y1").alias("y"))).alias("at"))
    low, high, n = rings.agg(F.min("y1"), F.max("y1"), F.count("*")).first()
    height = max((high - low) / max(n, 1) ** 0.5, 1e-300)
    strip = lambda c: F.floor((c - F.lit(low)) / F.lit(height)).cast("long")
    probes = ends.select(*keys, "walk", "at.x", "at.y", strip(F.col("at.y")).alias("strip"))
    down, up = F.least("y1", "y2"), F.greatest("y1", "y2")
    strips = probes.select(*keys, "strip").distinct()
    spans = rings.filter("y1 <> y2").select(*keys, *_LINE, F.col("walk").alias("beside"), F.explode(F.sequence(strip(down), strip(up))).alias("strip"))
    met = spans.join(strips, [*keys, "strip"], "left_semi").join(probes, [*keys, "strip"]).filter((F.col("walk") != F.col("beside")) & (down <= F.col("y")) & (up > F.col("y")))
    slope = (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))
    met = met.withColumn("cross", F.col("x1") + (F.col("y") - F.col("y1")) * slope).withColumn("slope", slope).filter("cross < x")
    return met.groupBy("walk").agg(F.max_by("beside", F.struct("cross", "slope")).alias("beside"))


def shells(rings: DataFrame, measures: DataFrame, *keys: str) -> DataFrame:
    """(ring, polygon): the shell of every ring; a shell is its own."""
    outer = measures.filter("area > 0").select("walk", F.col("ring").alias("polygon"))
    inner = measures.filter("area < 0").select("ring", "walk")
    walks = inner.select("walk").distinct().join(outer, "walk", "left_anti")
    walks = cut(walks.coalesce(walks.count() // CHUNK + 1))
    owned = outer
    if not walks.isEmpty():
        to = cut(_left_of(rings, walks, list(keys)).join(outer.select(F.col("walk").alias("beside"), "polygon"), "beside", "left").select("walk", "beside", "polygon"))
        while not to.filter("polygon is null").isEmpty():  # beside another hole: what that one lies in
            ahead = to.select(F.col("walk").alias("beside"), F.col("beside").alias("further"), F.col("polygon").alias("theirs"))
            to = cut(to.filter("polygon is not null").unionByName(to.filter("polygon is null").join(ahead, "beside").select("walk", F.col("further").alias("beside"), F.col("theirs").alias("polygon"))))
        owned = outer.unionByName(to.select("walk", "polygon"))
    return measures.filter("area > 0").select("ring", F.col("ring").alias("polygon")).unionByName(inner.join(owned, "walk").select("ring", "polygon"))


def polygons(boundary: DataFrame, *keys: str) -> DataFrame:
    """(keys, geom): the polygons of directed boundary edges. Only here a ring, and then a geometry, is in one place, as it is in its row of the result."""
    rings = cut(ring_edges(boundary, *keys))
    measures = cut(ring_measures(rings, *keys))
    owner = shells(rings, measures, *keys)
    point = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    lines = rings.groupBy(*keys, "ring").agg(F.array_sort(F.collect_list(F.struct("seq", point("x1", "y1").alias("p")))).alias("steps"))
    closed = lines.select(*keys, "ring", F.transform("steps", lambda s: s["p"]).alias("ring_points")).withColumn("ring_points", F.concat("ring_points", F.slice("ring_points", 1, 1)))
    each = closed.join(owner, "ring").join(measures.select("ring", "area"), "ring")
    grouped = each.groupBy(*keys, "polygon").agg(F.array_sort(F.collect_list(F.struct((F.col("area") < 0).alias("hole"), F.col("ring_points").alias("points")))).alias("parts"))
    corner = lambda f, c: f(F.transform(F.get("parts", 0)["points"], lambda p: p[c]))
    shown = grouped.select(*keys, F.struct(corner(F.array_min, "x").alias("west"), corner(F.array_min, "y").alias("south"), corner(F.array_max, "x").alias("east"), F.transform("parts", lambda r: r["points"]).alias("rings")).alias("one"))
    return shown.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list("one")), lambda o: o["rings"]).alias("geom"))
