"""Union of polygons as a chain of joins: no task holds the boundary of a union, only cells of it.

1. Segments are dealt to the cells of a grid that they pass. Cells with too many are split again, so cells stay small wherever segments crowd.
2. Within a cell every pair that meets is found, and each of the two gets the meeting point as a cut. Cuts of a segment, in order, make pieces.
3. How many polygons cover a place: on one level line of each row of cells the segments that cross it are added up from the left (a
   running sum over cells, not over segments), which gives the count at one place of every cell. From there a straight path inside the cell leads to the middle of
   a piece, and the segments of the cell that it crosses give the count beside the piece.
4. Pieces with a covered and an uncovered side are the boundary of the union, directed with the inside on the left.

Signs come from floating point where a bound on the error allows it and from fractions else. A meeting point that is no vertex is kept as two numbers a
coordinate (some 106 bits), so equal points are equal wherever they were computed; only results are rounded. Places that counts start from are taken to lie a
little right of and above where they are (by an infinitesimal), so no segment passes through them.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from headwater.operators import overlay as O
from headwater.plans.lineage import cut

#: Segments aimed at in a cell; a cell with CROWDED is split into SPLIT by SPLIT, DEEPEST times at most.
CELL, CROWDED, SPLIT, DEEPEST = 256, 2048, 4, 12
#: Where in a cell its count is taken, as shares of its size.
_AT = (0.41421356, 0.27182818)
_LINE = ("x1", "y1", "x2", "y2")
_CELL = ("level", "col", "row")


class Grid:
    """Square cells of ``size`` at ``x``, ``y``; those of each further level are SPLIT times smaller."""

    def __init__(self, x: float, y: float, size: float, far: float):
        self.x, self.y, self.size, self.far = x, y, size, far

    @classmethod
    def of(cls, segments: DataFrame) -> Grid | None:
        low = [F.min(F.least(a, b)) for a, b in (("x1", "x2"), ("y1", "y2"))]
        high = [F.max(F.greatest(a, b)) for a, b in (("x1", "x2"), ("y1", "y2"))]
        n, x0, y0, x1, y1, length = segments.agg(F.count("*"), *low, *high, F.avg(F.greatest(F.abs(F.col("x2") - F.col("x1")), F.abs(F.col("y2") - F.col("y1"))))).first()
        if not n:
            return None
        width, height = max(x1 - x0, length, 1e-300), max(y1 - y0, length, 1e-300)
        size = max((width * height * CELL / n) ** 0.5, 2 * length)
        far = max(abs(x0), abs(x1), abs(y0), abs(y1), size)
        return cls(x0 - 0.1 * size, y0 - 0.1 * size, max(size, far * 1e-9), far)

    def cell_size(self, level: int) -> float:
        return self.size / SPLIT**level

    def place(self, level, col, row) -> tuple[np.ndarray, np.ndarray]:
        """Where the count of a cell is taken."""
        size = self.cell_size(level)
        return self.x + (col + _AT[0]) * size, self.y + (row + _AT[1]) * size

    def cells(self, lines: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of the line, column, row) of all cells that lines pass; a little more than those they touch."""
        size = self.cell_size(level)
        slack = size * 1e-6 + self.far * 1e-12
        turn = lines[:, 0] > lines[:, 2]
        x1, y1, x2, y2 = np.where(turn[:, None], lines[:, [2, 3, 0, 1]], lines).T
        owner, col = O._expanded(np.floor((x1 - slack - self.x) / size).astype(np.int64), np.floor((x2 + slack - self.x) / size).astype(np.int64))
        dx, dy = (x2 - x1)[owner], (y2 - y1)[owner]
        steep = dx <= 8 * slack
        slope = np.where(steep, 0, dy / np.where(steep, 1, dx))
        left, right = self.x + col * size - slack, self.x + (col + 1) * size + slack
        ends = [y1[owner] + (np.clip(x, x1[owner], x2[owner]) - x1[owner]) * slope for x in (left, right)]
        low = np.where(steep, np.minimum(y1, y2)[owner], np.minimum(*ends)) - slack
        high = np.where(steep, np.maximum(y1, y2)[owner], np.maximum(*ends)) + slack
        inner, row = O._expanded(np.floor((low - self.y) / size).astype(np.int64), np.floor((high - self.y) / size).astype(np.int64))
        return owner[inner], col[inner], row


def boundary_edges(edge_rows: DataFrame, *keys: str) -> DataFrame:
    """Edges that remain of an edge-matched coverage when opposite ones cancel; ``times`` over 1 tells of an overlap.

    Rows with ``times`` of their own are boundaries already: those of parts add up to that of the whole.
    """
    forward = (F.col("x1") < F.col("x2")) | ((F.col("x1") == F.col("x2")) & (F.col("y1") < F.col("y2")))
    low, high = F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y"))
    once = F.col("times") if "times" in edge_rows.columns else F.lit(1)
    signed = edge_rows.select(*keys, F.when(forward, low).otherwise(high).alias("p"), F.when(forward, high).otherwise(low).alias("q"), F.when(forward, once).otherwise(-once).alias("sign"))
    left = signed.groupBy(*keys, "p", "q").agg(F.sum("sign").alias("net")).filter("net <> 0")
    pick = lambda a, b, c: F.when(F.col("net") > 0, F.col(f"{a}.{c}")).otherwise(F.col(f"{b}.{c}"))
    return left.select(*keys, pick("p", "q", "x").alias("x1"), pick("p", "q", "y").alias("y1"), pick("q", "p", "x").alias("x2"), pick("q", "p", "y").alias("y2"), F.abs("net").cast("int").alias("times"))


def _lines(batch) -> np.ndarray:
    return np.column_stack([batch.column(c).to_numpy() for c in _LINE]).astype(float)


def _fraction(high: float, low: float = 0.0) -> Fraction:
    return Fraction(float(high)) + Fraction(float(low))


def _two(value) -> tuple[float, float]:
    high = float(value)
    return high, float(Fraction(value) - Fraction(high))


def _exact_turn(a, b, c) -> int:
    d = (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    return (d > 0) - (d < 0)


def _side(lines: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """On which side of its line (1: left, -1: right) each counting place lies; one on the line itself lies right of it and above."""
    turn = O._turn(*lines.T, x, y)
    for k in np.flatnonzero(turn == 2).tolist():
        a = [Fraction(float(v)) for v in lines[k]]
        turn[k] = _exact_turn(a[:2], a[2:], (Fraction(float(x[k])), Fraction(float(y[k]))))
    dx, dy = lines[:, 2] - lines[:, 0], lines[:, 3] - lines[:, 1]
    return np.where(turn != 0, turn, np.where(dy != 0, np.where(dy < 0, 1, -1), np.where(dx > 0, 1, -1))).astype(np.int8)


def crossings(lines: np.ndarray, start: np.ndarray, end: np.ndarray, slack: float, exact_end=None) -> np.ndarray:
    """What the count changes by on the way from ``start`` to ``end`` through each line (row by row): 1 into its left side, -1 out of it, 0 past it.

    ``slack`` bounds what an end is off its true place, which ``exact_end(k)`` gives; without that both are counting places.
    """
    x1, y1, x2, y2 = lines.T
    px, py, qx, qy = *start.T, *end.T
    out = np.zeros(len(lines), np.int8)
    near = (np.minimum(x1, x2) <= np.maximum(px, qx) + slack) & (np.maximum(x1, x2) >= np.minimum(px, qx) - slack)
    near &= (np.minimum(y1, y2) <= np.maximum(py, qy) + slack) & (np.maximum(y1, y2) >= np.minimum(py, qy) - slack)
    at = np.flatnonzero(near)
    if not len(at):
        return out
    lines, x1, y1, x2, y2, px, py, qx, qy = lines[at], x1[at], y1[at], x2[at], y2[at], px[at], py[at], qx[at], qy[at]

    def sign(ax, ay, bx, by, cx, cy, reach):
        left, right = (bx - ax) * (cy - ay), (by - ay) * (cx - ax)
        det = left - right
        return np.where(np.abs(det) > O._ROUNDING * (np.abs(left) + np.abs(right)) + reach, np.sign(det), 2).astype(np.int8)

    ends = [sign(px, py, qx, qy, x, y, 4 * slack * (np.abs(x - px) + np.abs(y - py))) for x, y in ((x1, y1), (x2, y2))]
    own = _side(lines, px, py)
    other = sign(x1, y1, x2, y2, qx, qy, 4 * slack * (np.abs(x2 - x1) + np.abs(y2 - y1)))
    apart = (np.abs(ends[0]) == 1) & (ends[0] == ends[1])
    open_ = ~apart & (other != own) & ((ends[0] == 2) | (ends[1] == 2) | (other == 2))
    for k in np.flatnonzero(open_).tolist():
        a, b = (Fraction(float(x1[k])), Fraction(float(y1[k]))), (Fraction(float(x2[k])), Fraction(float(y2[k])))
        p = Fraction(float(px[k])), Fraction(float(py[k]))
        q = exact_end(int(at[k])) if exact_end else (Fraction(float(qx[k])), Fraction(float(qy[k])))
        for e, v in zip(ends, (a, b), strict=True):  # a vertex on the way is passed as the start's shift has it
            e[k] = _exact_turn(p, q, v) or (((q[1] > p[1]) - (q[1] < p[1])) or ((q[0] < p[0]) - (q[0] > p[0])))
        other[k] = _exact_turn(a, b, q) if exact_end else _side(lines[k : k + 1], qx[k : k + 1], qy[k : k + 1])[0]
    crossed = (ends[0] != ends[1]) & (own != other) & (other != 0)
    out[at] = np.where(crossed, -own, 0)
    return out


def _schema(frame: DataFrame, names) -> str:
    types = dict(frame.dtypes)
    return ", ".join(f"`{n}` {types[n]}" for n in names)


def _dealt(segments: DataFrame, keys: list[str], grid: Grid, level: int, within: bool) -> DataFrame:
    """``segments`` once for every cell of ``level`` that they pass; with ``within``, only for cells of the (col, row) they come with."""
    names = [*keys, "seg", *_LINE, "w"]

    def deal(batches):
        for batch in batches:
            owner, col, row = grid.cells(_lines(batch), level)
            if within:
                inside = (col // SPLIT == batch.column("col").to_numpy()[owner]) & (row // SPLIT == batch.column("row").to_numpy()[owner])
                owner, col, row = owner[inside], col[inside], row[inside]
            taken = batch.select(names).take(pa.array(owner))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(np.full(len(owner), level, np.int32)), pa.array(col), pa.array(row)], [*names, *_CELL])

    return segments.mapInArrow(deal, f"{_schema(segments, names)}, level int, col long, row long")


def _first_counts(segments: DataFrame, cells: DataFrame, keys: list[str], grid: Grid) -> DataFrame:
    """(keys, level, col, row, covered) of the cells of level 0: running sums, along each row of cells, of the segments that cross the row's level line."""

    def cross(batches):
        for batch in batches:
            lines, w = _lines(batch), batch.column("w").to_numpy()
            y1, y2 = lines[:, 1], lines[:, 3]
            _, base = grid.place(0, 0, 0)
            low = np.floor((np.minimum(y1, y2) - base) / grid.size).astype(np.int64) - 1
            owner, row = O._expanded(low, np.floor((np.maximum(y1, y2) - base) / grid.size).astype(np.int64) + 1)
            y = grid.place(0, 0, row)[1]
            hit = (y1[owner] <= y) != (y2[owner] <= y)
            owner, row, y = owner[hit], row[hit], y[hit]
            x1, a, x2, b = lines[owner].T
            x = x1 + (x2 - x1) * ((y - a) / (b - a))
            col = np.ceil((x - grid.x) / grid.size - _AT[0] - 1e-6).astype(np.int64) - 1
            sign = np.where(b < a, 1, -1)  # going right, a falling line is entered
            for _ in range(3):  # the first place that lies right of the line
                beyond = _side(lines[owner], grid.place(0, col, row)[0], y) == sign
                col = np.where(beyond, col, col + 1)
            taken = batch.select(keys).take(pa.array(owner))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(col), pa.array(row), pa.array(w[owner] * sign)], [*keys, "col", "row", "change"])

    typed = _schema(segments, keys)
    crossed = segments.mapInArrow(cross, f"{typed + ', ' if keys else ''}col long, row long, change long").groupBy(*keys, "row", "col").agg(F.sum("change").alias("change"))
    every = crossed.withColumn("here", F.lit(False)).unionByName(cells.select(*keys, "row", "col", F.lit(0).cast("long").alias("change"), F.lit(True).alias("here")))
    every = every.groupBy(*keys, "row", "col").agg(F.sum("change").alias("change"), F.bool_or("here").alias("here"))
    running = F.sum("change").over(Window.partitionBy(*keys, "row").orderBy("col").rowsBetween(Window.unboundedPreceding, 0))
    return every.withColumn("covered", running).filter("here").select(*keys, F.lit(0).alias("level"), "col", "row", "covered")


def _split_counts(crowded: DataFrame, counts: DataFrame, keys: list[str], grid: Grid, level: int) -> DataFrame:
    """The counts of the parts of split cells: their own, and what is crossed within them on the way to each part's place."""
    parts = SPLIT * SPLIT

    def walk(batches):
        for batch in batches:
            n = batch.num_rows
            lines, w = _lines(batch), batch.column("w").to_numpy()
            col, row = (batch.column(c).to_numpy() for c in ("col", "row"))
            owner, k = np.repeat(np.arange(n), parts), np.tile(np.arange(parts), n)
            to_col, to_row = col[owner] * SPLIT + k % SPLIT, row[owner] * SPLIT + k // SPLIT
            start, end = np.column_stack(grid.place(level, col, row))[owner], np.column_stack(grid.place(level + 1, to_col, to_row))
            change = crossings(lines[owner], start, end, 0.0) * w[owner]
            hit = np.flatnonzero(change)
            taken = batch.select(keys).take(pa.array(owner[hit]))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(to_col[hit]), pa.array(to_row[hit]), pa.array(change[hit])], [*keys, "col", "row", "change"])

    typed = _schema(crowded, keys)
    changes = crowded.mapInArrow(walk, f"{typed + ', ' if keys else ''}col long, row long, change long")
    children = F.explode(F.array(*[F.struct(F.lit(k % SPLIT).alias("a"), F.lit(k // SPLIT).alias("b")) for k in range(parts)])).alias("part")
    base = counts.select(*keys, "col", "row", "covered", children).select(*keys, (F.col("col") * SPLIT + F.col("part.a")).alias("col"), (F.col("row") * SPLIT + F.col("part.b")).alias("row"), F.col("covered").alias("change"))
    return base.unionByName(changes).groupBy(*keys, "col", "row").agg(F.sum("change").alias("covered")).select(*keys, F.lit(level + 1).alias("level"), "col", "row", "covered")


def _cells(segments: DataFrame, keys: list[str], grid: Grid) -> list[tuple[int, DataFrame, DataFrame]]:
    """(level, segments by cell, counts by cell) of all cells that are not split further."""
    found, level = [], 0
    dealt = cut(_dealt(segments, keys, grid, 0, False))
    sizes = dealt.groupBy(*keys, "col", "row").agg(F.count("*").alias("n"))
    counts = cut(_first_counts(segments, sizes, keys, grid))
    while True:
        cell = [*keys, "col", "row"]
        crowded = cut(sizes.filter(F.col("n") > CROWDED).select(*cell))
        if level == DEEPEST or crowded.isEmpty():
            return [*found, (level, dealt, counts)]
        found.append((level, dealt.join(crowded, cell, "left_anti"), counts.join(crowded, cell, "left_anti")))
        split = dealt.join(crowded, cell, "left_semi")
        counts = cut(_split_counts(split, counts.join(crowded, cell, "left_semi"), keys, grid, level))
        level += 1
        dealt = cut(_dealt(split, keys, grid, level, True))
        sizes = dealt.groupBy(*keys, "col", "row").agg(F.count("*").alias("n"))


def cell_cuts(seg: np.ndarray, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(segment, (x, y, x's rest, y's rest)) of every point inside a segment at which another one of the cell meets it."""
    owners, points = [], []

    def add(own, x, y, low_x=None, low_y=None):
        x, y = np.asarray(x, float), np.asarray(y, float)
        inside = ((x != lines[own, 0]) | (y != lines[own, 1])) & ((x != lines[own, 2]) | (y != lines[own, 3]))
        rest = [np.zeros(len(x)) if v is None else np.asarray(v, float) for v in (low_x, low_y)]
        inside |= (rest[0] != 0) | (rest[1] != 0)
        owners.append(own[inside])
        points.append(np.column_stack([x, y, *rest])[inside])

    for i, j in O._suspects(lines):
        s, t = lines[i].T, lines[j].T
        d = [O._turn(*s, t[0], t[1]), O._turn(*s, t[2], t[3]), O._turn(*t, s[0], s[1]), O._turn(*t, s[2], s[3])]
        sure = (np.abs(np.array(d)) < 2).all(0)
        for own, turns, mine, other in ((i, d[:2], s, t), (j, d[2:], t, s)):  # ends of one on the other
            for turn, x, y in ((turns[0], other[0], other[1]), (turns[1], other[2], other[3])):
                within = sure & (turn == 0) & (np.minimum(mine[0], mine[2]) <= x) & (x <= np.maximum(mine[0], mine[2])) & (np.minimum(mine[1], mine[3]) <= y) & (y <= np.maximum(mine[1], mine[3]))
                add(own[within], x[within], y[within])
        proper = sure & (d[0] * d[1] == -1) & (d[2] * d[3] == -1)
        for a, b, first, second in ((i, j, s, t), (j, i, t, s)):  # level and upright lines meet in coordinates of theirs
            square = proper & (first[1] == first[3]) & (second[0] == second[2])
            add(a[square], second[0][square], first[1][square])
            add(b[square], second[0][square], first[1][square])
            proper &= ~square
        left = np.flatnonzero(proper | ~sure)
        for m, n in zip(i[left].tolist(), j[left].tolist(), strict=True):
            for x, y in O._meetings(O._exact(lines[m]), O._exact(lines[n])):
                (hx, lx), (hy, ly) = _two(x), _two(y)
                add(np.array([m, n]), [hx, hx], [hy, hy], [lx, lx], [ly, ly])
    if not owners:
        return np.zeros(0, np.int64), np.zeros((0, 4))
    return seg[np.concatenate(owners)], np.concatenate(points) + 0.0


def _pieces(segments: DataFrame, dealt: list[DataFrame], keys: list[str]) -> DataFrame:
    """(keys, p, q, net, owners): distinct pieces p < q of all segments, what the count is higher on their left, and their segments; those without effect are left out."""

    def meet(key, table):
        table = table.combine_chunks()
        seg, points = cell_cuts(table.column("seg").to_numpy(), _lines(table))
        own = [pa.array([v.as_py()] * len(seg), v.type) for v in key[: len(keys)]]
        return pa.Table.from_arrays([*own, pa.array(seg), *(pa.array(points[:, k]) for k in range(4))], [*keys, "seg", "x", "y", "rx", "ry"])

    typed = _schema(segments, [*keys, "seg"])
    cuts = None
    for part in dealt:
        found = part.select(*keys, *_CELL, "seg", *_LINE).groupBy(*keys, *_CELL).applyInArrow(meet, f"{typed}, x double, y double, rx double, ry double")
        cuts = found if cuts is None else cuts.unionByName(found)
    cuts = cut(cuts.distinct())
    point = lambda x, y, rx=F.lit(0.0), ry=F.lit(0.0): F.struct(x.alias("x"), y.alias("y"), rx.alias("rx"), ry.alias("ry"))
    ends = segments.select(*keys, "seg", "w", *_LINE, point(F.col("x1"), F.col("y1")).alias("a"), point(F.col("x2"), F.col("y2")).alias("b"))
    cut_ones = cuts.select("seg").distinct()
    whole = ends.join(cut_ones, "seg", "left_anti").select(*keys, "seg", "w", "a", "b")
    broken = ends.join(cut_ones, "seg", "left_semi")
    flat = F.abs(F.col("x2") - F.col("x1")) >= F.abs(F.col("y2") - F.col("y1"))
    forward = F.when(flat, F.signum(F.col("x2") - F.col("x1"))).otherwise(F.signum(F.col("y2") - F.col("y1")))
    inner = cuts.select("seg", point(*(F.col(c) for c in ("x", "y", "rx", "ry"))).alias("at"))
    points = broken.select(*keys, "seg", "w", flat.alias("flat"), forward.alias("forward"), F.explode(F.array("a", "b")).alias("at"))
    points = points.unionByName(broken.join(inner, "seg").select(*keys, "seg", "w", flat.alias("flat"), forward.alias("forward"), "at"))
    order = [F.col("forward") * F.when(F.col("flat"), F.col(f"at.{x}")).otherwise(F.col(f"at.{y}")) for x, y in (("x", "y"), ("rx", "ry"))]
    parts = points.withColumn("b", F.lead("at").over(Window.partitionBy("seg").orderBy(*order))).filter("b is not null").select(*keys, "seg", "w", F.col("at").alias("a"), "b")
    every = whole.unionByName(parts).withColumn("up", F.col("a") < F.col("b"))
    either = lambda x, y: F.when(F.col("up"), F.col(x)).otherwise(F.col(y))
    found = every.select(*keys, "seg", either("a", "b").alias("p"), either("b", "a").alias("q"), F.when(F.col("up"), F.col("w")).otherwise(-F.col("w")).alias("w"))
    return found.groupBy(*keys, "p", "q").agg(F.sum("w").alias("net"), F.collect_set("seg").alias("owners")).filter("net <> 0")


def covered_sides(seg, lines, w, p, q, net, owners, place, covered, far) -> np.ndarray:
    """(left, right) of each piece p, q (rows of x, y and their rests): the numbers of polygons beside it, from the count at a place of the cell."""
    n, m = len(p), len(lines)
    middle = (p[:, :2] + q[:, :2]) / 2
    order = np.argsort(seg)
    mine = np.repeat(np.arange(n), [len(o) for o in owners])
    own_seg = np.concatenate(owners) if n else np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(seg, own_seg, sorter=order), max(m - 1, 0))
    near = np.full(n, covered, np.int64)
    start, slack = np.array(place, float), 8 * O._MIDDLE * far
    step = max(O.PAIRS // max(m, 1), 1)
    for a in range(0, n, step):
        b = min(a + step, n)
        k, j = np.repeat(np.arange(a, b), m), np.tile(np.arange(m), b - a)
        others = np.ones(len(k), bool)
        here = (mine >= a) & (mine < b)
        there = order[at[here]]
        same = seg[there] == own_seg[here]
        others[(mine[here][same] - a) * m + there[same]] = False
        k, j = k[others], j[others]
        def exactly(i, k=k):
            return tuple((_fraction(p[k[i], c], p[k[i], c + 2]) + _fraction(q[k[i], c], q[k[i], c + 2])) / 2 for c in (0, 1))

        change = crossings(lines[j], np.broadcast_to(start, (len(k), 2)), middle[k], slack, exactly) * w[j]
        near[a:b] += np.bincount(k - a, change, b - a).astype(np.int64)
    left_near = _side(np.column_stack([p[:, :2], q[:, :2]]), np.full(n, start[0]), np.full(n, start[1])) > 0
    for k in np.flatnonzero((p[:, 2:] != 0).any(1) | (q[:, 2:] != 0).any(1)).tolist():
        ends = [tuple(_fraction(v[k, c], v[k, c + 2]) for c in (0, 1)) for v in (p, q)]
        left_near[k] = (_exact_turn(*ends, tuple(map(Fraction, start.tolist()))) or (1 if left_near[k] else -1)) > 0
    return np.column_stack([np.where(left_near, near, near + net), np.where(left_near, near - net, near)])


def union_boundary(edge_rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, x1, y1, x2, y2, times): directed boundary of the union of each key's polygons, the inside on the left.

    ``edge_rows`` are directed edges of valid polygons (keys, x1, y1, x2, y2), with ``times`` where opposite ones have cancelled already.
    """
    keys = list(keys)
    left = boundary_edges(edge_rows, *keys)
    zero = [(F.col(c) + F.lit(0.0)).alias(c) for c in _LINE]
    segments = cut(left.select(*keys, *zero, F.col("times").cast("long").alias("w")).withColumn("seg", F.monotonically_increasing_id()))
    grid = Grid.of(segments)
    if grid is None:
        return left
    cells = _cells(segments, keys, grid)
    pieces = cut(_pieces(segments, [dealt for _, dealt, _ in cells], keys))

    def cover(key, table, here):
        lines, seg, w = _lines(table), table.column("seg").to_numpy(), table.column("w").to_numpy()
        p, q = (np.column_stack([here.column(f"{v}{c}").to_numpy() for c in ("x", "y", "rx", "ry")]) if here.num_rows else np.zeros((0, 4)) for v in "pq")
        level, col, row = (v.as_py() for v in key[len(keys) :])
        net = here.column("net").to_numpy()
        owners = [np.asarray(o, np.int64) for o in here.column("owners").to_pylist()]
        covered = here.column("covered")[0].as_py() if here.num_rows else 0
        sides = covered_sides(seg, lines, w, p, q, net, owners, grid.place(level, col, row), covered, grid.far) > 0
        kept = sides[:, 0] != sides[:, 1]
        forward = sides[kept, 0]
        p, q = p[kept, :2], q[kept, :2]
        a, b = np.where(forward[:, None], p, q), np.where(forward[:, None], q, p)
        own = [pa.array([v.as_py()] * len(a), v.type) for v in key[: len(keys)]]
        return pa.Table.from_arrays([*own, *(pa.array(v) for v in (a[:, 0], a[:, 1], b[:, 0], b[:, 1]))], [*keys, *_LINE])

    middle = [(F.col(f"p.{c}") + F.col(f"q.{c}")) / 2 for c in ("x", "y")]
    shown = [F.col(f"{v}.{c}").alias(f"{v}{c}") for v in "pq" for c in ("x", "y", "rx", "ry")]
    typed, found = _schema(segments, [*keys, *_LINE]), None
    for level, dealt, counts in cells:
        size = grid.cell_size(level)
        at = [F.floor((m - F.lit(o)) / F.lit(size)).cast("long") for m, o in zip(middle, (grid.x, grid.y), strict=True)]
        own = pieces.select(*keys, at[0].alias("col"), at[1].alias("row"), *shown, "net", "owners").join(counts, [*keys, "col", "row"])
        cell = [*keys, *_CELL]
        part = dealt.select(*cell, "seg", *_LINE, "w").groupBy(*cell).cogroup(own.select(*cell, *(f"{v}{c}" for v in "pq" for c in ("x", "y", "rx", "ry")), "net", "owners", "covered").groupBy(*cell)).applyInArrow(cover, typed)
        found = part if found is None else found.unionByName(part)
    return boundary_edges(found.filter("x1 <> x2 OR y1 <> y2"), *keys)  # slivers that rounding closes go
