"""Exact planar overlay of sets of rings: validity, union of overlapping or unmatched polygons, and the
assembly of boundary edges into polygons.

Signs are taken in floating point where a bound on the error allows it, over whole arrays, and from fractions for the few
that are left, so no tolerance is involved. Segments meet by way of a grid as fine as they are, and rays only pass the segments of
their own strip, so the work grows little faster than the number of segments; memory is bounded by chunks of pairs.
"""

from __future__ import annotations

from collections import defaultdict
from fractions import Fraction

import numpy as np

#: Pairs of segments that are tested at a time.
PAIRS = 2_000_000
#: Bounds on the rounding of an orientation's sign (Shewchuk 1997), and of a midpoint's coordinates.
_ROUNDING, _MIDDLE = 4e-16, 5e-16


def _expanded(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, number) of every number from ``first`` to ``last`` of each owner."""
    counts = last - first + 1
    owner = np.repeat(np.arange(len(first)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts) + first[owner]


def _near_pairs(segments: np.ndarray):
    """Chunks (i, j) of pairs of segments whose boxes meet, i < j; a pair may come more than once."""
    n = len(segments)
    low, high = np.minimum(segments[:, :2], segments[:, 2:]), np.maximum(segments[:, :2], segments[:, 2:])
    base, extent = low.min(0), np.maximum(high.max(0) - low.min(0), 1e-300)
    size = np.maximum(np.maximum(extent / np.ceil(np.sqrt(n)), 2 * (high - low).mean(0)), extent * 1e-9)
    while True:
        a, b = ((low - base) // size).astype(np.int64), ((high - base) // size).astype(np.int64)
        if ((b - a + 1).prod(1)).sum() <= 8 * n:
            break
        size = size * 2
    owner, column = _expanded(a[:, 0], b[:, 0])
    inner, row = _expanded(a[owner, 1], b[owner, 1])
    owner, cell = owner[inner], column[inner] * (int(b[:, 1].max()) + 1) + row
    order = np.lexsort((owner, cell))
    owner, cell = owner[order], cell[order]
    ends = np.searchsorted(cell, cell, "right")
    ahead = ends - np.arange(len(cell)) - 1  # later members of the same cell
    total = np.cumsum(ahead)
    at = 0
    while at < len(cell):
        stop = max(int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS, "right")), at + 1)
        which, other = _expanded(np.arange(at, stop) + 1, ends[at:stop] - 1)
        i, j = owner[at + which], owner[other]
        meet = (low[i] <= high[j]).all(1) & (high[i] >= low[j]).all(1)
        i, j = i[meet], j[meet]
        yield np.minimum(i, j), np.maximum(i, j)
        at = stop


def _turn(ax, ay, bx, by, cx, cy) -> np.ndarray:
    """Sign of the turn a, b, c: -1, 0, 1, or 2 where rounding leaves it open."""
    left, right = (bx - ax) * (cy - ay), (by - ay) * (cx - ax)
    det = left - right
    sure = (np.abs(det) > _ROUNDING * (np.abs(left) + np.abs(right))) | ((left == 0) & (right == 0))
    return np.where(sure, np.sign(det), 2).astype(np.int8)


def _exact(segment) -> tuple:
    return tuple(Fraction(float(v)) for v in segment)


def _cross(ax, ay, bx, by, cx, cy):
    return (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)


def _meetings(s, t) -> list[tuple]:
    """Points where two exact segments meet: one, or the ends of what they share."""
    d1, d2 = _cross(*s, t[0], t[1]), _cross(*s, t[2], t[3])
    d3, d4 = _cross(*t, s[0], s[1]), _cross(*t, s[2], s[3])
    within = lambda q, x, y: min(q[0], q[2]) <= x <= max(q[0], q[2]) and min(q[1], q[3]) <= y <= max(q[1], q[3])
    if d1 == d2 == 0:
        return list({p for p in ((t[0], t[1]), (t[2], t[3])) if within(s, *p)} | {p for p in ((s[0], s[1]), (s[2], s[3])) if within(t, *p)})
    out = {p for d, p in ((d1, (t[0], t[1])), (d2, (t[2], t[3]))) if d == 0 and within(s, *p)}
    out |= {p for d, p in ((d3, (s[0], s[1])), (d4, (s[2], s[3]))) if d == 0 and within(t, *p)}
    if not out and (d1 > 0) != (d2 > 0) and (d3 > 0) != (d4 > 0) and 0 not in (d1, d2, d3, d4):
        r = d3 / (d3 - d4)
        out = {(s[0] + r * (s[2] - s[0]), s[1] + r * (s[3] - s[1]))}
    return list(out)


def _suspects(segments: np.ndarray):
    """Chunks (i, j) of near pairs that may meet anywhere but at an end of both."""
    for i, j in _near_pairs(segments):
        s, t = segments[i].T, segments[j].T
        shared = [(s[0] == t[0]) & (s[1] == t[1]), (s[0] == t[2]) & (s[1] == t[3]), (s[2] == t[0]) & (s[3] == t[1]), (s[2] == t[2]) & (s[3] == t[3])]
        ends = sum(x.astype(np.int8) for x in shared)
        d = [_turn(*s, t[0], t[1]), _turn(*s, t[2], t[3]), _turn(*t, s[0], s[1]), _turn(*t, s[2], s[3])]
        apart = np.zeros(len(i), bool)
        for a, b in ((d[0], d[1]), (d[2], d[3])):
            apart |= (a == b) & (np.abs(a) == 1)
        # one end in common: they part there unless they run the same way
        at_second = shared[2] | shared[3]
        px, py, qx, qy = np.where(at_second, s[2], s[0]), np.where(at_second, s[3], s[1]), np.where(at_second, s[0], s[2]), np.where(at_second, s[1], s[3])
        theirs = shared[1] | shared[3]
        rx, ry = np.where(theirs, t[0], t[2]), np.where(theirs, t[1], t[3])
        turn = _turn(px, py, qx, qy, rx, ry)
        parting = (ends == 1) & ((np.abs(turn) == 1) | ((turn == 0) & ((qx - px) * (rx - px) + (qy - py) * (ry - py) < 0)))
        open_ = ~parting & ~((ends == 0) & apart)
        yield i[open_], j[open_]


def crossing(segments: np.ndarray) -> bool:
    """Do two segments meet anywhere but at ends of both?"""
    if len(segments) < 2:
        return False
    for left, right in _suspects(segments):
        for i, j in zip(left.tolist(), right.tolist(), strict=True):
            s, t = _exact(segments[i]), _exact(segments[j])
            meet = _meetings(s, t)
            if len(meet) > 1 or any(p not in (s[:2], s[2:]) or p not in (t[:2], t[2:]) for p in meet):
                return True
    return False


def _noded(segments: np.ndarray) -> list[tuple]:
    """Distinct undirected pieces ((x, y), (x, y)) between all meeting points; coordinates are fractions where a segment is cut."""
    points: dict[int, set] = {}
    for left, right in _suspects(segments):
        for i, j in zip(left.tolist(), right.tolist(), strict=True):
            s, t = _exact(segments[i]), _exact(segments[j])
            for p in _meetings(s, t):
                points.setdefault(i, {s[:2], s[2:]}).add(p)
                points.setdefault(j, {t[:2], t[2:]}).add(p)
    pieces = set()
    for k, s in enumerate(segments.tolist()):
        line = sorted(points[k]) if k in points else sorted([(s[0], s[1]), (s[2], s[3])])
        pieces.update(zip(line[:-1], line[1:], strict=True))  # a fraction equals, and hashes like, the float of its value
    return sorted(pieces)


def _sides(pieces: list[tuple], segments: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What lies left and right of each piece: the weights of the segments that a ray from its middle crosses, upward ones counted, downward ones taken off.

    Pieces end wherever they meet a segment. Flat pieces are seen with x and y exchanged.
    """
    near, far = np.zeros(len(pieces)), np.zeros(len(pieces))
    floats = np.array([[float(v) for p in piece for v in p] for piece in pieces]).reshape(-1, 4)
    flat = np.array([a[1] == b[1] for a, b in pieces], bool)
    for turned in (False, True):
        mine = np.flatnonzero(flat == turned)
        axes = [1, 0, 3, 2] if turned else [0, 1, 2, 3]
        lines = segments[:, axes]
        use = np.flatnonzero(lines[:, 1] != lines[:, 3])
        if not len(mine) or not len(use):
            continue
        lines, w = lines[use], weight[use] * np.sign(lines[use, 3] - lines[use, 1])
        m = floats[mine][:, axes]
        mx, my = (m[:, 0] + m[:, 2]) / 2, (m[:, 1] + m[:, 3]) / 2
        slack = _MIDDLE * max(np.abs(lines).max(), 1e-300)
        low, high = np.minimum(lines[:, 1], lines[:, 3]) - slack, np.maximum(lines[:, 1], lines[:, 3]) + slack
        base, extent = low.min(), max(high.max() - low.min(), 1e-300)
        size = max(extent / len(lines), 2 * (high - low).mean(), extent * 1e-9)
        owner, strip = _expanded(((low - base) // size).astype(np.int64), ((high - base) // size).astype(np.int64))
        order = np.argsort(strip, kind="stable")
        owner, strip = owner[order], strip[order]
        wanted = ((my - base) // size).astype(np.int64)
        first, last = np.searchsorted(strip, wanted, "left"), np.searchsorted(strip, wanted, "right") - 1
        total, at = np.cumsum(last - first + 1), 0
        while at < len(mine):
            stop = max(int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS, "right")), at + 1)
            k, place = _expanded(first[at:stop], last[at:stop])
            k, g = k + at, owner[place]
            x1, y1, x2, y2 = lines[g].T
            px, py = mx[k], my[k]
            clear = (np.abs(y1 - py) > slack) & (np.abs(y2 - py) > slack)
            spans = (y1 > py) != (y2 > py)
            left, right = (x2 - x1) * (py - y1), (y2 - y1) * (px - x1)
            det = (left - right) * np.sign(y2 - y1)
            sure = clear & (~spans | (np.abs(det) > _ROUNDING * (np.abs(left) + np.abs(right)) + slack * (np.abs(x2 - x1) + np.abs(y2 - y1))))
            beyond = sure & spans & (det > 0)
            far += np.bincount(mine[k[beyond]], w[g[beyond]], len(pieces))
            near += np.bincount(mine[k[beyond]], w[g[beyond]], len(pieces))
            for a, b in zip(k[~sure].tolist(), g[~sure].tolist(), strict=True):
                (ax, ay), (bx, by) = pieces[mine[a]]
                qx, qy = (Fraction(ax) + Fraction(bx)) / 2, (Fraction(ay) + Fraction(by)) / 2
                if turned:
                    qx, qy = qy, qx
                ex1, ey1, ex2, ey2 = _exact(lines[b])
                if (ey1 > qy) == (ey2 > qy):
                    continue
                cut = ex1 + (ex2 - ex1) * (qy - ey1) / (ey2 - ey1)
                if cut >= qx:
                    near[mine[a]] += w[b]
                    far[mine[a]] += w[b] if cut > qx else 0
            at = stop
    # a mirrored view counts the other way round
    sign = np.where(flat, -1, 1)
    up = np.where(flat, floats[:, 2] > floats[:, 0], floats[:, 3] > floats[:, 1])
    lefts_near = np.where(flat, ~up, up)  # is the side away from the ray the left one?
    return sign * np.where(lefts_near, near, far), sign * np.where(lefts_near, far, near)


def _resolved(segments: np.ndarray, weight: np.ndarray, inside) -> list[list[np.ndarray]]:
    """Polygons of all places whose count of segments ``inside`` holds for."""
    moving = (segments[:, 0] != segments[:, 2]) | (segments[:, 1] != segments[:, 3])
    segments, weight = segments[moving], weight[moving]
    if not len(segments):
        return []
    pieces = _noded(segments)
    left, right = (inside(side) for side in _sides(pieces, segments, weight))
    kept = [(*a, *b) if x else (*b, *a) for (a, b), x, y in zip(pieces, left, right, strict=True) if x != y]
    return polygons_of(np.array([[float(v) for v in k] for k in kept], float).reshape(-1, 4))


def union(segments: np.ndarray, times: np.ndarray | None = None) -> list[list[np.ndarray]]:
    """Union of valid polygons by their directed edges (interior on the left), of which opposite ones may have cancelled out.

    How many polygons cover a place is the count of edges that a ray from it crosses, so the union is where it is above 0.
    """
    return _resolved(segments, np.ones(len(segments)) if times is None else np.asarray(times, float), lambda count: count > 0.5)


def signed_area(ring: np.ndarray) -> float:
    p = ring - ring[0]
    q = np.roll(p, -1, axis=0)
    return float((p[:, 0] * q[:, 1] - q[:, 0] * p[:, 1]).sum() / 2)


def _inside(point, ring: np.ndarray) -> bool:
    x, y = point
    p, q = ring, np.roll(ring, -1, axis=0)
    spans = (p[:, 1] > y) != (q[:, 1] > y)
    p, q = p[spans], q[spans]
    return bool((p[:, 0] + (y - p[:, 1]) * (q[:, 0] - p[:, 0]) / (q[:, 1] - p[:, 1]) > x).sum() % 2)


def _simple_cover(loops: list[np.ndarray], segments: np.ndarray) -> bool:
    """Has every loop (of rings that don't cross) one polygon on its left and none on its right? One edge tells it of a whole loop."""
    samples = [tuple(map(tuple, loop[:2].tolist())) for loop in loops]
    left, right = _sides(samples, segments, np.ones(len(segments)))
    return bool((np.round(left) == 1).all() and (np.round(right) == 0).all())


def is_valid(polygons: list[list[np.ndarray]]) -> bool:
    """Closed rings of four points or more that cross neither themselves nor each other, holes inside their shells, no shell inside another polygon."""
    if not polygons:
        return False
    loops = []
    for polygon in polygons:
        for k, ring in enumerate(polygon):
            if len(ring) < 4 or not (ring[0] == ring[-1]).all() or len(np.unique(ring[:-1], axis=0)) < len(ring) - 1 or (area := signed_area(ring)) == 0:
                return False
            loops.append(ring if (area > 0) == (k == 0) else ring[::-1])
    segments = np.concatenate([np.hstack([r[:-1], r[1:]]) for r in loops])
    if crossing(segments):
        return False
    for polygon in polygons:
        corners = set(map(tuple, polygon[0].tolist())) if len(polygon) > 1 else ()
        for hole in polygon[1:]:
            inner = next((p for p in hole[:-1].tolist() if tuple(p) not in corners), None)
            if inner is not None and not _inside(inner, polygon[0]):
                return False
    return len(loops) == 1 or _simple_cover(loops, segments)


def _loops(segments: np.ndarray) -> list[np.ndarray]:
    """Closed rings of directed edges, cut where they touch themselves; each edge and vertex is passed once."""
    leaving: dict[tuple, list] = defaultdict(list)
    for x1, y1, x2, y2 in segments[np.lexsort(segments.T[::-1])].tolist():
        leaving[x1, y1].append((x2, y2))
    loops = []
    for start in list(leaving):
        while leaving[start]:
            path, place, at, came = [start], {start: 0}, start, None
            while True:
                ways = leaving.get(at)
                if not ways:
                    raise ValueError("boundary edges do not close")
                k = 0
                if len(ways) > 1 and came is not None:  # the left-most turn
                    back = np.arctan2(came[1] - at[1], came[0] - at[0])
                    turn = [(back - np.arctan2(w[1] - at[1], w[0] - at[0])) % (2 * np.pi) or 2 * np.pi for w in ways]
                    k = int(np.argmin(turn))
                came, at = at, ways.pop(k)
                first = place.get(at)
                if first is None:
                    place[at] = len(path)
                    path.append(at)
                    continue
                loops.append(np.array([*path[first:], at], float))
                for v in path[first + 1 :]:
                    del place[v]
                del path[first + 1 :]
                came = path[-2] if len(path) > 1 else None
                if first == 0:
                    break
    return loops


def polygons_of(segments: np.ndarray) -> list[list[np.ndarray]]:
    """Polygons of directed boundary edges with the interior on the left: simple loops, holes given to the least shell around them."""
    return _polygons(_loops(segments))


def _polygons(loops: list[np.ndarray]) -> list[list[np.ndarray]]:
    areas = [signed_area(r) for r in loops]
    shells = [loops[k] for k in sorted(range(len(loops)), key=areas.__getitem__) if areas[k] > 0]
    holes = [r for r, a in zip(loops, areas, strict=True) if a < 0]
    out = [[s] for s in shells]
    low, high = (np.array([f(s, axis=0) for s in shells]).reshape(-1, 2) for f in (np.min, np.max)) if holes else (None, None)
    for hole in holes:
        middle = (hole[0] + hole[1]) / 2
        for k in np.flatnonzero((low <= hole.min(0)).all(1) & (high >= hole.max(0)).all(1)).tolist():
            corners = set(map(tuple, shells[k].tolist()))
            if _inside(middle, shells[k]) or all(tuple(p) in corners or _inside(p, shells[k]) for p in hole.tolist()):
                out[k].append(hole)
                break
    return sorted(out, key=lambda p: (p[0][:, 0].min(), p[0][:, 1].min(), p[0][:, 0].max()))


def assembled(segments: np.ndarray, times: np.ndarray) -> list[list[np.ndarray]]:
    """The union of polygons whose matching inner edges have cancelled out: rings at once if they cover every place once, else by ``union``."""
    if (times == 1).all() and not crossing(segments):
        loops = _loops(segments)
        if len(loops) == 1 or _simple_cover(loops, segments):
            return _polygons(loops)
    return union(segments, times)
