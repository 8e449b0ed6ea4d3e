"""Rings by list ranking, against walking them in one place."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from headwater.operators import overlay as O
from headwater.operators import rings as R
from tests.shapes import square


def frame(spark, edges):
    return spark.createDataFrame([(0, *map(float, e)) for e in np.asarray(edges).tolist()], "k long, x1 double, y1 double, x2 double, y2 double")


def plain(geom):
    return [[np.array([(p["x"], p["y"]) for p in ring]) for ring in polygon] for polygon in geom]


def canonical(polygons):
    """Polygons as sets of their rings' edges."""
    return sorted(sorted(sorted(map(tuple, np.hstack([r[:-1], r[1:]]).tolist())) for r in p) for p in polygons)


def cells(seed, n, share):
    rng = np.random.default_rng(seed)
    on = np.argwhere(rng.random((n, n)) < share)
    edges = np.concatenate([np.hstack([r[:-1], r[1:]]) for r in (np.array([(x, y), (x + 1, y), (x + 1, y + 1), (x, y + 1), (x, y)], float) for x, y in on)])
    seen = {tuple(e) for e in edges.tolist()}
    return np.array([e for e in seen if (e[2], e[3], e[0], e[1]) not in seen])


@pytest.mark.parametrize(("seed", "share", "chunk"), [(1, 0.6, 1 << 18), (2, 0.75, 20)])
def test_rings_and_holes_match_walking(spark, monkeypatch, seed, share, chunk):
    monkeypatch.setattr(R, "CHUNK", chunk)
    edges = cells(seed, 12, share)
    want = O.polygons_of(edges)
    (row,) = R.polygons(frame(spark, edges), "k").collect()
    assert canonical(plain(row["geom"])) == canonical(want) and O.is_valid(plain(row["geom"]))
    assert all(r[0].tolist() == r[-1].tolist() for p in plain(row["geom"]) for r in p)


def test_nested_holes_and_touching_rings(spark):
    def around(ring, hole):
        r = np.array(square(*ring), float)
        r = r[::-1] if (O.signed_area(r) > 0) == hole else r
        return np.hstack([r[:-1], r[1:]])

    # a shell with a hole in which an island with a hole lies, and two holes side by side; then a hole that touches its shell
    shapes = [((0, 0, 20), 0), ((2, 2, 8), 1), ((3, 3, 6), 0), ((4, 4, 2), 1), ((12, 2, 2), 1), ((15, 2, 2), 1)]
    edges = np.concatenate([around(s, h) for s, h in shapes])
    (row,) = R.polygons(frame(spark, edges), "k").collect()
    assert sorted(len(p) for p in row["geom"]) == [2, 4]
    touching = np.array([(0, 0, 4, 0), (4, 0, 4, 4), (4, 4, 0, 4), (0, 4, 0, 0), (0, 0, 1, 2), (1, 2, 2, 1), (2, 1, 0, 0)], float)
    (row,) = R.polygons(frame(spark, touching), "k").collect()
    assert [len(p) for p in row["geom"]] == [2] and O.is_valid(plain(row["geom"]))


def test_a_long_ring_in_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(R, "CHUNK", 4000)
    n = 20_000
    turn = np.linspace(0, 2 * np.pi, n, endpoint=False)
    ring = (1 + 0.3 * np.sin(turn * 40))[:, None] * np.c_[np.cos(turn), np.sin(turn)]
    edges = np.hstack([ring, np.roll(ring, -1, axis=0)])
    rings = R.ring_edges(frame(spark, edges), "k")
    got = np.array([tuple(r) for r in rings.orderBy("seq").select("seq", "n", "x1", "y1").collect()])
    assert (got[:, 0] == np.arange(n)).all() and (got[:, 1] == n).all()
    shift = int(np.flatnonzero((ring == got[0, 2:]).all(1))[0])
    assert (np.roll(ring, -shift, axis=0) == got[:, 2:]).all()
    m = R.ring_measures(rings, "k").first()
    assert m["area"] == pytest.approx(O.signed_area(ring), rel=1e-9)


def test_places_that_tell_nothing_are_ranked_by_doubling(spark, monkeypatch):
    monkeypatch.setattr(R, "CHUNK", 20)
    rng = np.random.default_rng(1)
    order = rng.permutation(300)
    follows = np.empty(300, int)
    for part in (order[:180], order[180:290], order[290:]):
        follows[part] = np.roll(part, -1)
    rows = [(k, int(follows[k]), *map(float, rng.random(2))) for k in range(300)]
    got = {r["edge"]: r for r in R.ranked(spark.createDataFrame(rows, "edge long, next long, x double, y double")).collect()}
    assert len(got) == 300 and sorted({(r["ring"], r["n"]) for r in got.values()}, key=lambda x: x[1]) == sorted({(got[int(p[0])]["ring"], len(p)) for p in (order[290:], order[180:290], order[:180])}, key=lambda x: x[1])
    assert all(got[f]["ring"] == got[k]["ring"] and got[f]["seq"] == (got[k]["seq"] + 1) % got[k]["n"] for k, f, *_ in rows)


def test_open_lines_are_refused_and_no_edges_give_nothing(spark):
    rows = frame(spark, [(0, 0, 1, 0), (1, 0, 1, 1)])
    with pytest.raises(ValueError):
        R.ring_edges(rows, "k").count()
    assert R.polygons(rows.limit(0), "k").count() == 0 and rows.withColumn("edge", F.lit(1)).count() == 2
