"""Union as a chain of joins, against the exact overlay in one place."""

from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from headwater.operators import arrangement as A
from headwater.operators import geometry as G
from headwater.operators import overlay as O


def ring_edges(ring):
    ring = np.asarray(ring, float)
    ring = ring if O.signed_area(ring) > 0 else ring[::-1]
    return np.hstack([ring, np.roll(ring, -1, axis=0)])


def frame(spark, edges, key=0):
    return spark.createDataFrame([(key, *map(float, e)) for e in np.asarray(edges).tolist()], "k long, x1 double, y1 double, x2 double, y2 double")


def random_edges(seed, n, kind):
    rng = np.random.default_rng(seed)
    rings = []
    for _ in range(n):
        if kind == "lattice":
            (x, y), (w, h) = rng.integers(0, 12, 2), rng.integers(1, 4, 2)
            rings.append([(x, y), (x + w, y), (x + w, y + h), (x, y + h)])
        elif kind == "crowd":
            x, y = rng.random(2) * (0.05 if rng.random() < 0.6 else 10)
            w, h = rng.random(2) * (0.01 if x < 0.06 else 1)
            rings.append([(x, y), (x + w, y), (x + w, y + h), (x, y + h)])
        else:
            rings.append(rng.random((3, 2)) * 2 + rng.random(2) * 6)
    return np.concatenate([ring_edges(r) for r in rings])


def area(edges):
    e = np.asarray(edges, float)
    return float((e[:, 0] * e[:, 3] - e[:, 2] * e[:, 1]).sum() / 2)


@pytest.mark.parametrize(("kind", "n", "cell", "crowded"), [("lattice", 60, 256, 2048), ("lattice", 60, 4, 16), ("triangles", 40, 6, 24), ("triangles", 40, 256, 2048), ("crowd", 120, 8, 24)])
def test_union_matches_the_overlay(spark, monkeypatch, kind, n, cell, crowded):
    monkeypatch.setattr(A, "CELL", cell)
    monkeypatch.setattr(A, "CROWDED", crowded)
    edges = random_edges(n + cell, n, kind)
    got = np.array([tuple(r) for r in A.union_boundary(frame(spark, edges), "k").select("x1", "y1", "x2", "y2").collect()])
    want = O.union(edges)
    total = sum(O.signed_area(r) for p in want for r in p)
    assert area(got) == pytest.approx(total, rel=1e-12)
    made = O.polygons_of(got)
    assert len(made) == len(want) and sorted(len(p) for p in made) == sorted(len(p) for p in want) and O.is_valid(made)


def test_keys_are_apart_and_inner_polygons_vanish(spark):
    big, small = [(0, 0), (4, 0), (4, 4), (0, 4)], [(1, 1), (2, 1), (2, 2), (1, 2)]
    rows = frame(spark, np.concatenate([ring_edges(big), ring_edges(small)])).union(frame(spark, ring_edges(small), 1)).withColumn("seg", F.lit("x"))
    got = A.union_boundary(rows, "k").groupBy("k").agg(F.count("*").alias("n"), F.sum("times").alias("t")).orderBy("k").collect()
    assert [tuple(r) for r in got] == [(0, 4, 4), (1, 4, 4)]
    assert A.union_boundary(rows.limit(0), "k").count() == 0


def test_a_place_on_a_line_and_vertices_on_the_way():
    lines = np.array([[0.0, -1, 0, 1], [0, 1, 0, -1], [-1, 0, 1, 0], [1, 0, -1, 0]])
    here = np.zeros(4)
    assert A._side(lines, here, here).tolist() == [-1, 1, 1, -1]
    for seed in range(200):  # small whole numbers, so that vertices, ends and lines often fall together
        rng = np.random.default_rng(seed)
        ring = np.unique(rng.integers(0, 5, (4, 2)).astype(float), axis=0)
        if len(ring) < 3 or O.crossing(np.hstack([ring, np.roll(ring, -1, axis=0)])) or O.signed_area(ring) == 0:
            continue
        edges = ring_edges(ring)
        start, end = rng.integers(0, 5, (2, 2)).astype(float)
        change = A.crossings(edges, np.tile(start, (len(edges), 1)), np.tile(end, (len(edges), 1)), 0.0).sum()
        tiny = Fraction(1, 10**6)

        def inside(p):
            x, y = Fraction(float(p[0])) + tiny, Fraction(float(p[1])) + tiny * tiny
            hits = 0
            for x1, y1, x2, y2 in edges.tolist():
                if (Fraction(y1) > y) != (Fraction(y2) > y) and Fraction(x1) + (y - Fraction(y1)) * (Fraction(x2) - Fraction(x1)) / (Fraction(y2) - Fraction(y1)) > x:
                    hits += 1
            return hits % 2

        assert change == inside(end) - inside(start), seed


def test_centre_of_overlapping_layers(spark):
    squares = [[(0, 0), (2, 0), (2, 2), (0, 2)], [(0, 0), (2, 0), (2, 2), (0, 2)], [(4, 0), (6, 0), (6, 2), (4, 2)], [(4.5, 0.5), (5, 0.5), (5, 1), (4.5, 1)]]
    r = G.union_planar(frame(spark, np.concatenate([ring_edges(s) for s in squares])), "k").first()
    assert (r["cx"], r["cy"], r["planar_area"]) == pytest.approx((3, 1, 8)) and (r["west"], r["east"]) == (0, 6)


def test_large_unions_are_dissolved_by_joins(spark, monkeypatch):
    edges = random_edges(5, 30, "lattice")
    rows = frame(spark, edges).union(frame(spark, ring_edges([(0, 0), (1, 0), (1, 1), (0, 1)]), 1))
    small = {r["k"]: r["geom"] for r in G.dissolve(rows, "k").collect()}
    monkeypatch.setattr(G, "WHOLE", 20)
    large = {r["k"]: r["geom"] for r in G.dissolve(rows, "k").collect()}
    edges_of = lambda geom: sorted(sorted((p["x"], p["y"], q["x"], q["y"]) for p, q in zip(r[:-1], r[1:], strict=True)) for polygon in geom for r in polygon)
    assert set(small) == set(large) == {0, 1} and all(sorted(len(p) for p in small[k]) == sorted(len(p) for p in large[k]) for k in small)
    assert [edges_of(small[k]) for k in (0, 1)] == [edges_of(large[k]) for k in (0, 1)]
