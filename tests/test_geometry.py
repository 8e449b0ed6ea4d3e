import math

import numpy as np
import pytest

from headwater.functions import geodesic, projection
from headwater.functions.text import fixed, padded_limit
from headwater.operators import geometry as G
from headwater.operators import overlay as O
from tests.shapes import square

FIELDS = f"id long, geom {G.GEOMETRY}"


def layer(spark, *rows):
    return spark.createDataFrame([(i, [[[tuple(map(float, p)) for p in ring] for ring in polygon] for polygon in geom]) for i, geom in rows], FIELDS)


def test_area_goldens(spark):
    assert geodesic.ring_area_km2([(0, -1), (1, -1), (1, 0), (0, 0)]) == pytest.approx(12308.7783615, abs=1e-4)
    rows = layer(spark, (1, [[square(0, 0)], [square(1, 1)]]))
    assert G.area_km2(G.edges(rows, "id"), "id").first()["area_km2"] == pytest.approx(24613.9071125, abs=1e-4)


def test_near_antipodal_edges_are_refused():
    with pytest.raises(ValueError):
        geodesic.edge_areas([0.0], [0.3], [179.9], [-0.2])


def test_bounds_centroid_and_holes(spark):
    frame = [[square(0, 0, 2), square(0.5, 0.5)]]
    r = G.planar(G.edges(layer(spark, (1, frame)), "id"), "id").first()
    assert (r["west"], r["south"], r["east"], r["north"], r["planar_area"]) == (0, 0, 2, 2, 3)
    assert (r["cx"], r["cy"]) == pytest.approx((1, 1))


def test_cover_includes_the_boundary_and_excludes_holes(spark):
    shape = G.edges(layer(spark, (1, [[square(0, 0, 2), square(0.5, 0.5)]])), "id")
    points = [("in", 0.25, 0.25), ("edge", 0.0, 1.0), ("corner", 2.0, 2.0), ("hole", 1.0, 1.0), ("rim", 0.5, 1.0), ("out", 5.0, 5.0)]
    p = spark.createDataFrame([(n, 1, x, y) for n, x, y in points] + [("none", 9, 0.0, 0.0)], "name string, id long, lon double, lat double")
    got = {r["name"]: r["covered"] for r in G.covers(p, shape, ["name"], ["id"]).collect()}
    assert got == {"in": True, "edge": True, "corner": True, "hole": False, "rim": True, "out": False, "none": False}


def dissolved(spark, *geoms):
    rows = layer(spark, *enumerate(geoms)).selectExpr("1L as k", "id as member", "geom")
    return G.dissolve(G.edges(rows, "k", "member"), "k").first()["geom"]


def test_dissolve_of_matching_cells(spark):
    assert len(dissolved(spark, [[square(0, 0)]], [[square(1, 1)]])) == 2
    ring = dissolved(spark, *[[[square(x, y)]] for x in range(3) for y in range(3) if (x, y) != (1, 1)])
    assert len(ring) == 1 and len(ring[0]) == 2


def test_dissolve_of_overlaps_and_unmatched_vertices(spark):
    def area(geom):
        return sum(O.signed_area(np.array([(p["x"], p["y"]) for p in ring])) for polygon in geom for ring in polygon)

    assert area(dissolved(spark, [[square(0, 0, 2)]], [[square(1, 1, 2)]])) == pytest.approx(7)
    joined = dissolved(spark, [[square(0, 0, 2)]], [[square(2, 0.5)]])
    assert len(joined) == 1 and area(joined) == pytest.approx(5)
    assert area(dissolved(spark, [[square(0, 0)]], [[square(0, 0)]])) == pytest.approx(1)


def test_dissolve_absorbs_contained_polygons(spark):
    def area(geom):
        return sum(O.signed_area(np.array([(p["x"], p["y"]) for p in ring])) for polygon in geom for ring in polygon)

    (only,) = dissolved(spark, [[square(0, 0, 4)]], [[square(1, 1)]])
    assert len(only) == 1 and area([only]) == pytest.approx(16)
    # two that match inside, and one that touches the outer shell at a vertex only
    both = dissolved(spark, [[square(0, 0, 4)]], [[square(1, 1)]], [[square(2, 1)]], [[[(0, 0), (2, 1), (1, 2), (0, 0)]]])
    assert len(both) == 1 and area(both) == pytest.approx(16)
    # inside the hole it stays a part of its own; around the hole it covers it
    frame = [[square(0, 0, 6), square(1, 1, 4)]]
    assert len(dissolved(spark, frame, [[square(2, 2)]])) == 2 and area(dissolved(spark, frame, [[square(2, 2)]])) == pytest.approx(21)
    small = [[square(0, 0, 6), square(2, 2)]]
    assert area(dissolved(spark, small, [[square(1, 1, 3)]])) == pytest.approx(36)


def test_repair(spark):
    bow = [[[(0, 0), (2, 2), (2, 0), (0, 2), (0, 0)]]]
    rows = {r["id"]: r for r in G.repaired(layer(spark, (1, [[square(0, 0)]]), (2, bow), (3, []), (4, [[[(0, 0), (1, 1), (0, 0)]]])), "id").collect()}
    assert [rows[k]["repaired"] for k in (1, 2, 3, 4)] == [False, True, True, True]
    assert [rows[k]["broken"] for k in (1, 2, 3, 4)] == [False, False, True, True]
    assert len(rows[2]["geom"]) == 2


def test_projections():
    x, y = projection.mercator_to_degrees([0, 111319.49079327357], [0, 111325.14286638486])
    assert (x[1], y[1]) == pytest.approx((1, 1), abs=1e-7)
    t = np.linspace(0, 1, 200)
    ring = np.vstack([np.c_[t, t * 0 + 50], np.c_[t * 0 + 1, 50 + t], np.c_[t[::-1], t * 0 + 51], np.c_[t * 0, 51 - t]])
    px, py = projection.equal_area(ring[:, 0], ring[:, 1], 0.5, 50.5)
    assert abs(O.signed_area(np.c_[px, py])) / 1e6 == pytest.approx(geodesic.ring_area_km2(ring), rel=1e-5)
    assert geodesic.distance_m(0, 0, 1, 0)[0] == pytest.approx(geodesic.A * math.pi / 180)


def test_number_formats(spark):
    assert padded_limit(0.00006, 0, 180, True) == "0.0000" and padded_limit(1.00004, 0, 180, False) == "1.0001"
    assert padded_limit(179.9, 0.3, 180, False) == "180.0000"
    r = spark.createDataFrame([(0.125, 2.675)], "a double, b double").select(*fixed(2, "a", "b")).first()
    assert tuple(r) == ("0.12", "2.67")


def test_union_agrees_with_its_polygons_everywhere():
    rng = np.random.default_rng(1)
    for trial in range(30):
        rings = []
        for _ in range(rng.integers(1, 9)):
            if trial % 2:
                (x, y), (w, h) = rng.integers(0, 8, 2), rng.integers(1, 5, 2)
                ring = np.array([(x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y)], float)
            else:
                ring = rng.random((3, 2)) * 4
                ring = np.vstack([ring, ring[:1]])
                ring = ring if O.signed_area(ring) > 0 else ring[::-1]
            rings.append(ring)
        edges = np.concatenate([np.hstack([r[:-1], r[1:]]) for r in rings])
        made = O.assembled(edges, np.ones(len(edges)))
        assert O.is_valid(made)
        for point in rng.random((100, 2)) * 10 - 0.5:
            assert any(O._inside(point, r) for r in rings) == any(sum(O._inside(point, r) for r in polygon) % 2 for polygon in made)


def test_a_ring_of_a_million_vertices():
    n = 1_000_000
    turn = np.linspace(0, 2 * np.pi, n, endpoint=False)
    ring = (1 + 0.01 * np.sin(turn * n / 20))[:, None] * np.c_[np.cos(turn), np.sin(turn)]
    (polygon,) = O.assembled(np.hstack([ring, np.roll(ring, -1, axis=0)]), np.ones(n))
    assert len(polygon) == 1 and len(polygon[0]) == n + 1


def test_many_parts_and_holes():
    x, y = (v.ravel() * 3.0 for v in np.meshgrid(np.arange(60), np.arange(60)))
    rings = [np.c_[x, y, x + 2, y], np.c_[x + 2, y, x + 2, y + 2], np.c_[x + 2, y + 2, x, y + 2], np.c_[x, y + 2, x, y]]
    inner = [np.c_[x + 0.5, y + 0.5, x + 0.5, y + 1], np.c_[x + 0.5, y + 1, x + 1, y + 1], np.c_[x + 1, y + 1, x + 1, y + 0.5], np.c_[x + 1, y + 0.5, x + 0.5, y + 0.5]]
    made = O.assembled(np.concatenate(rings + inner), np.ones(len(x) * 8))
    assert len(made) == 3600 and all(len(p) == 2 for p in made) and O.is_valid(made)
