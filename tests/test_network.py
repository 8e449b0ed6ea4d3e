import random

import pytest
from pyspark.sql import functions as F

from headwater.operators import graph as N


def frames(spark, units, projects):
    u = spark.createDataFrame(units, "unit long, next_down long, endo int")
    p = spark.createDataFrame([(k, i, h) for k, (i, h) in enumerate(projects)], "ord int, id string, hybas_id long")
    return u, p


def local_of(spark, units, projects, virtual=False):
    u, p = frames(spark, units, projects)
    links = N.effective_downstream(u, virtual)
    rows = N.local_members(N.nearest_project(links, p), p).groupBy("id").agg(F.array_sort(F.collect_list("unit")).alias("m")).collect()
    return {r["id"]: r["m"] for r in rows}


FIXTURE = [(1, 3, 0), (2, 3, 0), (3, 0, 0), (4, 3, 2)]


def test_local_members_stop_at_other_projects(spark):
    assert local_of(spark, FIXTURE, [("UPPER", 1), ("LOWER", 3)]) == {"UPPER": [1], "LOWER": [2, 3]}
    assert local_of(spark, FIXTURE, [("UPPER", 1), ("LOWER", 3)], True)["LOWER"] == [2, 3, 4]


def test_network_and_totals_of_nested_projects(spark):
    u, p = frames(spark, [(1, 3, 0), (2, 3, 0), (3, 5, 0), (5, 0, 0)], [("UPPER", 1), ("LOWER", 3), ("LAST", 5)])
    links = N.effective_downstream(u)
    nearest = N.nearest_project(links, p)
    edges = N.project_edges(links, nearest, p)
    closure = N.project_closure(edges)
    rows = {r["id"]: (r["down"], r["up"], r["above"]) for r in N.project_network(edges, closure).collect()}
    assert rows == {"UPPER": ("LOWER", [], []), "LOWER": ("LAST", ["UPPER"], ["UPPER"]), "LAST": (None, ["LOWER"], ["UPPER", "LOWER"])}
    total = {r["id"]: r["n"] for r in N.total_members(N.local_members(nearest, p), closure).groupBy("id").agg(F.count("*").alias("n")).collect()}
    assert total == {"UPPER": 1, "LOWER": 3, "LAST": 4}


@pytest.mark.parametrize(("units", "text"), [([(1, 3, 0), (3, 1, 0)], "cycle"), ([(1, 999, 0)], "999"), ([(7, 0, 0), (7, 0, 0)], "Duplicate unit 7")])
def test_bad_networks_are_rejected(spark, units, text):
    u, _ = frames(spark, units, [("P", 1)])
    with pytest.raises(ValueError, match=text):
        N.check_network(u, N.effective_downstream(u))


def test_excluded_virtual_links_may_dangle_or_loop(spark):
    u, _ = frames(spark, [(1, 999, 2), (2, 3, 0), (3, 2, 2)], [("P", 1)])
    N.check_network(u, N.effective_downstream(u))
    with pytest.raises(ValueError):
        N.check_network(u, N.effective_downstream(u, True))


def test_nearest_project_matches_set_differences_on_random_forests(spark):
    rng = random.Random(5)
    for _ in range(3):
        n = rng.randrange(20, 60)
        units = [(k, rng.randrange(0, k) if rng.random() < 0.9 else 0, 0) for k in range(1, n)]
        projects = [(f"P{k}", k) for k in rng.sample(range(1, n), 6)]
        down = {u: d for u, d, _ in units}

        def path(u, down=down):
            while u:
                yield u
                u = down[u]

        total = {i: {u for u in down if h in path(u)} for i, h in projects}
        naive = {i: total[i] - set().union(*(total[j] for j, g in projects if j != i and g in total[i]), set()) for i, _ in projects}
        assert {k: set(v) for k, v in local_of(spark, units, projects).items()} == naive
