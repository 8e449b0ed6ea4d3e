"""Hard-negative mining against brute force."""

import math
import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from headwater.llm import hard_negatives as H
from headwater.llm.queries import ORACLES, QUERIES

SCHEMA = "vec_id long, label int, vector array<float>, row string, score string"


def brute(rows, n_pos=5, n_neg=3, low=50, high=95, scale=256):
    """Sorted result rows; ids that are null count as the largest."""
    usable = [(i, place, label, [math.floor(float(np.float32(x)) * scale) for x in v]) for place, (i, label, v) in enumerate(rows) if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    order = lambda r: (-r[0], r[1] is None, r[1] or 0, r[2])
    out = []
    for i, place, label, q in usable:
        if i is None or i % 50:
            continue
        pairs = [(sum(a * b for a, b in zip(q, r, strict=False)), j, at, other) for j, at, other, r in usable if at != place]
        for k, p in enumerate(sorted((x for x in pairs if x[3] == label), key=order)[:n_pos]):
            inside = sorted((x for x in pairs if x[3] != label and low * p[0] <= 100 * x[0] <= high * p[0]), key=order)[:n_neg]
            out += [(i, p[1], m + 1, x[1], p[0], x[0], k + 1) for m, x in enumerate(inside)]
    return sorted(out, key=str)


def mined(spark, rows, **more):
    frame = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    return sorted((tuple(r) for r in H.mine_hard_negatives(frame.coalesce(1), F.col("vec_id") % 50 == 0, **more).collect()), key=str)


def random_rows(n, width=8, seed=1, step=None):
    rng = random.Random(seed)
    value = (lambda: rng.choice([-step, 0.0, step])) if step else (lambda: rng.uniform(-1, 1))
    return [(k, rng.randrange(4), [value() for _ in range(width)]) for k in range(n)]


@pytest.mark.parametrize(("block", "tile"), [(1 << 16, 4096), (7, 5)])
def test_mining_matches_brute_force(spark, monkeypatch, block, tile):
    monkeypatch.setattr(H, "ANCHORS", block)
    monkeypatch.setattr(H, "TILE_ROWS", tile)
    monkeypatch.setattr(H, "TILE_ANCHORS", 3)
    rows = random_rows(900) + [(k, 1, [0.5] * 8) for k in range(900, 1200)]
    assert mined(spark, rows) == brute(rows)


def test_ties_nulls_repeats_and_odd_vectors(spark):
    rows = random_rows(300, width=4, seed=3, step=0.25)
    rows += rows[:60] + [(50, 2, [0.25, 0.25, 0.25, 0.25])] * 3
    rows += [(None, 1, [0.25, 0.0, 0.25, 0.25]), (None, 2, [0.5, 0.25, 0.25, 0.25]), (350, None, [0.1] * 4), (400, 1, None), (450, 1, [0.1, None, 0.1, 0.1]), (500, 1, [float("nan")] * 4), (550, 1, [float("inf"), 0.0, 0.0, 0.0])]
    rows += [(600, 1, [0.5, 0.5]), (650, 2, []), (-50, 3, [1.0, 1.0, 1.0, 1.0])]
    assert mined(spark, rows) == brute(rows)
    assert mined(spark, rows, n_positives=2, n_negatives=1, low=10, high=80, scale=100) == brute(rows, 2, 1, 10, 80, 100)


def test_large_components_are_exact(spark):
    rng = random.Random(9)
    rows = [(k, k % 2, [rng.uniform(-1, 1) * 2.0**21 for _ in range(3)]) for k in range(120)]
    assert mined(spark, rows) == brute(rows)


def test_no_rows_and_no_anchors(spark):
    assert mined(spark, []) == [] and mined(spark, [(1, 1, [0.5]), (2, 2, [0.4])]) == [] and mined(spark, [(50, 1, [0.5])]) == []


def test_the_stream_holds_open_windows_only():
    pairs = [(1, 100, 0, 7, 0), (1, 96, 1, 3, 1), (1, 95, 1, 4, 2), (1, 80, 0, 8, 3), (1, 76, 1, 5, 4), (1, 50, 1, 6, 5), (1, 40, 1, 9, 6), (1, 39, 1, 2, 7), (2, 0, 0, 1, 8), (2, 0, 1, 5, 9)]
    got = list(H.mined(iter(pairs), 3, 50, 95))
    assert got == [(1, 7, 1, 1, 4, 100, 95), (1, 7, 1, 2, 5, 100, 76), (1, 8, 2, 1, 5, 80, 76), (1, 7, 1, 3, 6, 100, 50), (1, 8, 2, 2, 6, 80, 50), (1, 8, 2, 3, 9, 80, 40), (2, 1, 1, 1, 5, 0, 0)]


def test_the_registered_query_matches_its_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    folder = Path("/root/testdata/sf0.001")
    c = duckdb.connect()
    c.execute(f"create view embeddings as select * from '{folder}/embeddings.parquet'")
    result = c.execute(ORACLES["op13_hard_negatives"])
    names = [d[0] for d in result.description]
    df = QUERIES["op13_hard_negatives"](spark, str(folder))
    assert df.columns == names and sorted(map(tuple, df.collect())) == sorted(result.fetchall())
