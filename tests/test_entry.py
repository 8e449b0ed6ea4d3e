import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry

REPO = Path(entry.__file__).parent
SF = "/root/testdata/sf0.001"


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_the_rest_works_without_the_optional_subpackage(tmp_path):
    for name in ("headwater", "__spark_entry__.py"):
        (tmp_path / name).symlink_to(REPO / name) if name.endswith(".py") else None
    (tmp_path / "headwater").mkdir()
    for part in (REPO / "headwater").iterdir():
        if part.name != "llm":
            (tmp_path / "headwater" / part.name).symlink_to(part)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'local_counts' in q and not any(n.startswith('op') or n == 'pipeline' for n in q)"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, timeout=120)


def test_bbox_of_whole_catchments(spark):
    measures = {r["id"]: r for r in entry.queries()["planar_measures"](spark, SF).collect()}
    names = {r["s_name"]: r["s_name"].replace("#", "_") for r in spark.read.parquet(f"{SF}/supplier.parquet").select("s_name").collect()}
    rows = entry.queries()["bbox_catchments"](spark, SF).collect()
    assert len(rows) == len(measures) and max(m["planar_area"] for m in measures.values()) > 1
    for r in rows:
        m = measures[names[r["PolygonName"].removesuffix(" local incremental catchment")]]
        limits = max(m["south"] - 0.3, -90), min(m["north"] + 0.3, 90), max(m["west"] - 0.3, -180), min(m["east"] + 0.3, 180)
        assert [float(r[c]) for c in ("MinLatitude", "MaxLatitude", "MinLongitude", "MaxLongitude")] == pytest.approx(limits)
        assert (float(r["CentroidLatitude"]), float(r["CentroidLongitude"])) == pytest.approx((m["cy"], m["cx"]), abs=6e-5) and r["area_is_sum"]
    test_queries_match_their_sql(spark, "bbox_catchments")


def broadcasts(df):
    """The columns of every table that the plan of ``df`` would send to all executors by way of the driver."""
    found, rest = [], [df._jdf.queryExecution().executedPlan()]
    while rest:
        node = rest.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            rest.append(node.initialPlan())
        if node.nodeName().startswith("BroadcastExchange"):
            found.append({node.output().apply(k).name() for k in range(node.output().size())})
        rest += [node.children().apply(k) for k in range(node.children().size())]
    return found


@pytest.mark.parametrize("name", ["bbox_catchments", "feature_rows"])
def test_neither_geometry_nor_jumps_of_all_units_are_broadcast(spark, monkeypatch, name):
    """Files of a few MB hold millions of units: their shapes and edges, lists of members, and the table that each round of doubling looks up, would fill the driver."""
    from headwater.operators import geometry, graph
    from headwater.plans import catchments, lineage, queries

    sent, rounds = [], []

    def recorded(df):
        sent.extend(broadcasts(df))
        rounds.append("arrived" in df.columns)
        return lineage.cut(df)

    for module in (geometry, graph, catchments, queries):
        monkeypatch.setattr(module, "cut", recorded)
    sent.extend(broadcasts(queries.QUERIES[name](spark, SF)))
    assert sum(rounds) > 1 and sent
    assert not [columns for columns in sent if columns & {"geom", "x1", "hybas_ids", "further"}]


@pytest.mark.parametrize("name", ["effective_downstream", "local_counts", "next_project", "outlet_cover", "unit_edges", "bbox_summary", "layer_id_equality", "marker_extract", "filename_sanitize", "geojson_roundtrip", "integrity_report", "geodesic_closed_forms", "total_area_consistency", "feature_rows", "layer_compare", "overlay_union", "long_ring", "linework_repair"])
def test_queries_match_their_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        c.execute(f"create view {path.stem} as select * from '{path}'")
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    result = c.execute(entry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    key = lambda row: tuple(map(str, row))
    assert sorted((tuple(r[x] for x in columns) for r in df.collect()), key=key) == sorted((tuple(r[names.index(x)] for x in columns) for r in result.fetchall()), key=key)


@pytest.mark.parametrize("name", ["total_area_consistency", "feature_rows"])
def test_networks_whose_cells_go_past_the_pole_have_areas(spark, tmp_path, name):
    """Units from 37,500 on lie above 90 degrees: two catchments wholly there, and one with cells on both sides."""
    duckdb = pytest.importorskip("duckdb")
    units = [14000, *range(42000, 42003), *range(126000, 126004)]
    spark.createDataFrame([(u - 1, 1) for u in units], "p_partkey long, p_size int").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    at = [u // 7 - 1 for u in (14000, 42000, 126000)]
    spark.createDataFrame([(k, f"Supplier#{k}", k % 5) for k in at], "s_suppkey long, s_name string, s_nationkey int").coalesce(1).write.parquet(str(tmp_path / "supplier.parquet"))
    c = duckdb.connect()
    for table in ("part", "supplier"):
        c.execute(f"create view {table} as select * from '{tmp_path}/{table}.parquet/*.parquet'")
    df = entry.queries()[name](spark, str(tmp_path))
    columns = sorted(df.columns)
    wanted = c.execute(f"select {', '.join(columns)} from ({entry.oracle_sql()[name]}) order by id").fetchall()
    assert [tuple(r[x] for x in columns) for r in df.orderBy("id").collect()] == wanted and len(wanted) == 3
