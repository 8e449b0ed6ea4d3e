"""The registered queries of the library's own operators, over the derived network, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headwater.functions.text import casefolded, file_stem, matches_name
from headwater.operators import arrangement as A
from headwater.operators import geometry as G
from headwater.operators import graph as N
from headwater.operators import rings as R
from headwater.plans.catchments import catchments
from headwater.plans.compare import layer_areas, markers, same_ids, select_project
from headwater.plans.lineage import cut
from headwater.sinks import bbox_rows
from headwater.sources import derived as D
from headwater.sources.geojson import geometry_json, parsed_features

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

_UNITS = """units AS (SELECT p_partkey + 1 AS unit, (p_partkey + 1) // 3 AS next_down, CASE WHEN p_size % 10 = 0 THEN 2 ELSE 0 END AS endo,
  (p_partkey + 1) % 300 - 150 AS x, (p_partkey + 1) // 300 - 35 AS y FROM part),
links AS (SELECT unit, CASE WHEN endo = 2 THEN 0 ELSE next_down END AS down FROM units),
projects AS (SELECT s_suppkey AS ord, replace(s_name, '#', '_') AS id, s_name AS name, (s_suppkey + 1) * 7 AS hybas_id, x + 0.5 AS lon, y + 0.5 AS lat,
  CASE WHEN s_nationkey % 2 = 0 THEN 'N' || s_suppkey END AS project_code, s_nationkey FROM supplier JOIN units ON unit = (s_suppkey + 1) * 7)"""
_TOTAL = _UNITS + """,
total AS (SELECT id, hybas_id AS unit FROM projects UNION ALL SELECT t.id, l.unit FROM total t JOIN links l ON l.down = t.unit)"""
_LOCAL = _TOTAL + """,
above AS (SELECT t.id, p.id AS above, p.ord FROM total t JOIN projects p ON p.hybas_id = t.unit AND p.id <> t.id),
local AS (SELECT id, unit FROM total EXCEPT SELECT a.id, t.unit FROM above a JOIN total t ON t.id = a.above)"""
_NEXT = _UNITS + """,
walk AS (SELECT p.id, l.down AS at FROM projects p JOIN links l ON l.unit = p.hybas_id
  UNION ALL SELECT w.id, l.down FROM walk w JOIN links l ON l.unit = w.at WHERE w.at NOT IN (SELECT hybas_id FROM projects)),
hops AS (SELECT w.id, p.id AS down FROM walk w JOIN projects p ON p.hybas_id = w.at),
following AS (SELECT p.ord, p.id, h.down FROM projects p LEFT JOIN hops h USING (id))"""


def _query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


class _Net:
    """The derived network's shared tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        # written, so that joins know how few projects there are to the units
        self.units, self.projects = D.units(spark, sf_dir), cut(D.projects(spark, sf_dir))
        self.links = N.effective_downstream(self.units)
        self.nearest = N.nearest_project(self.links, self.projects)

    def local(self) -> DataFrame:
        return N.local_members(self.nearest, self.projects)

    def edges(self) -> DataFrame:
        return N.project_edges(self.links, self.nearest, self.projects)

    def total(self) -> DataFrame:
        return N.total_members(self.local(), N.project_closure(self.edges()))


@_query(f"WITH {_UNITS} SELECT unit, down FROM links")
def effective_downstream(spark, sf_dir):
    return N.effective_downstream(D.units(spark, sf_dir))


@_query(f"""WITH RECURSIVE {_UNITS},
planted AS (SELECT 1000000000 + s_suppkey AS unit, CASE s_suppkey % 5 WHEN 0 THEN 2000000000 WHEN 1 THEN 1000000000 WHEN 2 THEN 1000000001 ELSE 999999999 END + s_suppkey AS down FROM supplier),
every AS (SELECT unit, down FROM links UNION ALL SELECT unit, down FROM planted),
walk AS (SELECT unit, down AS here FROM every WHERE down <> 0 UNION SELECT w.unit, e.down FROM walk w JOIN every e ON e.unit = w.here WHERE e.down <> 0),
loops AS (SELECT unit FROM walk WHERE unit = here)
SELECT (SELECT count(*) FROM every) AS n_units, (SELECT count(*) FROM every WHERE down <> 0 AND down NOT IN (SELECT unit FROM every)) AS n_dangling,
  (SELECT count(DISTINCT unit) FROM walk WHERE here IN (SELECT unit FROM loops)) AS n_into_cycles""")
def integrity_report(spark, sf_dir):
    """The network with a planted unit a supplier: links to nowhere, to themselves, to each other, and into those."""
    k = F.col("s_suppkey").cast("long")
    to = F.when(k % 5 == 0, 2_000_000_000).when(k % 5 == 1, 1_000_000_000).when(k % 5 == 2, 1_000_000_001).otherwise(999_999_999)
    planted = D.table(spark, sf_dir, "supplier").select((k + 1_000_000_000).alias("unit"), (to + k).alias("down"))
    links = cut(N.effective_downstream(D.units(spark, sf_dir)).union(planted))
    total = links.agg(F.count("*").alias("n_units"))
    dangling = N.missing_downstream(links).agg(F.count("*").alias("n_dangling"))
    cycles = N.units_into_cycles(links).agg(F.count("*").alias("n_into_cycles"))
    one = lambda d: d.withColumn("k", F.lit(1))
    return one(total).join(one(dangling), "k").join(one(cycles), "k").drop("k")


@_query(f"WITH RECURSIVE {_LOCAL} SELECT id, unit FROM local")
def local_members(spark, sf_dir):
    return _Net(spark, sf_dir).local()


@_query(f"WITH RECURSIVE {_LOCAL} SELECT id, count(*) AS unit_count FROM local GROUP BY id")
def local_counts(spark, sf_dir):
    return _Net(spark, sf_dir).local().groupBy("id").agg(F.count("*").alias("unit_count"))


@_query(f"WITH RECURSIVE {_TOTAL} SELECT id, unit FROM total")
def total_members(spark, sf_dir):
    return _Net(spark, sf_dir).total()


@_query(f"WITH RECURSIVE {_TOTAL} SELECT id, count(*) AS unit_count FROM total GROUP BY id")
def total_counts(spark, sf_dir):
    return _Net(spark, sf_dir).total().groupBy("id").agg(F.count("*").alias("unit_count"))


@_query(f"WITH RECURSIVE {_TOTAL} SELECT id, string_agg(unit, ',' ORDER BY unit) AS hybas_ids FROM total GROUP BY id")
def hybas_ids(spark, sf_dir):
    return _Net(spark, sf_dir).total().groupBy("id").agg(F.array_join(F.array_sort(F.collect_list("unit")).cast("array<string>"), ",").alias("hybas_ids"))


@_query("""WITH RECURSIVE c AS (SELECT p_partkey + 1 AS unit, CASE WHEN (p_partkey + 1) % 150 = 1 THEN 0 ELSE p_partkey END AS down FROM part),
p AS (SELECT (s_suppkey + 1) * 7 AS unit FROM supplier),
w AS (SELECT unit, unit AS here FROM c UNION ALL SELECT w.unit, c.down FROM w JOIN c ON c.unit = w.here WHERE w.here NOT IN (SELECT unit FROM p))
SELECT unit, max(CASE WHEN here IN (SELECT unit FROM p) THEN here ELSE 0 END) AS project_unit FROM w GROUP BY unit""")
def nearest_project_on_chains(spark, sf_dir):
    links = D.units(spark, sf_dir, chain=150).select("unit", F.col("next_down").alias("down"))
    return N.nearest_project(links, D.projects(spark, sf_dir))


@_query(f"WITH RECURSIVE {_NEXT} SELECT id, down FROM following")
def next_project(spark, sf_dir):
    return _Net(spark, sf_dir).edges().select("id", "down")


@_query(f"""WITH RECURSIVE {_LOCAL}, {_NEXT.split(_UNITS + ",")[1].strip()}
SELECT f.id, coalesce(string_agg(a.above, ',' ORDER BY a.ord), '') AS above,
  coalesce(string_agg(a.above, ',' ORDER BY a.ord) FILTER (WHERE g.down = f.id), '') AS up
FROM following f LEFT JOIN above a ON a.id = f.id LEFT JOIN following g ON g.id = a.above GROUP BY f.id""")
def project_network(spark, sf_dir):
    edges = cut(_Net(spark, sf_dir).edges())
    rows = N.project_network(edges, N.project_closure(edges))
    return rows.select("id", F.array_join("above", ",").alias("above"), F.array_join("up", ",").alias("up"))


@_query(f"""WITH RECURSIVE {_LOCAL} SELECT l.id, count(*) AS unit_count, min(unit) AS first_unit FROM local l JOIN projects p ON p.id = l.id
WHERE p.s_nationkey = 3 GROUP BY l.id""")
def filtered_features(spark, sf_dir):
    """The output filter: cutoffs still use all projects."""
    net = _Net(spark, sf_dir)
    wanted = D.table(spark, sf_dir, "supplier").filter("s_nationkey = 3").select(F.regexp_replace("s_name", "#", "_").alias("id"))
    return net.local().join(wanted, "id", "left_semi").groupBy("id").agg(F.count("*").alias("unit_count"), F.min("unit").alias("first_unit"))


def _points(spark, sf_dir, move: float) -> DataFrame:
    points = D.projects(spark, sf_dir).select("id", F.col("hybas_id").alias("unit"), (F.col("lon") + F.lit(move)).alias("lon"), "lat")
    return G.covers(points, G.edges(D.shapes(spark, sf_dir), "unit"), ["id", "unit"], ["unit"]).select("id", "covered")


def _point_sql(move: float) -> str:
    return f"WITH {_UNITS} SELECT id, lon + {move} BETWEEN x AND x + 1 AND lat BETWEEN y AND y + 1 AS covered FROM projects JOIN units ON unit = hybas_id"


@_query(_point_sql(0.5))
def outlet_cover(spark, sf_dir):
    """Outlets on their cell's edge are covered."""
    return _points(spark, sf_dir, 0.5)


@_query(_point_sql(0.75))
def wrong_outlet_rejects(spark, sf_dir):
    return _points(spark, sf_dir, 0.75)


@_query(f"""WITH {_UNITS}, e AS (SELECT unit, x AS x1, y AS y1, x + 1 AS x2, y AS y2 FROM units UNION ALL SELECT unit, x + 1, y, x + 1, y + 1 FROM units
  UNION ALL SELECT unit, x + 1, y + 1, x, y + 1 FROM units UNION ALL SELECT unit, x, y + 1, x, y FROM units)
SELECT unit, CAST(x1 AS DOUBLE) AS x1, CAST(y1 AS DOUBLE) AS y1, CAST(x2 AS DOUBLE) AS x2, CAST(y2 AS DOUBLE) AS y2 FROM e""")
def unit_edges(spark, sf_dir):
    return G.edges(D.shapes(spark, sf_dir), "unit").select("unit", "x1", "y1", "x2", "y2")


@_query(f"""WITH RECURSIVE {_LOCAL}, c AS (SELECT l.id, u.x, u.y FROM local l JOIN units u USING (unit)),
e AS (SELECT id, x AS ax, y AS ay, x + 1 AS bx, y AS b_y FROM c UNION ALL SELECT id, x, y + 1, x + 1, y + 1 FROM c UNION ALL SELECT id, x, y, x, y + 1 FROM c UNION ALL SELECT id, x + 1, y, x + 1, y + 1 FROM c),
o AS (SELECT id, ax, ay, bx, b_y FROM e GROUP BY ALL HAVING count(*) = 1) SELECT id, count(*) AS n_edges FROM o GROUP BY id""")
def boundary_edges(spark, sf_dir):
    members = G.with_shapes(_Net(spark, sf_dir).local(), D.shapes(spark, sf_dir))
    return G.boundary_edges(G.edges(members, "id", "unit"), "id").groupBy("id").agg(F.count("*").alias("n_edges"))


@_query(f"""WITH RECURSIVE {_LOCAL} SELECT l.id, CAST(min(x) AS DOUBLE) AS west, CAST(min(y) AS DOUBLE) AS south, CAST(max(x) + 1 AS DOUBLE) AS east, CAST(max(y) + 1 AS DOUBLE) AS north,
  CAST(count(*) AS DOUBLE) AS planar_area, round(avg(x + 0.5), 6) AS cx, round(avg(y + 0.5), 6) AS cy FROM local l JOIN units u USING (unit) GROUP BY l.id""")
def planar_measures(spark, sf_dir):
    members = G.with_shapes(_Net(spark, sf_dir).local(), D.shapes(spark, sf_dir))
    rows = G.planar(G.edges(members, "id", "unit"), "id")
    return rows.select("id", "west", "south", "east", "north", F.round("planar_area", 6).alias("planar_area"), F.round("cx", 6).alias("cx"), F.round("cy", 6).alias("cy"))


@_query(f"""WITH RECURSIVE {_LOCAL}, c AS (SELECT l.id, u.x, u.y FROM local l JOIN units u USING (unit)),
r AS (SELECT id, x, y, x AS rx, y AS ry FROM c UNION SELECT r.id, c.x, c.y, r.rx, r.ry FROM r JOIN c ON c.id = r.id AND abs(c.x - r.x) + abs(c.y - r.y) = 1),
m AS (SELECT id, x, y, min((rx + 1000) * 10000 + ry + 1000) AS part FROM r GROUP BY id, x, y)
SELECT id, count(DISTINCT part) AS n_parts, CAST(count(*) AS DOUBLE) AS planar_area FROM m GROUP BY id""")
def dissolve_parts(spark, sf_dir):
    members = G.with_shapes(_Net(spark, sf_dir).local(), D.shapes(spark, sf_dir)).withColumnRenamed("unit", "member")
    merged = cut(G.dissolve(G.edges(members, "id", "member"), "id"))
    area = G.planar(G.edges(merged, "id"), "id").select("id", F.round("planar_area", 6).alias("planar_area"))
    return merged.select("id", F.size("geom").cast("long").alias("n_parts")).join(area, "id")


@_query("""WITH RECURSIVE sq AS (SELECT doc_id // 8 AS i, doc_id % 8 AS k FROM documents),
put AS (SELECT i, 7 * (i % 300) + [0, 1, 2, 3, 3, 2, 1, 0][k + 1] AS a, 7 * (i // 300) + [0, 0, 0, 1, 2, 3, 3, 2][k + 1] AS b FROM sq),
cells AS (SELECT DISTINCT i, a + da AS x, b + db AS y FROM put, (VALUES (0, 0), (1, 0), (0, 1), (1, 1)) d(da, db)),
reach AS (SELECT i, x, y, x AS rx, y AS ry FROM cells UNION SELECT r.i, c.x, c.y, r.rx, r.ry FROM reach r JOIN cells c ON c.i = r.i AND abs(c.x - r.x) + abs(c.y - r.y) = 1),
parts AS (SELECT i, x, y, min(rx * 100000000 + ry) AS part FROM reach GROUP BY i, x, y),
sides AS (SELECT part, x, y, x + 1 AS x2, y AS y2 FROM parts UNION ALL SELECT part, x, y + 1, x + 1, y + 1 FROM parts UNION ALL SELECT part, x, y, x, y + 1 FROM parts UNION ALL SELECT part, x + 1, y, x + 1, y + 1 FROM parts),
each AS (SELECT part, x, y, x2, y2, count(*) AS n FROM sides GROUP BY ALL), e AS (SELECT part, count(*) AS e, count(*) FILTER (WHERE n = 1) AS outer_sides FROM each GROUP BY part),
v AS (SELECT part, count(*) AS v FROM (SELECT part, x, y FROM sides UNION SELECT part, x2, y2 FROM sides) GROUP BY part),
f AS (SELECT part, count(*) AS f, min(x) / 2 AS west, min(y) / 2 AS south FROM parts GROUP BY part)
SELECT CAST(west AS DOUBLE) AS west, CAST(south AS DOUBLE) AS south, f / 4 AS planar_area, 1 - (v - e + f) AS n_holes, outer_sides / 2 AS perimeter FROM f JOIN e USING (part) JOIN v USING (part)""")
def overlay_union(spark, sf_dir):
    """The union of all overlapping squares as one label, noded and covered by joins over grid cells, and its parts by list ranking."""
    lines = cut(G.edges(D.islands(spark, sf_dir), "unit").withColumn("k", F.lit(1)))
    rings = cut(R.ring_edges(A.union_boundary(lines, "k"), "k"))
    measures = cut(R.ring_measures(rings, "k"))
    owner = R.shells(rings, measures, "k")
    corners = rings.groupBy("ring").agg(F.min("x1").alias("west"), F.min("y1").alias("south"))
    each = measures.join(owner, "ring").join(corners, "ring")
    parts = each.groupBy("polygon").agg(F.min("west").alias("west"), F.min("south").alias("south"), F.round(F.sum("area"), 6).alias("planar_area"), (F.count("*") - 1).alias("n_holes"), F.round(F.sum("length"), 6).alias("perimeter"))
    return parts.drop("polygon")


@_query("""WITH c AS (SELECT doc_id AS x, 0 AS y FROM documents UNION ALL SELECT doc_id, 1 FROM documents WHERE doc_id % 2 = 0),
e AS (SELECT x, y, x AS x1, y AS y1, x + 1 AS x2, y AS y2 FROM c UNION ALL SELECT x, y, x + 1, y, x + 1, y + 1 FROM c UNION ALL SELECT x, y, x + 1, y + 1, x, y + 1 FROM c UNION ALL SELECT x, y, x, y + 1, x, y FROM c),
o AS (SELECT * FROM e WHERE NOT EXISTS (SELECT 1 FROM e f WHERE f.x1 = e.x2 AND f.y1 = e.y2 AND f.x2 = e.x1 AND f.y2 = e.y1))
SELECT CAST(x1 AS DOUBLE) AS x1, CAST(y1 AS DOUBLE) AS y1, CAST(x2 AS DOUBLE) AS x2, CAST(y2 AS DOUBLE) AS y2, (SELECT count(*) FROM o) AS n, CAST((SELECT count(*) FROM c) AS DOUBLE) AS area, true AS follows FROM o""")
def long_ring(spark, sf_dir):
    """One ring around all squares, ranked over many tasks: each edge with the ring's edges and area, and whether the edge placed after it begins where it ends."""
    lines = G.edges(D.comb(spark, sf_dir), "unit").withColumn("k", F.lit(1))
    rings = cut(R.ring_edges(A.boundary_edges(lines, "k"), "k"))
    measures = R.ring_measures(rings, "k").select("ring", F.round("area", 6).alias("area"))
    after = rings.select("ring", "seq", F.col("x1").alias("nx"), F.col("y1").alias("ny"))
    both = rings.withColumn("then", F.pmod(F.col("seq") + 1, F.col("n"))).join(after.withColumnRenamed("seq", "then"), ["ring", "then"])
    return both.join(measures, "ring").select("x1", "y1", "x2", "y2", "n", "area", ((F.col("x2") == F.col("nx")) & (F.col("y2") == F.col("ny"))).alias("follows"))


@_query("""SELECT doc_id AS unit, doc_id % 16 >= 12 AS repaired, CAST(CASE WHEN doc_id % 16 IN (12, 15) THEN 2 ELSE 1 END AS BIGINT) AS n_parts, CAST(CASE WHEN doc_id % 16 = 15 THEN 1 ELSE 0 END AS BIGINT) AS n_holes,
  CAST(CASE doc_id % 16 WHEN 12 THEN 2 WHEN 15 THEN 16 - 2 - 3 + 1 ELSE 4 END AS DOUBLE) AS planar_area FROM documents""")
def linework_repair(spark, sf_dir):
    """Shapes repaired from their lines: lobes that cross, doubled rings, spikes, holes that cross, and squares that stay as they are."""
    rows = cut(G.repaired(D.damaged(spark, sf_dir), "unit"))
    areas = G.planar(G.edges(rows, "unit"), "unit").select("unit", F.round("planar_area", 6).alias("planar_area"))
    holes = F.aggregate("geom", F.lit(0), lambda n, p: n + F.size(p) - 1).cast("long")
    return rows.select("unit", "repaired", F.size("geom").cast("long").alias("n_parts"), holes.alias("n_holes")).join(areas, "unit")


@_query()
def geodesic_areas(spark, sf_dir):
    """Ellipsoidal area of every unit."""
    return G.area_km2(G.edges(D.shapes(spark, sf_dir), "unit"), "unit").select("unit", F.round("area_km2", 6).alias("area_km2"))


@_query(f"""WITH {_UNITS}, pole AS (SELECT 6378137.0 * (1 - 1 / 298.257223563) AS b, sqrt((2 - 1 / 298.257223563) / 298.257223563) AS e)
SELECT unit, 'cell' AS kind, CAST(12308.778362 AS DOUBLE) AS area_km2 FROM units WHERE y IN (-1, 0)
UNION ALL SELECT unit, 'wedge', round(radians(unit % 20 + 1) * b * b / 2 * (1 / (1 - e * e) + ln((1 + e) / (1 - e)) / (2 * e)) / 1e6, 3) FROM units, pole""")
def geodesic_closed_forms(spark, sf_dir):
    """Ellipsoidal areas that have a known value: cells that touch the equator (the published one), and wedges between two meridians, the equator and a pole."""
    cells = D.shapes(spark, sf_dir).join(D.units(spark, sf_dir).filter("y IN (-1, 0)").select("unit"), "unit").withColumn("kind", F.lit("cell"))
    u = D.units(spark, sf_dir).withColumn("w", F.col("unit") % 20 + 1)
    corner = lambda x, y: F.struct(x.cast("double").alias("x"), F.lit(y).cast("double").alias("y"))
    west, east = F.col("x"), F.col("x") + F.col("w")
    up, down = ([corner(west, 0), corner(east, 0), *(corner(east, s * y) for y in (17, 64)), corner(west, s * 90), corner(west, s * 31), corner(west, 0)] for s in (1, -1))
    wedges = u.select("unit", F.array(F.array(F.when(F.col("unit") % 2 == 0, F.array(*up)).otherwise(F.array(*down)))).alias("geom"), F.lit("wedge").alias("kind"))
    areas = G.area_km2(G.edges(cells.unionByName(wedges), "unit", "kind"), "unit", "kind")
    return areas.select("unit", "kind", F.when(F.col("kind") == "cell", F.round("area_km2", 6)).otherwise(F.round("area_km2", 3)).alias("area_km2"))


@_query(f"WITH RECURSIVE {_TOTAL} SELECT id, CAST(count(*) AS DOUBLE) AS planar_area, CAST(1 AS DOUBLE) AS of_parts FROM total GROUP BY id")
def total_area_consistency(spark, sf_dir):
    """The dissolved total: its planar area (a unit a cell), and its ellipsoidal area as a share of the sum of the local ones over the project and all above it."""
    net = _Net(spark, sf_dir)
    local, closure = cut(net.local()), N.project_closure(net.edges())
    shapes, lower = D.globe_shapes(spark, sf_dir)
    bounds = lambda m: G.boundary_edges(G.edges(G.with_shapes(m, shapes), "id", "unit"), "id")
    parts = G.area_km2(bounds(local), "id").select(F.col("id").alias("above"), "area_km2")
    pairs = closure.union(local.select("id", F.col("id").alias("above")).distinct())
    summed = pairs.join(parts, "above").groupBy("id").agg(F.sum("area_km2").alias("summed"))
    total = cut(bounds(N.total_members(local, closure)))
    planar = G.planar(total, "id").select("id", F.round(F.col("planar_area") * lower, 6).alias("planar_area"))
    return G.area_km2(total, "id").join(summed, "id").join(planar, "id").select("id", "planar_area", F.round(F.col("area_km2") / F.col("summed"), 9).alias("of_parts"))


@_query(f"""WITH RECURSIVE {_LOCAL}, {_NEXT.split(_UNITS + ",")[1].strip()},
units_of AS (SELECT id, string_agg(unit, ',' ORDER BY unit) AS hybas_ids, count(*) AS unit_count FROM local GROUP BY id),
net AS (SELECT f.id, f.down, coalesce(string_agg(a.above, ',' ORDER BY a.ord), '') AS above, coalesce(string_agg(a.above, ',' ORDER BY a.ord) FILTER (WHERE g.down = f.id), '') AS up
  FROM following f LEFT JOIN above a ON a.id = f.id LEFT JOIN following g ON g.id = a.above GROUP BY f.id, f.down),
sizes AS (SELECT t.id, count(*) AS n FROM total t GROUP BY t.id)
SELECT p.id, p.ord, p.name, CAST(p.lat AS DOUBLE) AS lat, CAST(p.lon AS DOUBLE) AS lon, p.hybas_id, u.hybas_ids, u.unit_count, n.down, n.up, n.above, 'local' AS part, CAST(NULL AS VARCHAR) AS outlet_source, CAST(NULL AS VARCHAR) AS outlet_reference,
  CAST(u.unit_count AS DOUBLE) AS planar_area, CAST(1 AS DOUBLE) AS area_of_cells, CAST(1 AS DOUBLE) AS area_local_of_cells, CAST(1 AS DOUBLE) AS area_total_of_cells, s.n AS n_total
FROM projects p JOIN units_of u USING (id) JOIN net n USING (id) JOIN sizes s USING (id)""")
def feature_rows(spark, sf_dir):
    """Whole features: all keys of the output. Areas are given as shares of the sums over the cells, which SQL can't give."""
    units, projects = D.units(spark, sf_dir), cut(D.projects(spark, sf_dir))
    shapes, lower = D.globe_shapes(spark, sf_dir)
    rows = cut(catchments(units, projects, shapes))
    cells = cut(G.area_km2(G.edges(shapes, "unit"), "unit"))
    own = rows.select("id", F.explode("hybas_ids").alias("unit")).join(cells.hint("merge"), "unit").groupBy("id").agg(F.sum("area_km2").alias("own"), F.count("*").alias("n"))
    within = rows.select("id", F.explode(F.concat("above", F.array("id"))).alias("above")).hint("merge").join(own.withColumnRenamed("id", "above"), "above").groupBy("id").agg(F.sum("own").alias("all"), F.sum("n").alias("n_total"))
    planar = G.planar(G.edges(rows, "id"), "id").select("id", F.round(F.col("planar_area") * lower, 6).alias("planar_area"))
    share = lambda area, of: F.round(F.col(area) / F.col(of), 9).alias(f"{area}_of_cells")
    return rows.hint("merge").join(own.drop("n"), "id").join(within, "id").join(planar, "id").select(
        "id", "ord", "name", "lat", "lon", "hybas_id", F.array_join("hybas_ids", ",").alias("hybas_ids"), "unit_count", "down", F.array_join("up", ",").alias("up"), F.array_join("above", ",").alias("above"),
        "part", F.col("source").alias("outlet_source"), F.col("reference").alias("outlet_reference"), "planar_area", share("area", "own"), share("area_local", "own"), share("area_total", "all"), "n_total",
    )


@_query(f"""WITH {_UNITS} SELECT coalesce(project_code, id) AS "ProjectCode", name || ' local incremental catchment' AS "PolygonName",
  printf('%.4f', greatest(CAST(y AS DECIMAL(9, 4)) - 0.3, -90)) AS "MinLatitude", printf('%.4f', least(CAST(y + 1 AS DECIMAL(9, 4)) + 0.3, 90)) AS "MaxLatitude",
  printf('%.4f', greatest(CAST(x AS DECIMAL(9, 4)) - 0.3, -180)) AS "MinLongitude", printf('%.4f', least(CAST(x + 1 AS DECIMAL(9, 4)) + 0.3, 180)) AS "MaxLongitude",
  printf('%.4f', lat) AS "CentroidLatitude", printf('%.4f', lon) AS "CentroidLongitude", '0.3' AS "BufferDegreesApplied" FROM projects JOIN units ON unit = hybas_id""")
def bbox_summary(spark, sf_dir):
    """The CSV's columns (without the area, which SQL can't give) of every project's own unit."""
    p = D.projects(spark, sf_dir).withColumnRenamed("hybas_id", "unit").join(D.shapes(spark, sf_dir), "unit").withColumn("part", F.lit("local"))
    return bbox_rows(p).drop("ord", "AreaKm2")


@_query(f"""WITH RECURSIVE {_LOCAL}, b AS (SELECT l.id, min(x) AS west, min(y) AS south, max(x) + 1 AS east, max(y) + 1 AS north, (sum(x - 0.0::DOUBLE) - count(*) * min(x) + count(*) * 0.5::DOUBLE) / count(*) + min(x) AS cx,
  (sum(y - 0.0::DOUBLE) - count(*) * min(y) + count(*) * 0.5::DOUBLE) / count(*) + min(y) AS cy
  FROM local l JOIN units u USING (unit) GROUP BY l.id)
SELECT coalesce(project_code, id) AS "ProjectCode", name || ' local incremental catchment' AS "PolygonName",
  printf('%.4f', greatest(CAST(south AS DECIMAL(9, 4)) - 0.3, -90)) AS "MinLatitude", printf('%.4f', least(CAST(north AS DECIMAL(9, 4)) + 0.3, 90)) AS "MaxLatitude",
  printf('%.4f', greatest(CAST(west AS DECIMAL(9, 4)) - 0.3, -180)) AS "MinLongitude", printf('%.4f', least(CAST(east AS DECIMAL(9, 4)) + 0.3, 180)) AS "MaxLongitude",
  printf('%.4f', cy) AS "CentroidLatitude", printf('%.4f', cx) AS "CentroidLongitude", true AS area_is_sum, '0.3' AS "BufferDegreesApplied" FROM projects JOIN b USING (id)""")
def bbox_catchments(spark, sf_dir):
    """The CSV's rows of every project's dissolved local catchment; SQL can't give the area, which is held against the cells' sum."""
    net = _Net(spark, sf_dir)
    members = G.with_shapes(net.local(), D.shapes(spark, sf_dir)).withColumnRenamed("unit", "member")
    lines, projects = G.edges(members, "id", "member"), net.projects
    shape = cut(G.dissolve(lines, "id"))
    summed = G.polygon_area_sum_km2(lines.withColumn("poly", F.col("member")), "id").join(projects.select("id", "ord"), "id").select("ord", F.col("area_km2").alias("summed"))
    rows = bbox_rows(G.with_shapes(projects, shape, "id").withColumn("part", F.lit("local"))).join(summed, "ord")
    return rows.withColumn("area_is_sum", F.abs(F.col("AreaKm2").cast("double") - F.col("summed")) < 0.051).drop("ord", "AreaKm2", "summed")


def _layers(spark, sf_dir) -> DataFrame:
    """Two layers with the suppliers' units: even and odd nations."""
    owner = D.table(spark, sf_dir, "supplier").select(((F.col("s_suppkey") + 1) * 7).cast("long").alias("unit"), F.when(F.col("s_nationkey") % 2 == 0, "even").otherwise("odd").alias("label"))
    return owner.join(D.shapes(spark, sf_dir), "unit").select("label", F.col("unit").cast("string").alias("id"), "geom")


@_query(f"""WITH {_UNITS} SELECT CASE WHEN s_nationkey % 2 = 0 THEN 'even' ELSE 'odd' END AS label, CAST(count(*) AS DOUBLE) AS planar_area, CAST(1 AS DOUBLE) AS of_cells, count(*) AS n FROM projects GROUP BY ALL""")
def layer_compare(spark, sf_dir):
    """The dissolved layers: planar area (a unit a cell), and the compared area as a share of the sum over its cells."""
    layers = _layers(spark, sf_dir)
    cells = G.area_km2(G.edges(layers, "label", "id"), "label", "id").groupBy("label").agg(F.sum("area_km2").alias("summed"), F.count("*").alias("n"))
    merged = G.dissolve(G.edges(layers, "label", "id"), "label")
    planar = G.planar(G.edges(merged, "label"), "label").select("label", F.round("planar_area", 6).alias("planar_area"))
    return layer_areas(layers).join(cells, "label").join(planar, "label").select("label", "planar_area", F.round(F.col("area_km2") / F.col("summed"), 9).alias("of_cells"), "n")


@_query("""WITH a AS (SELECT DISTINCT lower(c_mktsegment || c_nationkey) AS id FROM customer WHERE c_acctbal > 5000), b AS (SELECT DISTINCT lower(c_mktsegment || c_nationkey) AS id FROM customer WHERE c_acctbal < 0)
(SELECT id FROM a EXCEPT SELECT id FROM b) UNION ALL (SELECT id FROM b EXCEPT SELECT id FROM a)""")
def layer_id_equality(spark, sf_dir):
    """Ids that one of two layers lacks."""
    c = D.table(spark, sf_dir, "customer").select("c_acctbal", F.concat("c_mktsegment", "c_nationkey").alias("id"))
    return same_ids(c.filter("c_acctbal > 5000").select("id"), c.filter("c_acctbal < 0").select("id"))


@_query("SELECT s_suppkey AS ord, s_name AS name FROM supplier WHERE s_suppkey = (SELECT max(s_suppkey) FROM supplier)")
def select_project_by_name(spark, sf_dir):
    suppliers = D.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("ord"), F.col("s_suppkey").cast("string").alias("id"), F.col("s_name").alias("name"))
    last = suppliers.agg(F.max_by("name", "ord")).first()[0]
    return select_project(suppliers, f" {last.upper()} ").select("ord", "name")


@_query("""SELECT CAST(event_id % 360 - 180 AS DOUBLE) AS lon, CAST(user_id % 180 - 90 AS DOUBLE) AS lat, min(event_id) AS first_event FROM events GROUP BY ALL""")
def marker_extract(spark, sf_dir):
    """Distinct markers, each with the first event that has it."""
    e = D.table(spark, sf_dir, "events")
    p = F.create_map(F.lit("LATITUDE"), (F.col("user_id") % 180 - 90).cast("string"), F.lit("lon"), (F.col("event_id") % 360 - 180).cast("string"), F.lit("lat"), F.lit("5"))
    rows = e.select(F.lit(0).alias("layer"), F.col("event_id").alias("ord"), F.col("event_id").cast("string").alias("name"), p.alias("properties"))
    return markers(rows).select("lon", "lat", F.col("name").cast("long").alias("first_event"))


@_query("""SELECT s_suppkey, regexp_full_match(s_name, '[A-Za-z0-9][A-Za-z0-9_-]*') AS raw_ok, regexp_full_match(replace(s_name, '#', '_'), '[A-Za-z0-9][A-Za-z0-9_-]*') AS clean_ok FROM supplier""")
def id_regex(spark, sf_dir):
    return D.table(spark, sf_dir, "supplier").select("s_suppkey", matches_name("s_name").alias("raw_ok"), matches_name(F.regexp_replace("s_name", "#", "_")).alias("clean_ok"))


@_query("""SELECT page_id, CASE WHEN s = '' THEN 'project' ELSE s END AS stem FROM (SELECT page_id, trim(regexp_replace(url, '[^A-Za-z0-9_-]+', '_', 'g'), '_') AS s FROM pages)""")
def filename_sanitize(spark, sf_dir):
    return D.table(spark, sf_dir, "pages").select("page_id", file_stem("url").alias("stem"))


@_query("SELECT lower(p_name) AS name, count(*) AS times FROM part GROUP BY 1 HAVING count(*) > 1")
def uniqueness_violations(spark, sf_dir):
    return N.duplicates(D.table(spark, sf_dir, "part").select(casefolded("p_name").alias("name")), "name")


@_query("SELECT doc_id, sha256(text) AS sha256 FROM documents")
def text_sha256(spark, sf_dir):
    return D.table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))


@_query(f"WITH {_UNITS} SELECT unit, CAST(x AS DOUBLE) AS west, CAST(y + 1 AS DOUBLE) AS north FROM units")
def geojson_roundtrip(spark, sf_dir):
    """Shapes written as GeoJSON features and parsed again, by the library's own writer and reader."""
    texts = D.shapes(spark, sf_dir).select(F.col("unit").alias("ord"), F.to_json(F.struct(F.lit("Feature").alias("type"), F.parse_json(geometry_json("geom")).alias("geometry"))).alias("feature"))
    ring = F.get(F.get("geom", 0), 0)
    return parsed_features(texts).select(F.col("ord").alias("unit"), F.array_min(F.transform(ring, lambda p: p["x"])).alias("west"), F.array_max(F.transform(ring, lambda p: p["y"])).alias("north"))
