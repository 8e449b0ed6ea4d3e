"""A drainage network, projects and layers derived from the order tables, for queries and benchmarks.

Parts become units: unit = key + 1 drains into unit // 3, every tenth size is a virtual link, and each unit covers a
one-degree cell. Suppliers become projects at every seventh unit, their outlets in the cell's middle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def units(spark: SparkSession, sf_dir: str, chain: int | None = None) -> DataFrame:
    """(unit, next_down, endo, x, y). With ``chain``, each unit drains into the one before, in chains of that many."""
    unit = (F.col("p_partkey") + 1).cast("long")
    down = F.when(unit % chain == 1, F.lit(0)).otherwise(unit - 1) if chain else F.floor(unit / 3)
    parts = table(spark, sf_dir, "part").filter("p_partkey is not null")
    return parts.select(
        unit.alias("unit"), down.cast("long").alias("next_down"), F.when(F.col("p_size") % 10 == 0, 2).otherwise(0).alias("endo"),
        (unit % 300 - 150).cast("int").alias("x"), (F.floor(unit / 300) - 35).cast("int").alias("y"),
    )


def shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(unit, geom): one-degree cells, clockwise as shapefiles have them."""
    corner = lambda dx, dy: F.struct((F.col("x") + dx).cast("double").alias("x"), (F.col("y") + dy).cast("double").alias("y"))
    ring = F.array(corner(0, 0), corner(0, 1), corner(1, 1), corner(1, 0), corner(0, 0))
    return units(spark, sf_dir).select("unit", F.array(F.array(ring)).alias("geom"))


#: Latitude that cells on the globe keep to: the area of a short edge is noisy near a pole.
LATITUDE = 60


def globe_shapes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """(unit, geom) for ellipsoidal areas, and how many cells share a degree of latitude.

    Rows of one-degree cells go past the pole beyond some 37,000 units, and nothing has an area there. So the same cells are laid on the globe, lower by a
    power of two, which leaves coordinates exact: what was a neighbour, an inner edge or an overlap still is one.
    """
    rows = units(spark, sf_dir).agg(F.max(F.greatest(F.abs("y"), F.abs(F.col("y") + 1)))).first()[0] or 0
    lower = 1
    while rows > LATITUDE * lower:
        lower *= 2
    point = lambda p: F.struct(p["x"].alias("x"), (p["y"] / lower).alias("y"))
    geom = F.transform("geom", lambda polygon: F.transform(polygon, lambda ring: F.transform(ring, point)))
    return shapes(spark, sf_dir).select("unit", geom.alias("geom")), lower


def _squares(rows: DataFrame, x: str, y: str, side: float) -> DataFrame:
    corner = lambda dx, dy: F.struct((F.col(x) + dx).cast("double").alias("x"), (F.col(y) + dy).cast("double").alias("y"))
    return rows.withColumn("geom", F.array(F.array(F.array(corner(0, 0), corner(side, 0), corner(side, side), corner(0, side), corner(0, 0)))))


#: Corners of the eight squares of an island, in half units: they overlap and lie around a hole.
ISLAND = ((0, 0), (1, 0), (2, 0), (3, 1), (3, 2), (2, 3), (1, 3), (0, 2))


def islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(unit, geom): a unit square a document; every eight overlap around a hole, a step apart from the next eight."""
    unit, k = F.col("doc_id"), F.pmod(F.col("doc_id"), F.lit(8)).cast("int")
    island = F.floor(unit / 8)
    at = F.get(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ISLAND]), k)
    rows = table(spark, sf_dir, "documents").filter("doc_id is not null").select(unit.cast("long").alias("unit"), ((F.pmod(island, F.lit(300)) * 7 + at["a"]) / 2).alias("x"), ((F.floor(island / 300) * 7 + at["b"]) / 2).alias("y"))
    return _squares(rows, "x", "y", 1).select("unit", "geom")


def comb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(unit, geom): unit squares side by side, one a document, and one more upon every second: a single ring around all."""
    rows = table(spark, sf_dir, "documents").filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("unit"))
    levels = F.when(F.col("unit") % 2 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return _squares(rows.select("unit", F.explode(levels).alias("y")), "unit", "y", 1).select("unit", "geom")


# Rings of the damaged shapes, in order: two lobes that cross, a ring that is there twice, a square with a spike, a square with two holes that cross.
DAMAGED = (
    (((0, 0), (2, 2), (2, 0), (0, 2), (0, 0)),),
    (((0, 0), (2, 0), (2, 2), (0, 2), (0, 0), (2, 0), (2, 2), (0, 2), (0, 0)),),
    (((0, 0), (2, 0), (2, 2), (4, 4), (2, 2), (0, 2), (0, 0)),),
    (((0, 0), (4, 0), (4, 4), (0, 4), (0, 0)), ((1, 1), (1, 2), (3, 2), (3, 1), (1, 1)), ((2, 1.5), (2, 3.5), (3.5, 3.5), (3.5, 1.5), (2, 1.5))),
)


def damaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(unit, geom): a shape a document; of every sixteen, the last four are the damaged ones, the others squares."""
    point = lambda x, y: F.struct((F.col("at") + float(x)).alias("x"), (F.lit(0.0) + float(y)).alias("y"))
    shape = lambda rings: F.array(F.array(*[F.array(*[point(*p) for p in ring]) for ring in rings]))
    kind, whole = F.col("unit") % 16, shape((((0, 0), (2, 0), (2, 2), (0, 2), (0, 0)),))
    for k, rings in enumerate(DAMAGED):
        whole = F.when(kind == 12 + k, shape(rings)).otherwise(whole)
    rows = table(spark, sf_dir, "documents").filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("unit"), (F.col("doc_id") % 100).cast("double").alias("at"))
    return rows.select("unit", whole.alias("geom"))


def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ord, id, name, hybas_id, lon, lat, project_code, source, reference)."""
    suppliers = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").cast("int").alias("ord"), F.regexp_replace("s_name", "#", "_").alias("id"), F.col("s_name").alias("name"), ((F.col("s_suppkey") + 1) * 7).cast("long").alias("hybas_id"),
        F.when(F.col("s_nationkey") % 2 == 0, F.concat(F.lit("N"), F.col("s_suppkey"))).alias("project_code"), F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("reference"),
    )
    at = units(spark, sf_dir).select(F.col("unit").alias("hybas_id"), (F.col("x") + 0.5).cast("double").alias("lon"), (F.col("y") + 0.5).cast("double").alias("lat"))
    return suppliers.join(at, "hybas_id")
