"""Shapefiles as a Spark data source: ``spark.read.format("shapes").load(path)``.

Columns: oid, properties (map of strings) and geom. Partitions are ranges of records found through the index file, so a
layer is decoded by many tasks; ``option("geometry", "false")`` reads attributes only, and ``decoded_shapes`` then reads the
geometry of wanted records alone. Records marked as deleted are left out. The files must be on a file system that all executors see.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from headwater.operators.geometry import GEOMETRY

SCHEMA = f"oid long, properties map<string,string>, geom {GEOMETRY}"
RECORDS = 20_000
#: Shape types with polygons: plain, with z, with m.
POLYGON = (5, 15, 25)
_ARROW = pa.list_(pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))))


def dbf_fields(path: Path) -> tuple[int, int, int, list[tuple[str, str, int]]]:
    """(records, header bytes, record bytes, fields as (name, type, width))."""
    with path.open("rb") as f:
        head = f.read(32)
        records, header, width = struct.unpack("<IHH", head[4:12])
        fields = []
        while (entry := f.read(32))[:1] not in (b"\r", b""):
            fields.append((entry[:11].split(b"\0")[0].decode("latin-1"), chr(entry[11]), entry[16]))
    return records, header, width, fields


def dbf_rows(path: Path, first: int, last: int, encoding: str) -> Iterator[dict[str, str | None] | None]:
    """Attributes of each record; None for a deleted one."""
    _, header, width, fields = dbf_fields(path)
    with path.open("rb") as f:
        f.seek(header + first * width)
        for _ in range(first, last):
            row, at, out = f.read(width), 1, {}
            if row[:1] == b"*":
                yield None
                continue
            for name, kind, size in fields:
                cell = row[at : at + size].decode(encoding, "replace").strip(" \0")
                at += size
                out[name] = None if not cell or (kind in "NF" and set(cell) == {"*"}) else cell
            yield out


def polygon_of(record: bytes) -> list | None:
    """Polygons of a record: clockwise rings are shells, others holes of the least shell around them."""
    if len(record) < 44 or struct.unpack("<i", record[:4])[0] not in POLYGON:
        return None
    from headwater.operators.overlay import _inside, signed_area
    import numpy as np

    parts, points = struct.unpack("<2i", record[36:44])
    starts = [*struct.unpack(f"<{parts}i", record[44 : 44 + 4 * parts]), points]
    xy = np.frombuffer(record, "<f8", 2 * points, 44 + 4 * parts).reshape(-1, 2)
    rings = [xy[a:b] for a, b in zip(starts[:-1], starts[1:], strict=True) if b > a]
    if not rings:
        return None
    shells = sorted((r for r in rings if signed_area(r) <= 0), key=lambda r: -signed_area(r)) or rings[:1]
    out = [[s] for s in shells]
    for hole in (r for r in rings if not any(r is s for s in shells)):
        home = next((k for k, s in enumerate(shells) if _inside(hole.mean(0), s) or _inside(hole[0], s)), len(shells) - 1)
        out[home].append(hole)
    return [[list(map(tuple, ring.tolist())) for ring in polygon] for polygon in out]


class _Range(InputPartition):
    def __init__(self, first: int, last: int):
        super().__init__((first, last))
        self.first, self.last = first, last


class _Reader(DataSourceReader):
    def __init__(self, path: Path, geometry: bool):
        self.path, self.geometry = path, geometry

    def partitions(self):
        records = dbf_fields(self.path.with_suffix(".dbf"))[0]
        return [_Range(a, min(a + RECORDS, records)) for a in range(0, records, RECORDS)] or [_Range(0, 0)]

    def read(self, partition):
        cpg = self.path.with_suffix(".cpg")
        encoding = (cpg.read_text().strip() if cpg.exists() else "") or "utf-8"
        rows = dbf_rows(self.path.with_suffix(".dbf"), partition.first, partition.last, encoding)
        if not self.geometry:
            yield from ((oid, row, None) for oid, row in enumerate(rows, partition.first) if row is not None)
            return
        oids, kept = range(partition.first, partition.last), list(rows)
        for oid, geom in zip(oids, records_at(self.path, oids), strict=True):
            if kept[oid - partition.first] is not None:
                yield oid, kept[oid - partition.first], geom


def records_at(shp: Path, oids: Iterable[int]) -> Iterator[list | None]:
    """Polygons of records, each found through the index file."""
    with shp.with_suffix(".shx").open("rb") as index, shp.open("rb") as shapes:
        for oid in oids:
            index.seek(100 + 8 * oid)
            offset, words = struct.unpack(">2i", index.read(8))
            shapes.seek(2 * offset + 8)
            yield polygon_of(shapes.read(2 * words))


def decoded_shapes(wanted: DataFrame, shp: str | Path) -> DataFrame:
    """(unit, geom) of rows (unit, oid): the geometry of these records alone is read, in the order of the file within a task."""
    shp = Path(shp)

    def read(batches):
        for batch in batches:
            geoms = pa.array(list(records_at(shp, batch.column("oid").to_pylist())), _ARROW)
            yield pa.RecordBatch.from_arrays([batch.column("unit"), geoms], ["unit", "geom"])

    return wanted.repartitionByRange("oid").sortWithinPartitions("oid").select("unit", "oid").mapInArrow(read, f"unit long, geom {GEOMETRY}")


class ShapeSource(DataSource):
    @classmethod
    def name(cls):
        return "shapes"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(Path(self.options["path"]), self.options.get("geometry", "true").lower() != "false")


def read_shapes(spark: SparkSession, path: str | Path, geometry: bool = True) -> DataFrame:
    spark.dataSource.register(ShapeSource)
    return spark.read.format("shapes").option("geometry", str(geometry).lower()).load(str(path))
