"""Attribute tables of shapefiles as a columnar Spark data source: ``spark.read.format("dbf").schema("oid long, NAME string").load(path)``.

Records have a fixed width, so a task reads a range of them as one block of bytes and decodes whole columns into Arrow arrays. Only the columns of the
schema are decoded; without one all fields are, numbers without decimals as long, with decimals as double, others as text. A cell that is blank,
starred, or no number where one is asked for is null. Records marked as deleted are left out. ``oid`` is the record's number.

Where the session allows it (``spark.sql.python.filterPushdown.enabled``) comparisons of a column with a value, and tests for null, are applied before any other
column is decoded. The file must be on a file system that all executors see.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as S
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

#: Bytes of records that are decoded at a time, and that a task reads.
BLOCK, SPLIT = 4 << 20, 64 << 20
_COMPARED = {S.EqualTo: pc.equal, S.GreaterThan: pc.greater, S.GreaterThanOrEqual: pc.greater_equal, S.LessThan: pc.less, S.LessThanOrEqual: pc.less_equal}
_ARROW = {"bigint": pa.int64(), "double": pa.float64(), "string": pa.string()}
PUSHING = "spark.sql.python.filterPushdown.enabled"


def fields_of(path: Path) -> tuple[int, int, int, dict[str, tuple[int, int, str, int]]]:
    """(records, header bytes, record bytes, name -> (first byte in a record, width, kind, decimals))."""
    with path.open("rb") as f:
        records, header, width = struct.unpack("<4xIHH20x", f.read(32))
        fields, at = {}, 1
        while (entry := f.read(32))[:1] not in (b"\r", b""):
            fields[entry[:11].split(b"\0")[0].decode("latin-1")] = (at, entry[16], chr(entry[11]), entry[17])
            at += entry[16]
    return records, header, width, fields


def encoding_of(path: Path) -> str:
    """The text encoding that a file beside the table names, else UTF-8."""
    beside = path.with_suffix(".cpg")
    return (beside.read_text().strip() if beside.exists() else "") or "utf-8"


def column_of(cells: np.ndarray, kind: str, encoding: str) -> pa.Array:
    """A column of fixed-width cells (rows of bytes) as long, double or text."""
    n, width = cells.shape
    flat = np.ascontiguousarray(cells).tobytes()
    texts = pa.Array.from_buffers(pa.string(), n, [None, pa.py_buffer(np.arange(0, (n + 1) * width, width, dtype=np.int32).tobytes()), pa.py_buffer(flat)])
    plain = encoding.lower().replace("_", "-") in ("utf-8", "utf8", "ascii", "us-ascii")
    if not flat.isascii():
        try:
            if not plain:
                raise pa.ArrowInvalid
            texts.validate(full=True)
        except pa.ArrowInvalid:
            texts = pa.array([flat[k * width : (k + 1) * width].decode(encoding, "replace") for k in range(n)], pa.string())
    texts = pc.utf8_trim(texts, " \0")
    blank = pc.equal(texts, "")
    if kind == "string":
        return pc.if_else(blank, pa.scalar(None, pa.string()), texts)
    if kind == "bigint":
        texts = pc.replace_substring_regex(texts, r"[.]0*$", "")
    number = pc.match_substring_regex(texts, r"^[+-]?[0-9]{1,18}$" if kind == "bigint" else r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$")
    texts = pc.if_else(number, pc.utf8_ltrim(texts, "+"), pa.scalar(None, pa.string()))
    return pc.cast(texts, _ARROW[kind])


class _Records(S.InputPartition):
    def __init__(self, first: int, last: int):
        super().__init__((first, last))
        self.first, self.last = first, last


class _Reader(S.DataSourceReader):
    def __init__(self, path: Path, schema: StructType):
        self.path, self.schema, self.filters = path, schema, []

    def partitions(self):
        records, _, width, _ = fields_of(self.path)
        step = max(SPLIT // width, 1)
        return [_Records(a, min(a + step, records)) for a in range(0, records, step)] or [_Records(0, 0)]

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        _, header, width, fields = fields_of(self.path)
        encoding = encoding_of(self.path)
        step = max(BLOCK // width, 1)
        with self.path.open("rb") as f:
            for first in range(partition.first, partition.last, step):
                f.seek(header + first * width)
                raw = f.read((min(first + step, partition.last) - first) * width)
                rows = np.frombuffer(raw, np.uint8, len(raw) // width * width).reshape(-1, width)
                oid = np.flatnonzero(rows[:, 0] != ord("*"))
                rows, oid = rows[oid], oid + first

                def column(name, rows=None, oid=None):
                    if name == "oid":
                        return pa.array(oid, pa.int64())
                    at, size, *_ = fields[name]
                    kind = self.schema[name].dataType.simpleString()
                    return column_of(rows[:, at : at + size], kind, encoding)

                for test in self.filters:
                    cells = column(test.attribute[0], rows, oid)
                    held = cells.is_valid() if type(test) is S.IsNotNull else pc.fill_null(_COMPARED[type(test)](cells, test.value), False)
                    held = held.to_numpy(zero_copy_only=False)
                    rows, oid = rows[held], oid[held]
                yield pa.RecordBatch.from_arrays([column(f.name, rows, oid) for f in self.schema.fields], [f.name for f in self.schema.fields])


class _PushingReader(_Reader):
    def pushFilters(self, filters):
        for test in filters:
            known = len(test.attribute) == 1 and test.attribute[0] in self.schema.names
            if known and (type(test) is S.IsNotNull or type(test) in _COMPARED and isinstance(test.value, int | float | str)):
                self.filters.append(test)
            else:
                yield test


class TableSource(S.DataSource):
    @classmethod
    def name(cls):
        return "dbf"

    def schema(self):
        kinds = {k: LongType() if kind in "NF" and not decimals and width <= 18 else DoubleType() if kind in "NF" else StringType() for k, (_, width, kind, decimals) in fields_of(Path(self.options["path"]))[3].items()}
        return StructType([StructField("oid", LongType()), *(StructField(k, v) for k, v in kinds.items())])

    def reader(self, schema):
        path = Path(self.options["path"])
        known = fields_of(path)[3]
        for f in schema.fields:
            if f.name != "oid" and f.name not in known:
                raise ValueError(f"{path}: no column {f.name}")
            if f.dataType.simpleString() not in _ARROW or (f.name == "oid" and f.dataType != LongType()):
                raise ValueError(f"{path}: column {f.name} can be read as long, double or string")
        return (_PushingReader if self.options.get("pushing") == "true" else _Reader)(path, schema)


def read_dbf(spark: SparkSession, path: str | Path, schema: str | None = None) -> DataFrame:
    """The table at ``path``: the columns of ``schema``, or all of them."""
    spark.dataSource.register(TableSource)
    reader = spark.read.format("dbf").option("pushing", str(spark.conf.get(PUSHING, "false")).lower())
    return (reader.schema(schema) if schema else reader).load(str(path))
