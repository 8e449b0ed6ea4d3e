"""The columnar attribute table against the reader of whole records."""

import struct

import pytest
from pyspark.sql import functions as F

from headwater.sources import dbf as D
from headwater.sources.shapefile import read_shapes
from tests.shapes import square, write_shapefile

FIELDS = [("ID", "N", 18), ("SIZE", "N", 12), ("NAME", "C", 10), ("NOTE", "C", 6)]


def table(tmp_path, rows, deleted=()):
    shp = write_shapefile(tmp_path / "t.shp", FIELDS, [(r, [square(0, 0)]) for r in rows])
    path = shp.with_suffix(".dbf")
    raw = bytearray(path.read_bytes())
    raw[32 + 32 + 17] = 2  # SIZE has two decimals
    header, width = struct.unpack("<HH", raw[8:12])
    for k in deleted:
        raw[header + k * width] = ord("*")
    path.write_bytes(bytes(raw))
    return path


ROWS = [(7120225080 + k, f"{k * 0.25:.2f}", f"näme {k}"[:9], "x" if k % 3 else "") for k in range(60)] + [("*" * 18, "", "", ""), ("12.000", "abc", " in ", "é"), ("-5", "-1e3", "\0", "+"), ("", "+.5", "日本", "")]


def test_columns_match_the_records(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(D, "BLOCK", 500)
    path = table(tmp_path, ROWS, deleted=(3, 59))
    whole = D.read_dbf(spark, path)
    assert dict(whole.dtypes) == {"oid": "bigint", "ID": "bigint", "SIZE": "double", "NAME": "string", "NOTE": "string"}
    want = {r["oid"]: r["properties"] for r in read_shapes(spark, path.with_suffix(".shp")).collect()}
    got = {r["oid"]: r for r in whole.collect()}
    assert set(got) == set(want) and len(got) == len(ROWS) - 2
    for oid, r in got.items():
        p = want[oid]
        assert (r["NAME"], r["NOTE"]) == (p["NAME"], p["NOTE"])
    assert got[10]["ID"] == 7120225090 and got[10]["SIZE"] == 2.5
    assert [(got[k]["ID"], got[k]["SIZE"]) for k in (60, 61, 62, 63)] == [(None, None), (12, None), (-5, -1000.0), (None, 0.5)]


def test_only_wanted_columns_are_decoded(spark, tmp_path, monkeypatch):
    path = table(tmp_path, ROWS)
    got = D.read_dbf(spark, path, "NAME string, oid long, ID string")
    assert got.columns == ["NAME", "oid", "ID"] and got.filter("oid = 61").first()["ID"] == "12.000"
    for wrong in ("OTHER string", "ID date", "oid string"):
        with pytest.raises(Exception, match="no column|can be read"):
            D.read_dbf(spark, path, wrong).collect()


def test_filters_are_applied_in_the_source(spark, tmp_path):
    path = table(tmp_path, ROWS, deleted=(21,))
    plain = D.read_dbf(spark, path).filter((F.col("ID") > 7120225090) & (F.col("ID") <= 7120225110) & (F.col("NOTE") == "x") & F.col("NAME").like("n%")).select("oid", "SIZE").collect()
    spark.conf.set(D.PUSHING, "true")
    try:
        rows = D.read_dbf(spark, path).filter((F.col("ID") > 7120225090) & (F.col("ID") <= 7120225110) & (F.col("NOTE") == "x") & F.col("NAME").like("n%")).select("oid", "SIZE")
        assert sorted(rows.collect()) == sorted(plain) and plain
        plan = rows._jdf.queryExecution().executedPlan().toString()
        left = "".join(line for line in plan.splitlines() if " Filter " in line)
        assert "StartsWith" in left and "ID" not in left
    finally:
        spark.conf.unset(D.PUSHING)


def test_many_tasks_and_other_encodings(spark, tmp_path, monkeypatch):
    path = table(tmp_path, [(k, "1.00", "a", "b") for k in range(50)])
    path.with_suffix(".cpg").write_text("cp1252")
    raw = path.read_bytes().replace(b"a  ", b"\xe4  ", 1)
    path.write_bytes(raw)
    monkeypatch.setattr(D, "SPLIT", 300)
    reader = D.TableSource({"path": str(path)}).reader(D.TableSource({"path": str(path)}).schema())
    parts = reader.partitions()
    batches = [b for p in parts for b in reader.read(p)]
    assert len(parts) > 5 and sum(b.num_rows for b in batches) == 50
    assert batches[0].column("NAME")[0].as_py() == "ä" and [v for b in batches for v in b.column("oid").to_pylist()] == list(range(50))
