"""Writes small polygon shapefiles for tests."""

import struct
from pathlib import Path

WGS84 = 'GEOGCS["GCS_WGS_1984",DATUM["D_WGS_1984",SPHEROID["WGS_1984",6378137,298.257223563]],PRIMEM["Greenwich",0],UNIT["Degree",0.017453292519943295]]'
MERCATOR = 'PROJCS["WGS_1984_Web_Mercator_Auxiliary_Sphere",GEOGCS["GCS_WGS_1984",DATUM["D_WGS_1984",SPHEROID["WGS_1984",6378137,298.257223563]],PRIMEM["Greenwich",0],UNIT["Degree",0.0174532925199433]],PROJECTION["Mercator_Auxiliary_Sphere"],UNIT["Meter",1]]'


def square(x, y, size=1):
    """A closed clockwise ring."""
    return [(x, y), (x, y + size), (x + size, y + size), (x + size, y), (x, y)]


def write_shapefile(path, fields, rows, prj=WGS84):
    """``fields``: (name, type, width); ``rows``: (values, rings)."""
    path = Path(path)
    records, index, at = b"", b"", 50
    for k, (_, rings) in enumerate(rows):
        points = [p for r in rings for p in r]
        box = (min(p[0] for p in points), min(p[1] for p in points), max(p[0] for p in points), max(p[1] for p in points)) if points else (0, 0, 0, 0)
        starts, n = [], 0
        for r in rings:
            starts.append(n)
            n += len(r)
        body = struct.pack("<i4d2i", 5, *box, len(rings), n) + struct.pack(f"<{len(starts)}i", *starts) + b"".join(struct.pack("<2d", *p) for p in points)
        words = len(body) // 2
        records += struct.pack(">2i", k + 1, words) + body
        index += struct.pack(">2i", at, words)
        at += 4 + words
    head = lambda size: struct.pack(">7i", 9994, 0, 0, 0, 0, 0, size) + struct.pack("<2i", 1000, 5) + struct.pack("<8d", *[0.0] * 8)
    path.with_suffix(".shp").write_bytes(head(at) + records)
    path.with_suffix(".shx").write_bytes(head(50 + 4 * len(rows)) + index)
    width = 1 + sum(w for _, _, w in fields)
    dbf = struct.pack("<4BIHH20x", 3, 26, 1, 1, len(rows), 33 + 32 * len(fields), width)
    dbf += b"".join(name.encode().ljust(11, b"\0") + kind.encode() + b"\0" * 4 + bytes([w, 0]) + b"\0" * 14 for name, kind, w in fields) + b"\r"
    for values, _ in rows:
        dbf += b" " + b"".join((str(v).rjust(w) if kind == "N" else str(v).ljust(w)).encode()[:w] for v, (_, kind, w) in zip(values, fields, strict=True))
    path.with_suffix(".dbf").write_bytes(dbf + b"\x1a")
    if prj:
        path.with_suffix(".prj").write_text(prj)
    return path.with_suffix(".shp")


UNIT_FIELDS = [("HYBAS_ID", "N", 12), ("NEXT_DOWN", "N", 12), ("ENDO", "N", 3)]


def write_units(path, rows, prj=WGS84):
    """``rows``: (unit, down, endo, x, y)."""
    return write_shapefile(path, UNIT_FIELDS, [((u, d, e), [square(x, y)]) for u, d, e, x, y in rows], prj)
