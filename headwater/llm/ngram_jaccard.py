"""N-gram Jaccard join: which documents share at least ``numerator / denominator`` of their word shingles.

The product of the document by n-gram incidence matrix with its transpose is taken in blocks:

1. one pass counts shingles of all documents in a count sketch of bounded size; a second pass gives every
   document a 128-bit set key and its rarest shingles (the prefix that two similar sets cannot both miss);
2. documents with equal sets are one row of the matrix from here on (``groupBy`` on the key), with a number of its own;
3. rows that share a prefix shingle within a class of set sizes are candidates. Pairs are listed where few rows
   share one, and dropped when the histograms of their shingles already differ by more than a link allows;
   where many do, each row is tied to the first. The components of what remains are the blocks of the product,
   as no link leaves them;
4. blocks are cut into panels of bounded size, ordered by set size. Panel pairs whose sizes rule out a link
   are never made. Each other pair is multiplied tile by tile, a slab of n-gram columns at a time, rare columns first
   (sparse where few rows share them, dense where many do); after each slab, pairs
   that can't reach the overlap that their sizes demand are discarded;
5. a panel pair returns, per row, its number of links, and a spanning forest of them instead of all pairs.
   Links are counted whole; their components are found by star contraction.

Marks and blocks are dealt out by ranges of (mark, row) and (block, size, row), so a mark or a block of any size is spread over
tasks; runs that a range border cuts are tied together afterwards. Sketch counts only order shingles, so their errors cost time
and never a link. No cap is set on blocks or partners.

Null or wordless texts have the empty set and link with nothing; repeated rows are ordinary copies. Rows are told apart by a
number of their own, so an id may be null or stand for several texts; a component of null ids only has the id null. Other columns
are left out, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import NON_SPACE, mix, shingles_of, slices, text_buffers, words_of
from .components import connected_components
from .scratch import broadcast_if_small, discard, materialize

#: The sketch has four cells a document, within these powers of two (64 MB at most).
SKETCH_BITS, SKETCH_SLICES = (18, 24), 64
TILE_DOCS, TILE_SHINGLES, SLAB_COLUMNS = 512, 400_000, 4096
#: Tiles of a panel, the unit that is shuffled: a row goes out once for every panel pair of its block.
PANEL_TILES = 4
LISTED = 16
#: Kinds of candidate edges.
TIED, PAIRED, END = 0, 1, 2
#: A slab is multiplied as sparse rows if that takes this many times fewer steps than the dense product: a million steps at most for two tiles.
SPARSE = 1024
SALTS = 16
_SET = ("k1", "k2", "n_shingles")


def size_class(n: int, num: int, den: int) -> tuple[int, int]:
    """(class of a set size, least size of the next class): a set links within its class and the two beside it."""
    k, low = 0, 1
    while True:
        high = low * den // num
        if n <= high:
            return k, high + 1
        k, low = k + 1, high + 1


def class_table(num: int, den: int, limit: int = 1 << 40) -> np.ndarray:
    """Least set size of each class."""
    lows = [1]
    while lows[-1] < limit:
        lows.append(lows[-1] * den // num + 1)
    return np.array(lows, np.int64)


def least_overlap(a, b, num: int, den: int):
    """Smallest intersection of sets of a and b shingles that makes a link."""
    return -(-num * (a + b) // (num + den))


def _rows(batch: pa.RecordBatch, width: int):
    """(slice of the batch, shingle sets of its rows), a bounded number of bytes at a time."""
    raw, offsets = text_buffers(batch.column("text"))
    for first, last in slices(offsets):
        at = offsets[first : last + 1]
        _, _, hashed, bounds = words_of(raw[at[0] : at[-1]], at - at[0], NON_SPACE)
        yield batch.slice(first, last - first), [shingles_of(hashed[bounds[i] : bounds[i + 1]], width) for i in range(last - first)]


def _cell(shingles: np.ndarray, bits: int) -> np.ndarray:
    return (shingles >> np.uint64(64 - bits)).astype(np.int64)


def _sketch(docs: DataFrame, width: int, bits: int) -> np.ndarray:
    """Shingle counts of all documents, hashed into a table of 2**bits cells (32 bits each; larger counts stay at the limit)."""
    cells, limit = 1 << bits, np.iinfo(np.uint32).max

    def count(batches):
        total, seen = np.zeros(cells, np.int64), False
        for batch in batches:
            for _, sets in _rows(batch, width):
                seen = True
                total += np.bincount(_cell(np.concatenate(sets), bits), minlength=cells)
        if seen:
            for k, part in enumerate(np.split(np.minimum(total, limit).astype(np.uint32), SKETCH_SLICES)):
                yield pa.RecordBatch.from_pydict({"slice": pa.array([k], pa.int32()), "cells": pa.array([part.tobytes()], pa.binary())})

    def add(parts: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x, np.uint32).astype(np.int64) for x in parts["cells"])
        return pd.DataFrame({"slice": [parts["slice"].iloc[0]], "cells": [np.minimum(total, limit).astype(np.uint32).tobytes()]})

    schema = "slice int, cells binary"
    parts = docs.select("text").mapInArrow(count, schema).withColumn("salt", F.spark_partition_id() % 64)
    some = parts.groupBy("slice", "salt").applyInPandas(lambda p: add(p[["slice", "cells"]]), schema)
    rows = some.groupBy("slice").applyInPandas(add, schema).collect()
    out = np.zeros((SKETCH_SLICES, cells // SKETCH_SLICES), np.uint32)
    for r in rows:
        out[r["slice"]] = np.frombuffer(r["cells"], np.uint32)
    return out.ravel()


def _profiles(docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """``docs`` with (n_shingles, k1, k2, marks, outline): set size, set key, and (shingle, size class) marks to block by."""
    low, high = SKETCH_BITS
    bits = min(max(low, docs.count().bit_length() + 2), high)
    counts = docs.sparkSession.sparkContext.broadcast(_sketch(docs, width, bits))
    lows = class_table(num, den)

    def profile(batches):
        frequency = counts.value
        for rows, sets in (part for batch in batches for part in _rows(batch, width)):
            size = np.array([len(s) for s in sets], np.int64)
            k1, k2, marks, outlines = [], [], [], []
            for s in sets:
                n = len(s)
                first, second = set_key(s)
                k1.append(first)
                k2.append(second)
                outlines.append(outline(s))
                own = n - -(-num * n // den) + 1
                level = int(np.searchsorted(lows, n, "right")) - 1
                if n == 0:
                    marks.append(np.zeros(0, np.int64))
                    continue
                rare = s[np.lexsort((s, frequency[_cell(s, bits)]))[:own]]
                wider = n - least_overlap(n, int(lows[level + 1]), num, den) + 1
                marks.append(np.concatenate([mix(rare + np.uint64(level)), mix(rare[: max(0, wider)] + np.uint64(level + 1))]).view(np.int64))
            lengths = np.array([0, *map(len, marks)]).cumsum()
            more = [pa.array(size), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), pa.array(np.concatenate(marks))), pa.array(outlines, pa.binary())]
            yield pa.RecordBatch.from_arrays([*rows.columns, *more], [*rows.schema.names, "n_shingles", "k1", "k2", "marks", "outline"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(profile, f"{kept}, n_shingles long, k1 long, k2 long, marks array<long>, outline binary")


def set_key(shingles: np.ndarray) -> tuple[int, int]:
    """Two 64-bit numbers that stand for a set of shingles."""
    first = mix(shingles).sum(dtype=np.uint64) + np.uint64(len(shingles))
    second = np.bitwise_xor.reduce(mix(shingles ^ np.uint64(0x5851F42D4C957F2D))) if len(shingles) else np.uint64(0)
    return tuple(np.array([first, second], np.uint64).view(np.int64).tolist())


def outline(shingles: np.ndarray) -> bytes:
    """Histogram (modulo 256) of a set's hashes over a power of two of cells, about four shingles a cell."""
    bits = max(3, int(len(shingles) // 4).bit_length())
    return np.bincount((mix(shingles) >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits).astype(np.uint8).tobytes()


def least_difference(a: bytes, b: bytes) -> int:
    """A lower bound of the symmetric difference of two sets by their outlines."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) > len(y):
        x = x[::2] + x[1::2]
    while len(y) > len(x):
        y = y[::2] + y[1::2]
    return int(np.minimum(x - y, y - x).sum(dtype=np.int64))


def _plausible(pairs: DataFrame, num: int, den: int) -> DataFrame:
    """Listed pairs (head, rep, sizes and outlines) that may still link."""

    def test(batches):
        for batch in batches:
            a, b = batch.column("n_head").to_numpy(), batch.column("n_rep").to_numpy()
            most = a + b - 2 * least_overlap(a, b, num, den)
            keep = [p.as_py() is not None and least_difference(p.as_py(), q.as_py()) <= m for p, q, m in zip(batch.column("o_head"), batch.column("o_rep"), most, strict=True)]
            yield batch.select(["head", "rep"]).filter(pa.array(keep, pa.bool_()))

    return pairs.mapInArrow(test, "head long, rep long")


def marked_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (kind, mark, head, rep) of rows (mark, rep) that come sorted: TIED, PAIRED, or an END that names a run which may go on elsewhere.

    Runs of one row are passed over by whole arrays; no more than LISTED rows of a run are held.
    """
    held, first, count, opening = None, 0, 0, True  # the run at hand: its mark, first row, length; may it have begun elsewhere?
    members: list[int] = []
    out: list[tuple[int, int, int, int]] = []

    def add(rep: int) -> None:
        nonlocal count
        count += 1
        if opening or count > LISTED + 1:
            if count == LISTED + 2 and not opening:
                out.extend((TIED, held, first, m) for m in members if m != first)
                members.clear()
            if rep != first:
                out.append((TIED, held, first, rep))
        else:
            members.append(rep)

    def close(last: bool = False) -> None:
        nonlocal opening
        if held is None:
            return
        if opening or last:
            out.extend((TIED, held, first, m) for m in members if m != first)
            out.append((END, held, first, first))
        else:
            out.extend((PAIRED, held, a, b) for k, b in enumerate(members) for a in members[:k])
        members.clear()
        opening = False

    def table():
        columns = np.array(out, np.int64).reshape(-1, 4).T
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(columns[0].astype(np.int32)), *(pa.array(c) for c in columns[1:])], ["kind", "mark", "head", "rep"])

    for batch in batches:
        mark, rep = (batch.column(c).to_numpy() for c in ("mark", "rep"))
        if not len(mark):
            continue
        start = np.flatnonzero(np.r_[True, mark[1:] != mark[:-1]])
        size = np.diff(np.r_[start, len(mark)])
        wanted = size > 1
        wanted[0] = wanted[-1] = True
        for a, n in zip(start[wanted].tolist(), size[wanted].tolist(), strict=True):
            if mark[a] != held:
                close()
                held, first, count = int(mark[a]), int(rep[a]), 0
            for r in rep[a : a + n].tolist():
                add(r)
        if out:
            yield table()
    close(last=True)
    if out:
        yield table()


def _candidates(sets: DataFrame, num: int, den: int) -> DataFrame:
    marks = sets.select(F.explode("marks").alias("mark"), "rep").repartitionByRange("mark", "rep").sortWithinPartitions("mark", "rep")
    found = materialize(marks.mapInArrow(marked_edges, "kind int, mark long, head long, rep long"), "edges")
    # parts of a run in several ranges: two at most a range, tied to the first of them
    ends = found.filter(F.col("kind") == END)
    whole = ends.groupBy("mark").agg(F.min("rep").alias("head"))
    across = ends.select("mark", "rep").join(whole, "mark").filter("head <> rep").select("head", "rep")
    tied = found.filter(F.col("kind") == TIED).select("head", "rep").union(across)
    listed = found.filter(F.col("kind") == PAIRED).select("head", "rep").distinct()
    side = lambda name: sets.select(F.col("rep").alias(name), F.col("n_shingles").alias(f"n_{name}"), F.col("outline").alias(f"o_{name}"))
    near = listed.join(side("head"), "head").join(side("rep"), "rep").filter(F.col("n_head") * den >= F.col("n_rep") * num).filter(F.col("n_rep") * den >= F.col("n_head") * num)
    candidates = materialize(_plausible(near, num, den).union(tied).distinct(), "candidates")
    discard(found)
    return candidates


def _tiles(sizes: np.ndarray, docs: int, shingles: int) -> np.ndarray:
    """Number of the tile of each row, rows in order."""
    return ((np.arange(1, len(sizes) + 1) - 1) // docs + np.cumsum(sizes) // shingles).astype(np.int64)


def _panels(members: DataFrame) -> DataFrame:
    """``members`` (rep, copies, n_shingles, root) with ``panel``: rows in ranges of (root, size), numbered as they stream past."""

    def number(batches):
        root, panel, docs, shingles, base = None, -1, 0, 0, None
        for batch in batches:
            if base is None:
                base = int(batch.column("part")[0].as_py()) << 32 if batch.num_rows else None
            out = []
            for r, n in zip(batch.column("root").to_pylist(), batch.column("n_shingles").to_pylist(), strict=True):
                if r != root or docs >= PANEL_TILES * TILE_DOCS or shingles >= PANEL_TILES * TILE_SHINGLES:
                    root, panel, docs, shingles = r, panel + 1, 0, 0
                docs, shingles = docs + 1, shingles + n
                out.append(base + panel)
            kept = [c for c in batch.schema.names if c != "part"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(out, pa.int64())], [*kept, "panel"])

    ordered = members.repartitionByRange("root", "n_shingles", "rep").sortWithinPartitions("root", "n_shingles", "rep")
    return ordered.withColumn("part", F.spark_partition_id()).mapInArrow(number, "rep long, copies long, n_shingles long, root long, panel long")


def _shingle_rows(texts: DataFrame, width: int) -> DataFrame:
    """(rep, shingles) of rows (rep, text)."""

    def shingle(batches):
        for rows, sets in (part for batch in batches for part in _rows(batch, width)):
            lengths = np.array([0, *map(len, sets)]).cumsum()
            yield pa.RecordBatch.from_arrays([rows.column("rep"), pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), pa.array(np.concatenate(sets).view(np.int64)))], ["rep", "shingles"])

    return texts.mapInArrow(shingle, "rep long, shingles array<long>")


def _sparse_product(row: np.ndarray, column: np.ndarray, left: int, n: int, same: bool) -> np.ndarray:
    """Overlap counts of a slab's entries (sorted by column) between rows below ``left`` and the others (or all and all)."""
    b_side = np.ones(len(row), bool) if same else row >= left
    a_side = np.ones(len(row), bool) if same else ~b_side
    a_row, a_col, b_row, b_col = row[a_side], column[a_side], row[b_side] - (0 if same else left), column[b_side]
    low, high = np.searchsorted(b_col, a_col, "left"), np.searchsorted(b_col, a_col, "right")
    times = high - low
    at = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times - low, times)
    width = n if same else n - left
    return np.bincount(np.repeat(a_row, times) * width + b_row[at], minlength=(n if same else left) * width).reshape(-1, width).astype(np.float32)


def linked_pairs(left: list[np.ndarray], right: list[np.ndarray] | None, num: int, den: int) -> np.ndarray:
    """Boolean matrix of links between two tiles (or within one) by a slab-wise product of incidence matrices."""
    same = right is None
    rows = left if same else left + right
    n, owner = len(rows), np.repeat(np.arange(len(rows)), [len(s) for s in rows])
    size = np.array([len(s) for s in rows], np.int64)
    column = np.concatenate(rows)
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    fresh = np.r_[True, column[1:] != column[:-1]]
    ident = np.cumsum(fresh) - 1
    shared = np.bincount(ident)[ident] > 1
    owner, ident = owner[shared], ident[shared]
    if len(ident):
        # columns of fewer rows first: they tell rows apart, so pairs without a chance fall early
        ident = np.cumsum(np.r_[0, ident[1:] != ident[:-1]])
        by_use = np.argsort(np.argsort(np.bincount(ident), kind="stable"), kind="stable")[ident]
        order = np.argsort(by_use, kind="stable")
        owner, ident = owner[order], by_use[order]
    a = np.arange(n) if same else np.arange(len(left))
    b = a if same else np.arange(len(left), n)
    need = least_overlap(size[a][:, None], size[b][None, :], num, den)
    overlap = np.zeros((len(a), len(b)), np.float32)
    rest = np.bincount(owner, minlength=n)
    alive_a, alive_b = np.arange(len(a)), np.arange(len(b))
    width = int(ident[-1]) + 1 if len(ident) else 0
    for low in range(0, width, SLAB_COLUMNS):
        if not len(alive_a) or not len(alive_b):
            break
        i, j = np.searchsorted(ident, [low, low + SLAB_COLUMNS])
        columns = min(SLAB_COLUMNS, width - low)
        steps = int((np.bincount(ident[i:j] - low) ** 2).sum())
        if steps * SPARSE < len(alive_a) * len(alive_b) * columns:
            overlap += _sparse_product(owner[i:j], ident[i:j], len(left), n, same)
        else:
            slab = np.zeros((n, columns), np.float32)
            slab[owner[i:j], ident[i:j] - low] = 1
            overlap[np.ix_(alive_a, alive_b)] += slab[a[alive_a]] @ slab[b[alive_b]].T
        rest -= np.bincount(owner[i:j], minlength=n)
        possible = overlap + np.minimum(rest[a][:, None], rest[b][None, :]) >= need
        alive_a, alive_b = np.flatnonzero(possible.any(1)), np.flatnonzero(possible.any(0))
    links = (overlap >= need) & (size[a] > 0)[:, None]
    if same:
        np.fill_diagonal(links, False)
    return links


def spanning_forest(links: np.ndarray) -> list[tuple[int, int]]:
    """Edges (row, column) of a forest with the same components as a bipartite boolean matrix."""
    rows_left, cols_left, edges = set(range(links.shape[0])), np.ones(links.shape[1], bool), []
    while rows_left:
        stack = [rows_left.pop()]
        while stack:
            r = stack.pop()
            for c in np.flatnonzero(links[r] & cols_left):
                edges.append((r, int(c)))
                cols_left[c] = False
                for other in np.flatnonzero(links[:, c]):
                    if int(other) in rows_left:
                        rows_left.discard(int(other))
                        edges.append((int(other), int(c)))
                        stack.append(int(other))
    return edges


def _panel_links(num: int, den: int):
    """Links of a panel pair, tile by tile: (rep, rep, links) rows, and forest edges with 0 links."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["panel", "n_shingles", "rep"])
        i, j = int(part["i"].iloc[0]), int(part["j"].iloc[0])
        sides = []
        for panel in (i, j):
            rows = part[part["panel"] == panel]
            sides.append([g for _, g in rows.groupby(_tiles(rows["n_shingles"].to_numpy(), TILE_DOCS, TILE_SHINGLES), sort=True)])
        out: list[tuple[int, int, int]] = []
        for x, lo in enumerate(sides[0]):
            for y, hi in enumerate(sides[1]):
                smaller, larger = (lo, hi) if lo["n_shingles"].iloc[0] <= hi["n_shingles"].iloc[0] else (hi, lo)
                if (i == j and y < x) or larger["n_shingles"].iloc[0] * num > smaller["n_shingles"].iloc[-1] * den:
                    continue
                out += tile_links(lo, None if i == j and x == y else hi, num, den)
        return pd.DataFrame(out, columns=["a", "b", "links"]).astype("int64")

    return run


def tile_links(lo: pd.DataFrame, hi: pd.DataFrame | None, num: int, den: int) -> list[tuple[int, int, int]]:
    sets = lambda p: [np.asarray(s, np.int64) for s in p["shingles"]]
    links = linked_pairs(sets(lo), None if hi is None else sets(hi), num, den)
    other = lo if hi is None else hi
    found = [(lo["rep"], (links * other["copies"].to_numpy()).sum(1))]
    if hi is not None:
        found.append((hi["rep"], (links.T * lo["copies"].to_numpy()).sum(1)))
    out = [(int(a), int(a), int(c)) for names, counts in found for a, c in zip(names.to_numpy(), counts, strict=True) if c]
    return out + [(int(lo["rep"].iloc[r]), int(other["rep"].iloc[c]), 0) for r, c in spanning_forest(links)]


def _classified(docs: DataFrame, width: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """Profiles of all rows, each with a number ``row``, and (k1, k2, n_shingles, root, component_id, n_links, first_row) of every set that is not empty.

    ``root`` numbers the component; ``first_row`` is one of its rows with the smallest id.
    """
    numbered = docs.withColumn("row", F.monotonically_increasing_id())  # fixed once the profiles are written
    profiles = materialize(_profiles(numbered, width, num, den), "profiles")
    grouped = profiles.filter("n_shingles > 0").groupBy(*_SET).agg(
        F.min("doc_id").alias("least"), F.count("*").alias("copies"), F.min("row").alias("any_row"), F.coalesce(F.min_by("row", "doc_id"), F.min("row")).alias("least_row"),
        F.first("marks").alias("marks"), F.first("outline").alias("outline"),
    )
    sets = materialize(grouped.withColumn("rep", F.monotonically_increasing_id()), "sets")
    candidates = _candidates(sets, num, den)
    blocks = materialize(connected_components(candidates, "head", "rep"), "blocks")
    members = materialize(_panels(sets.join(blocks.withColumnRenamed("node", "rep"), "rep").select("rep", "copies", "n_shingles", "root")), "members")
    discard(candidates)
    discard(blocks)
    panels = members.groupBy("root", "panel").agg(F.min("n_shingles").alias("low"), F.max("n_shingles").alias("high"))
    later = panels.select("root", F.col("panel").alias("j"), F.col("low").alias("later_low"))
    pairs = panels.join(later, "root").filter((F.col("j") >= F.col("panel")) & (F.col("later_low") * num <= F.col("high") * den)).select("root", F.col("panel").alias("i"), "j")
    ends = pairs.select("root", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("panel"))
    wanted = materialize(sets.select("rep", F.col("any_row").alias("row")).join(members.select("rep"), "rep", "left_semi"), "wanted")
    rows = _shingle_rows(profiles.select("row", "text").join(broadcast_if_small(wanted), "row").select("rep", "text"), width).join(members, "rep")
    products = rows.join(ends, ["root", "panel"]).groupBy("root", "i", "j").applyInPandas(_panel_links(num, den), "a long, b long, links long")
    found = materialize(products, "links")

    roots = connected_components(found.filter("a <> b"), "a", "b").withColumnRenamed("node", "rep")
    counts = found.filter("links > 0").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("other_links"))
    own = sets.select(*_SET, "rep", "least", "least_row", "copies")
    # sets with links get their component's smallest id; a component of any size is joined in SALTS parts
    linked = own.select("rep", "least", "least_row").join(roots, "rep").withColumn("salt", F.pmod(F.xxhash64("rep"), F.lit(SALTS)))
    smallest = linked.groupBy("root").agg(F.min("least").alias("component_id"), F.coalesce(F.min_by("least_row", "least"), F.min("least_row")).alias("first_row"))
    salted = smallest.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumn("salt", F.col("salt").cast("long"))
    named = linked.select("rep", "root", "salt").join(salted, ["root", "salt"]).select("rep", "root", "component_id", "first_row")
    classes = own.join(named, "rep", "left").join(counts, "rep", "left").select(
        *_SET, F.coalesce("root", "rep").alias("root"), F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"),
        F.coalesce("first_row", "least_row").alias("first_row"), (F.col("copies") - 1 + F.coalesce("other_links", F.lit(0))).alias("n_links"),
    )
    return profiles, classes


def ngram_jaccard(docs: DataFrame, width: int = 5, numerator: int = 80, denominator: int = 100, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) of every row of ``docs``.

    ``component_id`` is the smallest id reachable by links, the row's own included; ``n_links`` counts the
    other rows linked with it directly. Two rows link when ``denominator * |intersection| >= numerator *
    |union|`` of their sets of ``width``-word shingles.
    """
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    profiles, classes = _classified(docs, width, numerator, denominator)
    linked = profiles.select("doc_id", *_SET).join(classes, list(_SET), "left")
    return linked.select("doc_id", "n_shingles", F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def drop_near_duplicates(docs: DataFrame, width: int = 5, numerator: int = 80, denominator: int = 100) -> DataFrame:
    """Rows of ``docs`` (with all their columns): one row with the smallest id of each component, and every row without words.

    A row goes only because a row of its own component stays, whether or not ids repeat or are null (null ids come last).
    """
    names = {c: f"kept_{k}" for k, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    given = dict(docs.dtypes)["doc_id"]
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"), *[F.col(c).alias(n) for c, n in names.items()])
    profiles, classes = _classified(docs, width, numerator, denominator)
    first = materialize(classes.select(F.col("first_row").alias("row")).distinct(), "first")
    stay = profiles.filter("n_shingles > 0").join(broadcast_if_small(first), "row", "left_semi").unionByName(profiles.filter("n_shingles = 0"))
    return stay.select(F.col("doc_id").cast(given).alias("doc_id"), "text", *[F.col(n).alias(c) for c, n in names.items()])
