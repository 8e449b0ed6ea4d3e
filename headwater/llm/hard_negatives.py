"""Hard-negative mining: for every anchor its closest rows of the same label, and below each of them the closest rows of other labels.

A score is the integer inner product of an anchor and a row, whose components are ``floor(scale * x)``. Pair scores are packed into keys of
(anchor, descending score, id) and sorted by one secondary-sort shuffle (repartition by anchor, sorted within partitions); an iterator then
streams through each partition: an anchor's positives open windows of scores as they come, and rows of other labels that fall into
open windows are put out. No anchor's pairs are ever held: the state is the anchor's few open windows.

Only pairs that can be put out are shuffled. Anchors go out in blocks of ELEMENTS components and ANCHORS rows at most; a task multiplies a
block with its rows, a tile at a time, and keeps per anchor the best positives and, once those of all tasks are known, the best rows of each of
their windows. A block is one broadcast, released before the next; rows are read where they lie and never shuffled. The work is that of
the pairs asked for (anchors times rows); what is shuffled is ``n_positives * (1 + n_negatives)`` pairs an anchor and task at most.

Defined results: rows with a null label, a null vector, or a null or non-finite component take no part. Ties go to the smaller id, null ids (and
2**63 - 1) last, repeated ids by their place in the table. Every row counts, so a repeated row is a row of its own, an anchor's copy among its
positives. Shorter vectors are filled up with zeros. Components are cut to 64 bits, and scores that need more wrap around.
Positives with a negative score have no window (half of it would be above it). Other columns are left out, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import appended, discard, materialize

#: Components and rows of a block of anchors (32 MB; its running results some 30 MB a task), and the rows of both sides of a tile.
ELEMENTS, ANCHORS, TILE_ANCHORS, TILE_ROWS = 1 << 22, 1 << 16, 512, 4096
_NO_ID = np.iinfo(np.int64).max
_LEAST = -np.iinfo(np.int64).max
_FOUND = "anchor long, score long, kind int, vec_id long, row long"


def quantised(vector: Column | str, scale: int = 256) -> Column:
    """``floor(scale * x)`` of all components; null for vectors that are null or have a null or non-finite component."""
    vector = F.col(vector) if isinstance(vector, str) else vector
    number = lambda x: x.cast("double")
    finite = F.forall(vector, lambda x: F.coalesce(~F.isnan(number(x)) & (F.abs(number(x)) < float("inf")), F.lit(False)))
    return F.when(finite, F.transform(vector, lambda x: F.floor(number(x) * scale).cast("long")))


@dataclass
class Block:
    """Rows as arrays, in order of their ids."""

    row: np.ndarray
    vec_id: np.ndarray
    label: np.ndarray
    vectors: np.ndarray

    @classmethod
    def of(cls, batch, width: int) -> Block:
        lists = batch.column("q")
        lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
        sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
        vectors = np.zeros((len(sizes), width), np.int64)
        vectors[np.arange(width) < sizes[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
        row, label = (np.asarray(batch.column(c)) for c in ("row", "label"))
        vec_id = np.asarray(batch.column("vec_id").fill_null(_NO_ID))
        order = np.lexsort((row, vec_id))
        return cls(row[order], vec_id[order], label[order], vectors[order])

    def part(self, a: int, b: int) -> Block:
        return Block(self.row[a:b], self.vec_id[a:b], self.label[a:b], self.vectors[a:b])


def _size(x: np.ndarray) -> int:
    return max(int(x.max()), -int(x.min())) if x.size else 0


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows: by floating point where that is exact (below 2**53), else in 64-bit integers."""
    if _size(a) * _size(b) * max(a.shape[1], 1) < 1 << 53:
        return a.astype(np.float64) @ b.astype(np.float64).T
    return a @ b.T


class Best:
    """For each of ``n`` anchors the ``k`` best (score, id, row) so far."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score, self.vec_id, self.row = np.full((n, k), _LEAST), np.full((n, k), _NO_ID), np.full((n, k), -1)

    def add(self, first: int, score: np.ndarray, rows: Block) -> None:
        """Take what is above the least score of a tile that begins at anchor ``first``; ``score`` is used up. Columns come in order of ids."""
        least = _LEAST if score.dtype == np.int64 else -np.inf
        at = np.arange(len(score))
        span = slice(first, first + len(score))
        for _ in range(self.k):
            place = score.argmax(1)  # the first of equal ones
            top = score[at, place]
            hit = np.flatnonzero((top > least) & (top >= self.score[span, -1]))
            if not len(hit):
                return
            score[at, place] = least
            own, place, top = first + hit, place[hit], top[hit].astype(np.int64)
            joined = [np.column_stack([x[own], new]) for x, new in ((self.score, top), (self.vec_id, rows.vec_id[place]), (self.row, rows.row[place]))]
            order = np.lexsort((joined[2], joined[1], -joined[0]), axis=-1)[:, : self.k]
            for x, new in zip((self.score, self.vec_id, self.row), joined, strict=True):
                x[own] = np.take_along_axis(new, order, 1)

    def table(self, anchors: np.ndarray, kind: int) -> tuple[np.ndarray, ...]:
        own, k = np.nonzero(self.row >= 0)
        return anchors[own], self.score[own, k], np.full(len(own), kind, np.int32), self.vec_id[own, k], self.row[own, k]


def _batch(columns) -> pa.RecordBatch:
    anchor, score, kind, vec_id, row = columns
    return pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(score), pa.array(kind), pa.array(vec_id, mask=vec_id == _NO_ID), pa.array(row)], ["anchor", "score", "kind", "vec_id", "row"])


def _tiles(batches, anchors: Block) -> Iterator[tuple[int, Block, Block, np.ndarray]]:
    """(first anchor, anchors, rows, scores) of every tile of a block of anchors and a task's rows."""
    for batch in batches:
        for a in range(0, batch.num_rows, TILE_ROWS):
            rows = Block.of(batch.slice(a, TILE_ROWS), anchors.vectors.shape[1])
            for first in range(0, len(anchors.row), TILE_ANCHORS):
                some = anchors.part(first, first + TILE_ANCHORS)
                yield first, some, rows, scores(some.vectors, rows.vectors)


def _without(score: np.ndarray, keep: np.ndarray) -> np.ndarray:
    return np.where(keep, score, _LEAST if score.dtype == np.int64 else -np.inf)


def windows(score: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest score s with ``low * p <= 100 * s <= high * p`` for each positive's score p."""
    p = [int(x) for x in score.ravel()]
    bounds = np.array([(-(-low * x // 100), high * x // 100) for x in p], np.int64).reshape(*score.shape, 2)
    return bounds[..., 0], bounds[..., 1]


def _closest(rows: DataFrame, shared, k: int) -> DataFrame:
    """Of each task the ``k`` best rows of every anchor's own label."""

    def run(batches):
        anchors = shared.value
        best = Best(len(anchors.row), k)
        for first, some, rows, score in _tiles(batches, anchors):
            best.add(first, _without(score, (some.label[:, None] == rows.label) & (some.row[:, None] != rows.row)), rows)
        yield _batch(best.table(anchors.row, 0))

    return rows.mapInArrow(run, _FOUND)


def _below(rows: DataFrame, shared, k: int) -> DataFrame:
    """Of each task the ``k`` best rows of other labels in every window of every anchor."""

    def run(batches):
        anchors, low, high = shared.value
        found = [Best(len(anchors.row), k) for _ in range(low.shape[1])]
        for first, some, rows, score in _tiles(batches, anchors):
            others = _without(score, some.label[:, None] != rows.label)
            for n, best in enumerate(found):
                a, b = (x[first : first + len(some.row), n, None] for x in (low, high))
                inside = (others >= a) & (others <= b)
                if inside.any():
                    best.add(first, _without(others, inside), rows)
        every = [np.concatenate(c) for c in zip(*(best.table(anchors.row, 1) for best in found), strict=True)]
        _, once = np.unique(np.column_stack([every[0], every[4]]), axis=0, return_index=True)
        yield _batch([c[once] for c in every])

    return rows.mapInArrow(run, _FOUND)


def _sorted_pairs(pairs: DataFrame) -> DataFrame:
    """The secondary sort: an anchor's pairs in one partition, best score first, a positive before others of its score."""
    return pairs.repartition("anchor").sortWithinPartitions("anchor", F.desc("score"), "kind", F.asc_nulls_last("vec_id"), "row")


def _first(pairs: DataFrame, k: int) -> DataFrame:
    """The first ``k`` pairs of every anchor."""

    def run(batches):
        current, seen = None, 0
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, anchor in enumerate(batch.column("anchor").to_pylist()):
                current, seen = (current, seen + 1) if anchor == current else (anchor, 1)
                keep[i] = seen <= k
            yield batch.filter(pa.array(keep))

    return _sorted_pairs(pairs).mapInArrow(run, _FOUND)


def mined(rows: Iterator[tuple], n_negatives: int, low: int, high: int) -> Iterator[tuple]:
    """(anchor, positive id, positive place, rank, negative id, positive score, negative score) of a stream of sorted pairs (anchor, score, kind, id, row)."""
    current, place, open_ = None, 0, []
    for anchor, score, kind, vec_id, _ in rows:
        if anchor != current:
            current, place, open_ = anchor, 0, []
        if kind == 0:
            place += 1
            open_.append([vec_id, place, score, -(-low * score // 100), high * score // 100, 0])
            continue
        open_ = [w for w in open_ if w[3] <= score and w[5] < n_negatives]  # scores only fall
        for w in open_:
            if score <= w[4]:
                w[5] += 1
                yield anchor, w[0], w[1], w[5], vec_id, w[2], score


def _mine(pairs: DataFrame, n_negatives: int, low: int, high: int) -> DataFrame:
    names = ["anchor", "positive_id", "positive_rank", "rank", "negative_id", "positive_score", "negative_score"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches):
        def stream():
            for batch in batches:
                yield from zip(*(batch.column(c).to_pylist() for c in ("anchor", "score", "kind", "vec_id", "row")), strict=True)

        out = []
        for found in mined(stream(), n_negatives, low, high):
            out.append(found)
            if len(out) == TILE_ROWS:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
                out.clear()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return _sorted_pairs(pairs).mapInArrow(run, "anchor long, positive_id long, positive_rank int, rank int, negative_id long, positive_score long, negative_score long")


def mine_hard_negatives(vectors: DataFrame, anchor: Column, n_positives: int = 5, n_negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score, positive_rank) of the rows (vec_id, label, vector) that ``anchor`` holds for.

    An anchor's positives are its best ``n_positives`` other rows of its label; for each, the best ``n_negatives`` rows of other labels
    with a score from ``low`` to ``high`` hundredths of the positive's are given.
    """
    usable = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), quantised("vector", scale).alias("q"))
    numbered = usable.filter("label is not null and q is not null").withColumn("anchored", F.coalesce(anchor, F.lit(False))).withColumn("row", F.monotonically_increasing_id())
    rows = materialize(numbered, "vectors")
    size = rows.agg(F.count_if("anchored").alias("anchors"), F.max(F.size("q")).alias("width")).first()
    width = size["width"] or 0
    blocks = max(-(-size["anchors"] * max(width, 1) // ELEMENTS), -(-size["anchors"] // ANCHORS), 1)
    sides = rows.select("row", "vec_id", "label", "q")
    dealt = rows.filter("anchored").withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks))).select("row", "vec_id", "label", "q", "block")
    context, result = vectors.sparkSession.sparkContext, None
    for k in range(blocks):
        anchors = Block.of(dealt.filter(F.col("block") == k).drop("block").toArrow(), width)
        shared = context.broadcast(anchors)
        positives = materialize(_first(_closest(sides, shared, n_positives), n_positives), "positives")
        # the scores of this block's positives: so many an anchor at most
        held = positives.select("anchor", "score").toPandas().sort_values(["anchor", "score"], ascending=[True, False])
        by_row = np.argsort(anchors.row)
        own = by_row[np.searchsorted(anchors.row, held["anchor"].to_numpy(np.int64), sorter=by_row)] if len(held) else np.zeros(0, np.int64)
        bounds = np.zeros((2, len(anchors.row), n_positives), np.int64)
        bounds[0] = 1  # no window
        bounds[:, own, held.groupby("anchor").cumcount().to_numpy()] = windows(held["score"].to_numpy(np.int64), low, high)
        opened = context.broadcast((anchors, *bounds))
        pairs = positives.union(_below(sides, opened, n_negatives))
        named = anchors_of(dealt.filter(F.col("block") == k))
        found = _mine(pairs, n_negatives, low, high).join(named, "anchor")
        result = appended(result, found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score", "positive_rank"), "negatives")
        shared.destroy()
        opened.destroy()
        discard(positives)
    return result


def anchors_of(rows: DataFrame) -> DataFrame:
    """(anchor, anchor_id): the id of each anchor's row."""
    return rows.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
