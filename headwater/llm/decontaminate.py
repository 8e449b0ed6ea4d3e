"""Benchmark decontamination with an FM-index per shard of the training texts.

A shard is a slice of rows of one Arrow batch. Words outside the vocabulary of the windows of a length can't
lie in an occurrence, so a shard's index covers its runs of vocabulary words that are long enough for a
window, each ended by a separator of its own. All windows are searched backwards at once through the wavelet matrix of the
Burrows-Wheeler transform; occurrences are located by walking to sampled suffix positions; their words are
merged into removal spans.

The benchmark goes to the tasks in blocks of bounded size (``BLOCK_BYTES`` of text): one scan per block,
chained over the same rows without a shuffle, ``CHAIN`` blocks between two written tables. Null texts have no words. Repeated rows
are judged one by one, null ids like others. Item ids may be of any type that casts to a string; items without an id
hit words but can't be listed; repeated items count once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import ALNUM, slices, text_buffers, words_of
from .scratch import materialize

BLOCK_BYTES = 8 << 20
SAMPLE = 4
CHAIN = 8


class Windows:
    """Distinct windows of a block of benchmark items, by length: each length has a vocabulary (numbers from 1) of its own."""

    def __init__(self, items: list[tuple[str | None, str | None]], width: int):
        raw, offsets = text_buffers(pa.array([t for _, t in items], pa.string()))
        _, _, hashed, bounds = words_of(raw, offsets, ALNUM)
        owners: dict[int, dict[tuple[int, ...], set[str | None]]] = {}
        for (item, _), a, b in zip(items, bounds[:-1], bounds[1:], strict=True):
            span = min(width, b - a)
            for k in range(a, b - span + 1 if span else a):
                owners.setdefault(int(span), {}).setdefault(tuple(hashed[k : k + span].tolist()), set()).add(item)
        self.groups = []
        for length, by_words in sorted(owners.items()):
            vocabulary, number = np.unique(np.array(list(by_words), np.uint64), return_inverse=True)
            self.groups.append((length, vocabulary, number.reshape(-1, length) + 1, [sorted(x - {None}) for x in by_words.values()]))


class FMIndex:
    """Full-text index of a sequence of numbers: 0 ends a run, words are 1 and up."""

    def __init__(self, sequence: np.ndarray, symbols: int):
        n, ends = len(sequence), sequence == 0
        rank = np.where(ends, np.cumsum(ends) - 1, ends.sum() + sequence).astype(np.int64)
        step = 1
        while True:
            ahead = np.full(n, -1, np.int64)
            ahead[:-step] = rank[step:]
            order = np.lexsort((ahead, rank))
            change = (np.diff(rank[order]) != 0) | (np.diff(ahead[order]) != 0)
            fresh = np.empty(n, np.int64)
            fresh[order] = np.r_[0, np.cumsum(change)]
            rank, step = fresh, step * 2
            if rank[order[-1]] == n - 1 or step >= n:
                break
        suffixes = np.empty(n, np.int64)
        suffixes[rank] = np.arange(n)
        last = sequence[suffixes - 1]
        self.n = n
        self.before = np.r_[0, np.cumsum(np.bincount(sequence, minlength=symbols + 1))]
        self.known = np.where((suffixes % SAMPLE == 0) | (last == 0), suffixes, -1)
        self.bits = max(1, int(symbols).bit_length())
        self.levels: list[tuple[np.ndarray, int]] = []
        for level in range(self.bits - 1, -1, -1):
            bit = (last >> level) & 1
            self.levels.append((np.r_[0, np.cumsum(bit)].astype(np.int32), n - int(bit.sum())))
            last = np.concatenate([last[bit == 0], last[bit == 1]])

    def ranks(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each position of the transform."""
        low = np.zeros_like(at)
        for k, (ones, zeros) in enumerate(self.levels):
            bit = ((symbol >> (self.bits - 1 - k)) & 1).astype(bool)
            at = np.where(bit, zeros + ones[at], at - ones[at])
            low = np.where(bit, zeros + ones[low], low - ones[low])
        return at - low

    def symbols_at(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros_like(at)
        for ones, zeros in self.levels:
            bit = ones[at + 1] - ones[at]
            out = out * 2 + bit
            at = np.where(bit == 1, zeros + ones[at], at - ones[at])
        return out

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Half-open suffix ranges of patterns of equal length, found backwards."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        live = np.arange(len(patterns))
        for column in patterns.T[::-1]:
            c = column[live]
            low[live] = self.before[c] + self.ranks(c, low[live])
            high[live] = self.before[c] + self.ranks(c, high[live])
            live = live[low[live] < high[live]]
            if not len(live):
                break
        return low, np.maximum(high, low)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of suffix ranks, by steps towards the text's start until a sampled one."""
        out, steps, todo = np.empty(len(rows), np.int64), 0, np.arange(len(rows))
        rows = rows.copy()
        while len(todo):
            known = self.known[rows[todo]]
            out[todo[known >= 0]] = known[known >= 0] + steps
            todo = todo[known < 0]
            c = self.symbols_at(rows[todo])
            rows[todo] = self.before[c] + self.ranks(c, rows[todo])
            steps += 1
        return out


def find_windows(hashed: np.ndarray, bounds: np.ndarray, windows: Windows):
    """(word, window length, items) of every occurrence in a shard's rows."""
    for length, vocabulary, patterns, owners in windows.groups:
        number = np.searchsorted(vocabulary, hashed)
        number[number == len(vocabulary)] = 0
        number = np.where(vocabulary[number] == hashed, number + 1, 0)
        inside = number > 0
        change = np.diff(inside.astype(np.int8))
        heads = bounds[1:-1]
        heads = heads[(heads > 0) & (heads < len(hashed))]
        heads = np.unique(heads[inside[heads] & inside[heads - 1]])  # runs that meet where rows do
        starts = np.sort(np.r_[np.zeros(int(inside[:1].sum()), np.int64), np.flatnonzero(change == 1) + 1, heads])
        stops = np.sort(np.r_[np.flatnonzero(change == -1) + 1, heads, np.full(int(inside[-1:].sum()), len(hashed))]).astype(np.int64)
        keep = stops - starts >= length
        starts, stops = starts[keep], stops[keep]
        if not len(starts):
            continue
        lengths = stops - starts + 1
        at = np.repeat(starts - np.r_[0, np.cumsum(lengths)[:-1]], lengths) + np.arange(lengths.sum())
        sequence = number[np.minimum(at, len(number) - 1)]
        sequence[np.cumsum(lengths) - 1] = 0
        index = FMIndex(sequence, len(vocabulary))
        low, high = index.search(patterns)
        times = high - low
        which = np.repeat(np.arange(len(patterns)), times)
        rows = np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times) + low[which]
        for word, p in zip(at[index.locate(rows)].tolist(), which.tolist(), strict=True):
            yield word, length, owners[p]


def _scan(windows, cut: bool, last: bool, keep: list[str] = ()):
    def scan(batches):
        for batch in batches:
            raw, offsets = text_buffers(batch.column("text"))
            for first, stop in slices(offsets):
                yield shard(batch.slice(first, stop - first), raw[offsets[first] : offsets[stop]], offsets[first : stop + 1] - offsets[first])

    def shard(rows, raw, offsets):
        start, end, hashed, bounds = words_of(raw, offsets, ALNUM)
        hit = np.zeros(len(hashed) + 1, np.int64)
        found: list[set[str]] = [set(x or ()) for x in rows.column("items").to_pylist()]
        for r, spans in enumerate(rows.column("hits").to_pylist()):
            for a, b in zip((spans or [])[::2], (spans or [])[1::2], strict=True):
                hit[bounds[r] + a] += 1
                hit[bounds[r] + b] -= 1
        for word, length, items in find_windows(hashed, bounds, windows.value):
            hit[word] += 1
            hit[word + length] -= 1
            found[int(np.searchsorted(bounds, word, "right")) - 1].update(items)
        covered = np.cumsum(hit)[:-1] > 0
        spans, texts, counts = [], [], []
        column = rows.column("text")
        for r in range(len(bounds) - 1):
            a, b = bounds[r], bounds[r + 1]
            edges = np.flatnonzero(np.diff(np.r_[0, covered[a:b].astype(np.int8), 0])) if covered[a:b].any() else np.zeros(0, np.int64)
            counts.append(int(covered[a:b].sum()))
            if not last:
                spans.append(edges.tolist())
                continue
            own = raw[offsets[r] : offsets[r + 1]]
            bytespans = [(int(start[a + i] - offsets[r]), int(end[a + j - 1] - offsets[r])) for i, j in zip(edges[::2], edges[1::2], strict=True)]
            points = np.r_[0, np.cumsum((own & 0xC0) != 0x80)] if bytespans else None
            spans.append([{"start": int(points[i]), "end": int(points[j])} for i, j in bytespans])
            if cut and bytespans:
                rest = [own[i:j].tobytes() for i, j in zip([0, *(j for _, j in bytespans)], [*(i for i, _ in bytespans), len(own)], strict=True)]
                texts.append(b"".join(rest).decode("utf-8", "replace"))
            elif cut:
                texts.append(column[r].as_py())
        items = pa.array([sorted(x) for x in found], pa.list_(pa.string()))
        kept = [rows.column(f"keep_{k}") for k in range(len(keep))]
        if not last:
            arrays = [rows.column("doc_id"), column, pa.array(spans, pa.list_(pa.int32())), items]
            return pa.RecordBatch.from_arrays(arrays + kept, ["doc_id", "text", "hits", "items", *(f"keep_{k}" for k in range(len(keep)))])
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        out = [rows.column("doc_id"), pa.array(np.diff(bounds)), pa.array(counts, pa.int64()), items, pa.array(spans, kind)]
        names = ["doc_id", "n_words", "n_hit", "items", "spans"]
        return pa.RecordBatch.from_arrays(out + [pa.array(texts, pa.string())] * cut + kept, names + ["clean_text"] * cut + list(keep))

    return scan


def find_contamination(docs: DataFrame, benchmark: DataFrame, width: int = 10, cut: bool = False, keep: list[str] = ()) -> DataFrame:
    """(doc_id, n_words, n_hit, items, spans[, clean_text]) of every row of ``docs``, and its columns named in ``keep``.

    A window is ``width`` consecutive words of a benchmark text, or all words of a shorter one. ``n_hit`` counts
    the words inside any occurrence, ``items`` lists the ids (as strings, sorted) of the items with one, ``spans`` are the merged removal spans in
    code points, and ``clean_text`` (with ``cut``) is the text without them. An empty benchmark hits nothing.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").filter("text is not null").distinct()
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = int(size) // BLOCK_BYTES + 1
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.lit(None).cast("array<int>").alias("hits"), F.lit(None).cast("array<string>").alias("items"), *[F.col(c).alias(f"keep_{k}") for k, c in enumerate(keep)])
    kinds = [docs.schema[c].dataType.simpleString() for c in keep]
    for k in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()
        windows = spark.sparkContext.broadcast(Windows([(r["item_id"], r["text"]) for r in part], width))
        last = k == blocks - 1
        schema = "doc_id long, n_words long, n_hit long, items array<string>, spans array<struct<start:int,end:int>>" + ", clean_text string" * cut
        names = [f"`{c}`" for c in keep] if last else [f"keep_{i}" for i in range(len(keep))]
        schema = schema if last else "doc_id long, text string, hits array<int>, items array<string>"
        rows = rows.mapInArrow(_scan(windows, cut, last, list(keep)), ", ".join([schema, *(f"{c} {t}" for c, t in zip(names, kinds, strict=True))]))
        if k % CHAIN == CHAIN - 1 and not last:
            rows = materialize(rows, "contamination")
    return rows
