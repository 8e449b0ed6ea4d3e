"""SentencePiece encoding and decoding by suffix-array matching.

The distinct chunks of a slice of rows (white-space marks and what follows them; no piece crosses into the next
chunk) are concatenated and indexed by a suffix array. Every vocabulary piece is binary-searched for its range of
occurrences; the occurrences are edges, sorted by position. Relaxation then joins neighbouring symbols along the
best edge, best score first and leftmost on ties, which for a merge model gives the ids of the reference encoder;
all chunks advance at once, long ones by a heap. Characters without a piece fall back to bytes.

An index covers ``INDEXED`` characters of new chunks (or one longer chunk). Each Python worker remembers chunks it has
encoded (``MEMORY`` at most, then it starts anew). Null encodes as an
empty text: no ids. Decoding returns the text exactly unless it holds the mark U+2581 itself, which reads back as
a space. Rows are encoded one by one: repeated rows alike, null ids like others; other columns are left out. A model must leave texts as they
are (but for the mark before them) and be a merge model; others are refused. A chunk without white space is held whole, at some 400
bytes a character.
"""

from __future__ import annotations

import hashlib
import heapq
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import mix, placed, slices, text_buffers
from .scratch import local_path

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = 0x2581
SLICE, INDEXED, MEMORY, LONG = 1 << 20, 250_000, 400_000, 64
_NONE = np.int32(np.iinfo(np.int32).max)


class Vocabulary:
    """Pieces of a model file: code points, merge ranks (less is better), and the bytes each id stands for."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=local_path(path))
        plain, self.bytes, self.byte_id = [], [], np.full(256, model.unk_id(), np.int32)
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_id[value] = i
                self.bytes.append(bytes([value]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.bytes.append(b"")
            else:
                plain.append((piece, i, model.get_score(i)))
                self.bytes.append(piece.replace(chr(MARK), " ").encode())
        if any(chr(MARK) in p.lstrip(chr(MARK)) for p, _, _ in plain):
            raise ValueError("a piece goes beyond a chunk of marks and what follows them")
        odd = " \ufb01  A\u00a0\u3000e\u0301 "
        if model.normalize(odd) != chr(MARK) + odd.replace(" ", chr(MARK)):
            raise ValueError("the model changes texts before it encodes them, or puts no mark before them")
        self.ids = np.array([i for _, i, _ in plain], np.int32)
        _, rank = np.unique(-np.array([s for _, _, s in plain]), return_inverse=True)
        self.rank = rank.astype(np.int32)
        self.longest = max(len(p) for p, _, _ in plain)
        self.length = np.array([len(p) for p, _, _ in plain], np.int64)
        self.chars = np.zeros((len(plain), self.longest), np.int64)
        for k, (p, _, _) in enumerate(plain):
            self.chars[k, : len(p)] = [ord(c) for c in p]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """The pieces of a model file; ValueError unless it is a merge model, which it shows by its own ids of a probe text."""
    from sentencepiece import SentencePieceProcessor

    vocab = Vocabulary(path)
    probe = "".join(map(chr, vocab.chars[vocab.length > 2][:300].ravel())).replace("\0", "").replace(chr(MARK), " ")
    raw = np.frombuffer(probe.encode(), np.uint8)
    ids, _ = Encoder(vocab).encode(raw, np.array([0, len(raw)]))
    if ids.tolist() != SentencePieceProcessor(model_file=local_path(path)).encode(probe):
        raise ValueError("the model's ids are not those of merging best pairs first")
    return vocab


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes sorted by their first ``depth`` characters or more, by prefix doubling."""
    _, rank = np.unique(text, return_inverse=True)
    step = 1
    while step < depth:
        ahead = np.zeros_like(rank)
        ahead[:-step] = rank[step:] + 1
        _, rank = np.unique(rank * (int(ahead.max()) + 1) + ahead, return_inverse=True)
        step *= 2
    return np.argsort(rank, kind="stable")


def occurrences(text: np.ndarray, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges (position, length, piece) of every occurrence of every piece, sorted by position."""
    order = suffix_array(text, vocab.longest)
    padded = np.r_[text, np.zeros(vocab.longest + 1, text.dtype)]
    low, high = np.zeros(len(vocab.ids), np.int64), np.full(len(vocab.ids), len(text), np.int64)
    for depth in range(vocab.longest):
        live = np.flatnonzero((vocab.length > depth) & (low < high))
        if not len(live):
            break
        want = vocab.chars[live, depth]
        column = padded[order + depth]
        bounds = []
        for side in (0, 1):  # first suffix of the range not below (0) or above (1) the wanted character
            a, b = low[live].copy(), high[live].copy()
            while True:
                open_ = a < b
                if not open_.any():
                    break
                middle = (a + b) >> 1
                at = column[np.minimum(middle, len(column) - 1)]
                go = open_ & ((at < want) | ((at == want) & (side == 1)))
                b = np.where(open_ & ~go, middle, b)
                a = np.where(go, middle + 1, a)
            bounds.append(a)
        low[live], high[live] = bounds
    times = np.maximum(high - low, 0)
    piece = np.repeat(np.arange(len(times), dtype=np.int32), times)
    rows = np.arange(len(piece)) - np.repeat(np.cumsum(times) - times - low, times)
    position = order.astype(np.int32)[rows]
    by = np.argsort(position, kind="stable")
    return position[by], vocab.length[piece[by]], piece[by]


def _heap_merge(start: int, end: int, edge: np.ndarray, rank: np.ndarray, longest: int) -> list[tuple[int, int]]:
    """Symbols (start, end) of one long chunk."""
    after = {i: i + 1 for i in range(start, end)}
    before = {i: i - 1 for i in range(start + 1, end)}
    heap: list[tuple[int, int, int, int]] = []

    def offer(a: int) -> None:
        b = after[a]
        if b < end and after[b] - a <= longest and (p := edge[a, after[b] - a - 1]) >= 0:
            heapq.heappush(heap, (int(rank[p]), a, b, after[b]))

    for i in range(start, end - 1):
        offer(i)
    while heap:
        _, a, b, c = heapq.heappop(heap)
        if after.get(a) != b or after.get(b) != c:
            continue
        after[a] = c
        del after[b]
        before.pop(b, None)
        if c < end:
            before[c] = a
            offer(a)
        if a > start:
            offer(before[a])
    return [(a, after[a]) for a in sorted(after)]


def encode_chunks(text: np.ndarray, starts: np.ndarray, ends: np.ndarray, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(ids, first id of each chunk): chunks are [starts, ends) of ``text``, a 0 after each."""
    position, length, piece = occurrences(text, vocab)
    edge = np.full((len(text), vocab.longest), -1, np.int32)
    edge[position, length - 1] = piece
    rank = vocab.rank
    long = ends - starts > LONG
    done: list[tuple[np.ndarray, np.ndarray]] = []
    for k in np.flatnonzero(long):
        spans = np.array(_heap_merge(int(starts[k]), int(ends[k]), edge, rank, vocab.longest), np.int64)
        done.append((spans[:, 0], spans[:, 1]))
    sizes = (ends - starts)[~long]
    chunk = np.repeat(np.arange(len(sizes)), sizes)
    a = np.arange(len(chunk)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts[~long], sizes)
    b = a + 1
    while len(a):
        joint = np.flatnonzero(chunk[1:] == chunk[:-1])
        span = b[joint + 1] - a[joint]
        found = np.where(span <= vocab.longest, edge[a[joint], np.minimum(span, vocab.longest) - 1], -1)
        worth = np.full(len(a), _NONE, np.int64)
        worth[joint[found >= 0]] = rank[found[found >= 0]].astype(np.int64)
        heads = np.flatnonzero(np.r_[True, chunk[1:] != chunk[:-1]])
        best = np.minimum.reduceat(worth, heads)
        lengths = np.diff(np.r_[heads, len(a)])
        least = np.repeat(best, lengths)
        still = least < _NONE
        done.append((a[~still], b[~still]))
        hits = np.flatnonzero((worth == least) & still)
        hits = hits[np.r_[True, chunk[hits[1:]] != chunk[hits[:-1]]]] if len(hits) else hits  # leftmost
        b[hits] = b[hits + 1]
        still[hits + 1] = False
        a, b, chunk = a[still], b[still], chunk[still]
    a = np.concatenate([x for x, _ in done])
    b = np.concatenate([x for _, x in done])
    order = np.argsort(a, kind="stable")
    a, b = a[order], b[order]
    piece = edge[a, b - a - 1]
    known = piece >= 0
    if known.all():
        ids = vocab.ids[piece]
        return ids, np.searchsorted(a, starts)
    raw = [[i] for i in vocab.ids[piece].tolist()]
    for k in np.flatnonzero(~known):
        raw[k] = vocab.byte_id[list(chr(text[a[k]]).encode())].tolist()
    counts = np.r_[0, np.cumsum([len(x) for x in raw])]
    return np.array([i for x in raw for i in x], np.int32), counts[np.searchsorted(a, starts)]


class Encoder:
    """Encodes rows of texts; remembers the chunks it has met."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.forget()

    def forget(self) -> None:
        self.keys, self.first, self.count = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, row offsets into them) of UTF-8 rows."""
        points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32).astype(np.int64)
        at = np.r_[0, np.cumsum((raw & 0xC0) != 0x80)][offsets]
        points[points == 0x20] = MARK
        filled = at[1:] > at[:-1]
        text = np.insert(points, at[:-1][filled], MARK)
        row_start = (at[:-1] + np.cumsum(filled) - filled)[filled]
        mark = text == MARK
        opens = mark.copy()
        opens[1:] &= ~mark[:-1]
        opens[row_start] = True
        starts = np.flatnonzero(opens)
        ends = np.r_[starts[1:], len(text)].astype(np.int64)
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        place = np.arange(len(text), dtype=np.int64) - np.repeat(starts, ends - starts)
        total = np.r_[np.uint64(0), np.cumsum(placed(place.astype(np.uint64), text.astype(np.uint64)))]
        keys = mix(total[ends] - total[starts] + (ends - starts).astype(np.uint64))
        distinct, where, inverse = np.unique(keys, return_index=True, return_inverse=True)
        place = np.searchsorted(self.keys, distinct)
        known = (self.keys[np.minimum(place, len(self.keys) - 1)] == distinct) if len(self.keys) else np.zeros(len(distinct), bool)
        if len(self.keys) + (~known).sum() > MEMORY:
            self.forget()
            known[:] = False
        self._learn(text, starts[where[~known]], ends[where[~known]], distinct[~known])
        place = np.searchsorted(self.keys, distinct)
        first, count = self.first[place][inverse], self.count[place][inverse]
        bounds = np.r_[0, np.cumsum(count)]
        ids = self.ids[np.repeat(first - bounds[:-1], count) + np.arange(bounds[-1])]
        rows = np.zeros(len(offsets), np.int64)
        rows[:-1] = bounds[np.searchsorted(starts, at[:-1] + np.cumsum(filled) - filled)]
        rows[-1] = bounds[-1]
        return ids, rows

    def _learn(self, text, starts, ends, keys) -> None:
        sizes = ends - starts + 1
        known, first, count, ids, done = [self.keys], [self.first], [self.count], [self.ids], len(self.ids)
        for a, b in slices(np.r_[0, np.cumsum(sizes)], INDEXED):  # each index covers so many characters, or one chunk
            begin = np.cumsum(sizes[a:b]) - sizes[a:b]
            joined = text[np.minimum(np.repeat(starts[a:b] - begin, sizes[a:b]) + np.arange(sizes[a:b].sum()), len(text) - 1)]
            joined[begin + sizes[a:b] - 1] = 0
            new, at = encode_chunks(joined, begin, begin + sizes[a:b] - 1, self.vocab)
            first.append(at + done)
            count.append(np.diff(np.r_[at, len(new)]))
            ids.append(new)
            known.append(keys[a:b])
            done += len(new)
        if len(known) > 1:
            keys = np.concatenate(known)
            order = np.argsort(keys, kind="stable")
            self.keys, self.first, self.count = keys[order], np.concatenate(first)[order], np.concatenate(count)[order]
            self.ids = np.concatenate(ids)


def decode(ids, vocab: Vocabulary) -> str:
    """The text of a row's ids."""
    if not len(ids):
        return ""
    text = b"".join(map(vocab.bytes.__getitem__, ids.tolist() if hasattr(ids, "tolist") else ids)).decode("utf-8", "replace")
    return text[1:] if text.startswith(" ") else text


def encode_sentencepiece(docs: DataFrame, model: str = MODEL, text: str = "text", digest: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids) of every row or, with ``digest``, (doc_id, n_tokens, ids_sha256, round_trip).

    ``ids_sha256`` is over the ids as little-endian 32-bit numbers; ``round_trip`` tells whether decoding gives the text.
    """

    def run(batches):
        vocab = vocabulary(model)
        encoder = Encoder(vocab)
        for batch in batches:
            raw_all, offsets = text_buffers(batch.column(1))
            for first, last in slices(offsets, SLICE):
                raw, at = raw_all[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
                ids, rows = encoder.encode(raw, at)
                out = {"doc_id": batch.column(0).slice(first, last - first), "n_tokens": pa.array(np.diff(rows))}
                if digest:
                    packed = ids.astype("<i4").tobytes()
                    out["ids_sha256"] = pa.array([hashlib.sha256(packed[4 * a : 4 * b]).hexdigest() for a, b in zip(rows[:-1], rows[1:], strict=True)])
                    source = raw.tobytes()
                    out["round_trip"] = pa.array([decode(ids[a:b], vocab).encode() == source[i:j] for a, b, i, j in zip(rows[:-1], rows[1:], at[:-1], at[1:], strict=True)])
                else:
                    out["ids"] = pa.ListArray.from_arrays(pa.array(rows, pa.int32()), pa.array(ids))
                yield pa.RecordBatch.from_pydict(out)

    more = "ids_sha256 string, round_trip boolean" if digest else "ids array<int>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id long, n_tokens long, {more}")


def decode_sentencepiece(encoded: DataFrame, model: str = MODEL, ids: str = "ids") -> DataFrame:
    """(doc_id, text) of rows of ids; null ids decode to the empty text."""

    def run(batches):
        vocab = vocabulary(model)
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "text": pa.array([decode(x or [], vocab) for x in batch.column(1).to_pylist()], pa.string())})

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(ids).alias("ids")).mapInArrow(run, "doc_id long, text string")
