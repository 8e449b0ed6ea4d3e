"""Cross-tokenizer alignment: which tokens of two tokenizers end together, and how often an id of one is linked with an id of the other.

Every text is tokenised whole by both, in the words between its single spaces: no token of either tokenizer goes across one that has a word character
or visible ASCII on both sides (A splits before it, B has no piece with a mark inside), so the ids of a word are those it has in its text. A word's ids
and their alignment are found once and remembered. Where other spaces are left in a word, ends that both tokenizers have before tokens that begin with a space are
anchors that cut it into windows, remembered by their two id tuples. Byte offsets where both have an end cut groups of tokens; the last tokens of a group are a link.

Links are counted over all rows: each task adds up the pairs of its rows, then pairs are summed by key. The counts of the KNOWN most frequent
pairs at most are sent to every task, which is nearly all links; rarer pairs, if there are more, meet their counts by a join, so no
pair is left out. The best count of each id of B is one row an id of its vocabulary.

Texts beyond SEGMENT characters are taken in runs that are cut at a single space between two word characters, so memory is that of a run.

Defined results: null and empty texts, and texts that one of the tokenizers changes (joined token bytes other than a space and the text), have no
tokens: zeros, and no groups. Repeated rows count again; null and repeated ids are rows like others. Other columns are left out, whatever their names.
"""

from __future__ import annotations

import gc
import hashlib
import os
import re
from collections.abc import Iterable
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import slices, text_buffers
from .scratch import local_path, materialize

BYTE_LEVEL, PIECES = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
#: Characters of a run, words and windows a worker remembers, tokens of one that is remembered, bytes of texts aligned together, pairs sent to every task.
SEGMENT, MEMORY, REMEMBERED, SLICE, KNOWN = 1 << 18, 300_000, 64, 1 << 20, 1 << 20
#: How a byte-level vocabulary splits texts before it merges; a fixed value.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A single space that no token of either tokenizer goes across.
_BETWEEN = re.compile(r" (?<=[\w!-~] )(?=[\w!-~])")
_PAIRED = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, {groups} string, a array<int>, b array<int>, times array<int>"


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable ones for themselves, the rest, in order, from code point 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(rest)}


class Tokens:
    """What the ids of a tokenizer stand for."""

    def __init__(self, pieces: list[bytes]):
        self.bytes = pieces
        self.size = np.array([len(p) for p in pieces], np.int64)
        self.spaced = np.array([p[:1] == b" " for p in pieces], bool)
        self._flat, self._first = np.frombuffer(b"".join(pieces), np.uint8), (np.cumsum(self.size) - self.size).astype(np.int32)

    def joined(self, ids: list[np.ndarray]) -> list[bytes]:
        """The bytes that each of several lists of ids stands for."""
        every = np.concatenate(ids)
        size = self.size[every].astype(np.int32)
        ends = np.cumsum(size, dtype=np.int64)
        total = int(ends[-1]) if len(ends) else 0
        raw = self._flat[np.repeat(self._first[every] - (ends - size), size) + np.arange(total)].tobytes()
        at = np.r_[0, ends][np.cumsum([0, *map(len, ids)])].tolist()
        return [raw[i:j] for i, j in zip(at[:-1], at[1:], strict=True)]


class ByteLevel:
    """Tokenizer A, a byte-level vocabulary with merges (JSON); texts get a space in front.

    Where the file's entries in order of their ids are its merges in order, as a probe of all entries tells, a faster encoder of the same vocabulary is used.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(local_path(path))
        self.tokenizer.encode_special_tokens = True
        letters, vocabulary = byte_letters(), self.tokenizer.get_vocab(with_added_tokens=True)
        pieces, special = [b""] * (max(vocabulary.values()) + 1), {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        for token, i in vocabulary.items():
            pieces[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        self.tokens = Tokens(pieces)
        ranks = {pieces[i]: i for token, i in vocabulary.items() if token not in special}
        self.fast = tiktoken.Encoding("byte-level", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        probe = "".join(p.decode("utf-8", "ignore") for p in pieces)
        if self.fast.encode_ordinary(probe) != self.tokenizer.encode(probe, add_special_tokens=False).ids:
            self.fast = None

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if self.fast:
            return [np.array(self.fast.encode_ordinary(" " + t), np.int32) for t in texts]
        return [np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]


class Pieces:
    """Tokenizer B, a model of pieces with byte fallback, which puts a space in front itself."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=local_path(path))
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.tokens = Tokens([bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(ids, np.int32) for ids in self.model.encode(texts, num_threads=1)]


def runs(text: str, limit: int) -> list[str]:
    """Runs of about ``limit`` characters, cut at single spaces between word characters, without those spaces; one run if there is no such place."""
    out, first = [], 0
    place = re.compile(r"(?<=\w) (?=\w)")
    while len(text) - first > limit and (cut := place.search(text, first + limit)):
        out.append(text[first : cut.start()])
        first = cut.end()
    return [*out, text[first:]]


class Aligner:
    """Aligns the ids of two tokenizers; remembers the windows it has met."""

    def __init__(self, a: Tokens, b: Tokens):
        self.a, self.b = a, b
        self.memory: dict[tuple[bytes, bytes], tuple[str, bytes, int]] = {}
        #: An id as text with what comes after it: within its group, and at the end of its side of a group.
        self.shown = [f"{i}{end}" for tokens, last in ((a, "|"), (b, ";")) for i in range(len(tokens.bytes)) for end in (",", last)]

    def windows(self, a: np.ndarray, b: np.ndarray) -> list[tuple[bytes, bytes]]:
        """The id tuples of a run's windows, in order."""
        ends = [np.cumsum(t.size[ids]) for t, ids in ((self.a, a), (self.b, b))]
        before = [end[:-1][t.spaced[ids[1:]]] for end, t, ids in zip(ends, (self.a, self.b), (a, b), strict=True)]
        anchors = np.intersect1d(*before, assume_unique=True)  # ends of both before space-marked tokens of both
        at_a, at_b = ([0, *(4 * (np.searchsorted(end, anchors) + 1)).tolist(), 4 * len(ids)] for end, ids in zip(ends, (a, b), strict=True))
        raw_a, raw_b = a.tobytes(), b.tobytes()
        return [(raw_a[i:m], raw_b[j:n]) for i, m, j, n in zip(at_a[:-1], at_a[1:], at_b[:-1], at_b[1:], strict=True)]

    def align(self, windows: list[tuple[bytes, bytes]]) -> list[tuple[str, bytes, int]]:
        """(groups as text, linked pairs as 32-bit numbers, groups) of windows: as both sides of a window have the same bytes, they are one run with known cuts."""
        if not windows:
            return []
        sides, ends = [np.frombuffer(b"".join(w[k] for w in windows), np.int32) for k in (0, 1)], []
        for t, ids in zip((self.a, self.b), sides, strict=True):
            ends.append(np.cumsum(t.size[ids]))
        shared = np.intersect1d(*ends, assume_unique=True)
        group = [np.searchsorted(shared, end) for end in ends]
        last = [shared[g] == end for g, end in zip(group, ends, strict=True)]
        links = np.column_stack([ids[at] for ids, at in zip(sides, last, strict=True)]).astype(np.int32)
        order = np.argsort(np.concatenate([2 * group[0], 2 * group[1] + 1]), kind="stable")
        named = np.concatenate([2 * sides[0].astype(np.int64) + last[0], 2 * (len(self.a.bytes) + sides[1].astype(np.int64)) + last[1]])
        texts = list(map(self.shown.__getitem__, named[order].tolist()))
        counts = [np.cumsum([len(w[k]) // 4 for w in windows]) for k in (0, 1)]
        at = [0, *(counts[0] + counts[1]).tolist()]
        groups = [0, *(group[0][counts[0] - 1] + 1).tolist()]
        raw = links.tobytes()
        return [("".join(texts[i:j])[:-1], raw[8 * m : 8 * n], n - m) for i, j, m, n in zip(at[:-1], at[1:], groups[:-1], groups[1:], strict=True)]

    def aligned(self, runs: list[list[tuple[bytes, bytes]]]) -> list[list[tuple[str, bytes, int]]]:
        """``align`` of the windows of all runs, each distinct one once, and none that is remembered."""
        memory = self.memory
        fresh = [w for w in dict.fromkeys(chain.from_iterable(runs)) if w not in memory]
        new = dict(zip(fresh, self.align(fresh), strict=True))
        out = [[new[w] if w in new else memory[w] for w in run] for run in runs]
        if len(memory) + len(new) > MEMORY:
            memory.clear()
        memory.update((w, new[w]) for w in fresh[:MEMORY] if len(w[0]) <= 4 * REMEMBERED)
        return out


class Words:
    """Words with the ids of both tokenizers, aligned; remembers those it has met, and forgets those not met for longest."""

    def __init__(self, a: ByteLevel, b: Pieces, aligner: Aligner):
        self.a, self.b, self.aligner = a, b, aligner
        self.recent: dict[str, tuple[int, int, str | None, bytes]] = {}
        self.older: dict[str, tuple[int, int, str | None, bytes]] = {}

    def encode(self, words: list[str]) -> list[tuple[int, int, str | None, bytes]]:
        """(tokens of A, tokens of B, groups as text, linked pairs as 32-bit numbers) of words; no groups (None) where one of the tokenizers changes a word."""
        if not words:
            return []
        left, right = self.a.encode(words), self.b.encode(words)
        both = zip(words, self.a.tokens.joined(left), self.b.tokens.joined(right), strict=True)
        same = [b" " + w.encode() == x == y for w, x, y in both]
        out: list[tuple[int, int, str | None, bytes]] = [(len(x), len(y), None, b"") for x, y in zip(left, right, strict=True)]
        plain = [k for k, w in enumerate(words) if same[k] and " " not in w]
        for k, (groups, links, _) in zip(plain, self.aligner.align([(left[k].tobytes(), right[k].tobytes()) for k in plain]), strict=True):
            out[k] = (*out[k][:2], groups, links)
        spaced = [k for k, w in enumerate(words) if same[k] and " " in w]
        for k, found in zip(spaced, self.aligner.aligned([self.aligner.windows(left[k], right[k]) for k in spaced]), strict=True):
            out[k] = (*out[k][:2], ";".join(w[0] for w in found), b"".join(w[1] for w in found))
        return out

    def learned(self, words: Iterable[str]) -> dict[str, tuple[int, int, str | None, bytes]]:
        """``encode`` of all distinct words by word, and only of those not remembered anew."""
        own = dict.fromkeys(words)
        for word in own:
            own[word] = self.recent.get(word) or self.older.get(word)
        fresh = [word for word, known in own.items() if not known]
        own.update(zip(fresh, self.encode(fresh), strict=True))
        if len(self.recent) + len(own) > MEMORY // 2:
            self.older, self.recent = self.recent, {}
        self.recent.update(x for x in own.items() if x[1][0] <= REMEMBERED)
        return own


@lru_cache(maxsize=2)
def _tools(path_a: str, path_b: str) -> tuple[ByteLevel, Pieces, Aligner]:
    a, b = ByteLevel(path_a), Pieces(path_b)
    if any(" " in p.lstrip(b" ").decode("utf-8", "ignore") for p in b.tokens.bytes):
        raise ValueError("a piece of B goes across a space")
    return a, b, Aligner(a.tokens, b.tokens)


@lru_cache(maxsize=2)
def _words(path_a: str, path_b: str) -> Words:
    return Words(*_tools(path_a, path_b))


def aligned_texts(texts: list[str], path_a: str, path_b: str) -> list[tuple[int, int, int, str, np.ndarray]]:
    """(tokens of A, tokens of B, groups, groups as text, pairs of linked ids) of every text; no tokens where one of the tokenizers changes a text."""
    words, out = _words(path_a, path_b), []
    parts = [(k, p) for k, t in enumerate(texts) if t for p in runs(t, SEGMENT)]
    found: list[list[tuple[int, int, str | None, bytes]]] = [[] for _ in texts]
    ends = np.cumsum([len(p) for _, p in parts])
    for own in np.split(np.arange(len(parts)), np.flatnonzero(np.diff(ends // SLICE)) + 1):  # runs of about a slice
        cut = [_BETWEEN.split(parts[k][1]) for k in own]
        known = words.learned(chain.from_iterable(cut))
        for k, run in zip(own, cut, strict=True):
            n_a, n_b, groups, links = zip(*map(known.__getitem__, run), strict=True)
            found[parts[k][0]].append((sum(n_a), sum(n_b), None if None in groups else ";".join(groups), b"".join(links)))
    for mine in found:
        if not mine or any(groups is None for _, _, groups, _ in mine):
            out.append((0, 0, 0, "", np.zeros((0, 2), np.int32)))
            continue
        n_a, n_b, groups, raw = zip(*mine, strict=True)
        links = np.frombuffer(b"".join(raw), np.int32).reshape(-1, 2)
        out.append((sum(n_a), sum(n_b), len(links), ";".join(groups), links))
    return out


def align_tokenizers(docs: DataFrame, byte_level: str = BYTE_LEVEL, pieces: str = PIECES, text: str = "text", key: str = "doc_id", digest: bool = False) -> DataFrame:
    """(row, doc_id, n_a, n_b, n_groups, n_links, groups, a, b, times) of every row.

    ``groups`` reads ``a1,a2|b1;a3|b2,b3`` (with ``digest``, ``groups_sha256`` in its place; empty without tokens); ``a`` and ``b`` are the
    distinct linked ids, ``times`` how often the row links them. ``row`` is a number of the row's own.
    """

    def run(batches):
        gc.disable()  # millions of small tuples and no cycles
        try:
            yield from align(batches)
        finally:
            gc.enable()

    def align(batches):
        for batch in batches:
            raw, offsets = text_buffers(batch.column(2))
            for first, last in slices(offsets, SLICE):
                texts = [raw[i:j].tobytes().decode() for i, j in zip(offsets[first:last].tolist(), offsets[first + 1 : last + 1].tolist(), strict=True)]
                found = aligned_texts(texts, byte_level, pieces)
                pairs, times = [], []
                for *_, links in found:
                    distinct, count = np.unique((links[:, 0].astype(np.int64) << 32) | links[:, 1], return_counts=True)
                    pairs.append(distinct)
                    times.append(count)
                at = pa.array(np.r_[0, np.cumsum([len(p) for p in pairs])], pa.int32())
                joined = np.concatenate(pairs)
                lists = [pa.ListArray.from_arrays(at, pa.array(x.astype(np.int32))) for x in (joined >> 32, joined & 0xFFFFFFFF, np.concatenate(times))]
                groups = [hashlib.sha256(g.encode()).hexdigest() if g and digest else g for *_, g, _ in found]
                numbers = [pa.array([f[k] for f in found], pa.int64()) for k in (0, 1, 2)]
                linked = pa.array([len(f[4]) for f in found], pa.int64())
                yield pa.RecordBatch.from_arrays([*(c.slice(first, last - first) for c in batch.columns[:2]), *numbers, linked, pa.array(groups, pa.string()), *lists], names)

    schema = _PAIRED.format(groups="groups_sha256" if digest else "groups")
    names = [x.split()[0] for x in schema.split(", ")]
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return numbered.mapInArrow(run, schema)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, a, b, n, best): how many links of all rows each pair of ids has, and whether it is the highest count of its id of B."""

    def add(batches):
        for batch in batches:
            a, b, times = (batch.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("a", "b", "times"))
            pair, where = np.unique((a << 32) | b, return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(np.bincount(where, times, len(pair)).astype(np.int64))], ["pair", "n"])

    summed = aligned.select("a", "b", "times").mapInArrow(add, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counts = summed.select("pair", F.shiftright("pair", 32).cast("int").alias("a"), F.col("pair").bitwiseAND(0xFFFFFFFF).cast("int").alias("b"), "n")
    counts = materialize(counts, "pairs")
    highest = counts.groupBy("b").agg(F.max("n").alias("most"))  # one row an id of B
    return counts.join(F.broadcast(highest), "b").select("pair", "a", "b", "n", (F.col("n") == F.col("most")).alias("best"))


def with_counts(aligned: DataFrame, counts: DataFrame) -> DataFrame:
    """``aligned`` (a written table) without its pairs, with ``n_best`` and ``count_sum``: links with the best count of their id of B, and the sum of all links' counts."""
    sizes = counts.groupBy(F.floor(F.log2("n")).cast("int").alias("power")).agg(F.count("*").alias("pairs")).collect()  # a row a power of two
    least, total = 64, 0
    for power, pairs in sorted(((r["power"], r["pairs"]) for r in sizes), reverse=True):
        if total + pairs > KNOWN:
            break
        least, total = power, total + pairs
    everything = total == sum(r["pairs"] for r in sizes)
    known = counts.filter(F.floor(F.log2("n")) >= least).select("pair", "n", "best").toArrow() if total else None
    columns = [known.column(c).to_numpy() for c in ("pair", "n", "best")] if known is not None else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)]
    order = np.argsort(columns[0])
    shared = aligned.sparkSession.sparkContext.broadcast([c[order] for c in columns])
    kept = [c for c in aligned.columns if c not in ("a", "b", "times")]

    def look(batches):
        pair, n, best = shared.value
        for batch in batches:
            a, b, times = (batch.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("a", "b", "times"))
            own = np.repeat(np.arange(batch.num_rows), batch.column("a").value_lengths().to_numpy())
            wanted = (a << 32) | b
            at = np.minimum(np.searchsorted(pair, wanted), max(len(pair) - 1, 0))
            hit = pair[at] == wanted if len(pair) else np.zeros(len(wanted), bool)
            at = at[hit]
            value, rows = times[hit] * n[at], own[hit]
            total = np.zeros(batch.num_rows, np.int64)
            np.add.at(total, rows, value)
            good = np.bincount(rows, times[hit] * best[at], batch.num_rows).astype(np.int64)
            missed = np.r_[0, np.cumsum(np.bincount(own[~hit], minlength=batch.num_rows))]
            rest = [pa.ListArray.from_arrays(pa.array(missed, pa.int32()), pa.array(x)) for x in (wanted[~hit], times[~hit])]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(good), pa.array(total), *rest], [*kept, "n_best", "count_sum", "rare", "rare_times"])

    types = dict(aligned.dtypes)
    found = aligned.mapInArrow(look, ", ".join(f"{c} {types[c]}" for c in kept) + ", n_best long, count_sum long, rare array<long>, rare_times array<long>")
    if everything:
        return found.drop("rare", "rare_times")
    # pairs too rare to be sent out: each has few links, so its key is never crowded
    found = materialize(found, "counted")
    each = found.select("row", F.explode(F.arrays_zip("rare", "rare_times")).alias("x")).select("row", F.col("x.rare").alias("pair"), F.col("x.rare_times").alias("times"))
    few = each.join(counts.filter(F.floor(F.log2("n")) < least).select("pair", "n", "best"), "pair")
    more = few.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum"))
    joined = found.drop("rare", "rare_times").join(more, "row", "left")
    return joined.select(*kept, (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"), (F.col("count_sum") + F.coalesce("more_sum", F.lit(0))).alias("count_sum"))


def align_and_count(docs: DataFrame, digest: bool = False, **more) -> DataFrame:
    """``align_tokenizers`` of every row with the corpus counts of its links: (row, doc_id, n_a, n_b, n_groups, n_links, groups, n_best, count_sum)."""
    aligned = materialize(align_tokenizers(docs, digest=digest, **more), "aligned")
    return with_counts(aligned, materialize(pair_counts(aligned), "counts"))
