"""Token counts by a linear longest-match automaton: greedy word-piece lengths without building pieces.

The trie holds the vocabulary's pieces as bytes, and every single byte. Each node has a failure link to the node of
what remains once the longest pieces at its front are taken, and the precomputed number of those pieces. A word is
read once from left to right; missing edges follow failure links and add their counts. All distinct words of a slice
of rows advance together, a byte at a time; words of more than ``LONG`` bytes are walked one by one, so a long one costs its own length.

A word is a run of anything but ASCII white space, read with the vocabulary's word mark before it. Characters without
a piece count one token a byte. Null, empty and blank texts have no tokens. Rows are counted one by one: repeated rows alike, null
ids like others; other columns are left out.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import NON_SPACE, slices, text_buffers, words_of
from .scratch import local_path

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "\u2581"
SLICE, LONG = 2 << 20, 256


def pieces_of(path: str) -> list[bytes]:
    """The ordinary pieces of a SentencePiece model file."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=local_path(path))
    odd = lambda i: model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)
    return [model.id_to_piece(i).encode() for i in range(model.get_piece_size()) if not odd(i)]


class LongestMatch:
    """Trie with failure links and popped-token counts; edges are a sorted array of node * 256 + byte."""

    def __init__(self, pieces: list[bytes]):
        children: list[dict[int, int]] = [{}]
        final = [False]
        for piece in [bytes([b]) for b in range(256)] + [p for p in pieces if p]:
            node = 0
            for b in piece:
                if b not in children[node]:
                    children[node][b] = len(children)
                    children.append({})
                    final.append(False)
                node = children[node][b]
            final[node] = True
        link, popped, queue = [0] * len(children), [0] * len(children), [0]
        for node in queue:
            for b, child in children[node].items():
                if final[child]:
                    link[child], popped[child] = 0, 1
                else:
                    at, count = link[node], popped[node]
                    while b not in children[at]:
                        count, at = count + popped[at], link[at]
                    link[child], popped[child] = children[at][b], count
                queue.append(child)
        edges = sorted((node << 8 | b, child) for node, out in enumerate(children) for b, child in out.items())
        self.keys = np.array([k for k, _ in edges], np.int64)
        self.targets = np.array([c for _, c in edges], np.int64)
        self.link, self.popped = np.array(link, np.int64), np.array(popped, np.int64)
        self.walk = dict(edges), link, popped

    def advance(self, state: np.ndarray, byte: np.ndarray, count: np.ndarray) -> np.ndarray:
        """The next states; ``count`` grows by the tokens popped on the way."""
        state, todo = state.copy(), np.arange(len(state))
        while len(todo):
            key = state[todo] << 8 | byte[todo]
            at = np.searchsorted(self.keys, key)
            hit = self.keys[np.minimum(at, len(self.keys) - 1)] == key
            state[todo[hit]] = self.targets[at[hit]]
            todo = todo[~hit]
            count[todo] += self.popped[state[todo]]
            state[todo] = self.link[state[todo]]
        return state

    def length(self, word: bytes) -> int:
        """Tokens of one word."""
        edges, link, popped = self.walk
        state = count = 0
        for b in word:
            while (ahead := edges.get(state << 8 | b)) is None:
                count, state = count + popped[state], link[state]
            state = ahead
        while state:
            count, state = count + popped[state], link[state]
        return count

    def lengths(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, prefix: bytes = b"") -> np.ndarray:
        """Tokens of each word raw[start:end] read after ``prefix``."""
        long = np.flatnonzero(ends - starts > LONG)
        whole = [self.length(prefix + raw[starts[k] : ends[k]].tobytes()) for k in long.tolist()]
        ends = ends.copy()
        ends[long] = starts[long]
        order = np.argsort(starts - ends, kind="stable")  # longest first: the words still running are a front part
        starts, sizes = starts[order], (ends - starts)[order]
        count, state = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
        head, before = np.zeros(1, np.int64), np.zeros(1, np.int64)
        for b in prefix:
            head = self.advance(head, np.array([b]), before)
        count += before[0]
        state[:] = head[0]
        running = np.searchsorted(-sizes, -np.arange(1, (int(sizes[0]) if len(sizes) else 0) + 1), "right")
        for step, n in enumerate(running.tolist()):
            part = count[:n]
            state[:n] = self.advance(state[:n], raw[starts[:n] + step].astype(np.int64), part)
        while (open_ := np.flatnonzero(state)).size:
            count[open_] += self.popped[state[open_]]
            state[open_] = self.link[state[open_]]
        out = np.empty_like(count)
        out[order] = count
        out[long] = whole
        return out


@lru_cache(maxsize=2)
def automaton(path: str) -> LongestMatch:
    return LongestMatch(pieces_of(path))


def count_tokens(docs: DataFrame, model: str = MODEL, text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_tokens) of every row."""

    def run(batches):
        machine = automaton(model)
        for batch in batches:
            raw_all, offsets = text_buffers(batch.column(1))
            for first, last in slices(offsets, SLICE):
                raw, at = raw_all[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
                start, end, hashed, bounds = words_of(raw, at, NON_SPACE, fold=False)
                _, where, inverse = np.unique(hashed, return_index=True, return_inverse=True)
                length = machine.lengths(raw, start[where], end[where], MARK.encode())[inverse]
                total = np.r_[0, np.cumsum(length)]
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0).slice(first, last - first), "n_words": pa.array(np.diff(bounds)), "n_tokens": pa.array(total[bounds[1:]] - total[bounds[:-1]])})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, n_words long, n_tokens long")
