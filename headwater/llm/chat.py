r"""Chat formatting with offset-aligned loss masks.

A turn is rendered ``### role: text</turn>`` and a line feed. Inside texts (and roles) a backslash goes before every
backslash, ``###`` and ``</turn>`` (and ``:`` in roles), so nothing inside a text reads as a mark, and reading back is
exact. A conversation is rendered whole and encoded once with offsets: the bytes that the tokens stand for, summed up. The
encoder is fed segments of whole turns, which bounds memory and gives the ids of the whole: a segment ends in a line feed before
``#``, and no token of the encoder's pattern crosses there. A token is under the loss mask when its span meets an assistant text;
both span lists are sorted, so the tokens of a text are found by binary search.

Rows are ordered by turn, then role and text; repeated rows are turns of their own. Null roles and texts are empty. Null
conversation ids form one conversation. Other columns are left out. Conversations stream through sorted partitions, a segment in
memory at a time; one conversation passes through one task, as its digest is one chain over all its turns.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import local_path

#: Ranks of a byte-level vocabulary: a piece in base64 and its id a line. Executors need the file under the same path, or added with ``addFile``.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern by which that vocabulary splits texts.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SEGMENT_CHARS = 1 << 16
LOSS_ROLE = "assistant"
_TURN = re.compile(r"### ((?:[^\\:]+|\\.)*): ((?:[^\\<]+|\\.|<(?!/turn>))*)</turn>\n", re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)


def escaped(text: str) -> str:
    return text.replace("\\", "\\\\").replace("###", "\\###").replace("</turn>", "\\</turn>")


def unescaped(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def rendered(role: str, text: str) -> tuple[str, int, int]:
    """A turn, and where its text begins and ends."""
    head = f"### {escaped(role).replace(':', chr(92) + ':')}: "
    body = escaped(text)
    return f"{head}{body}</turn>\n", len(head), len(head) + len(body)


def read_turns(formatted: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start, end) of every turn: the text unescaped, its span as rendered."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        out.append((unescaped(m[1]), unescaped(m[2]), m.start(2), m.end(2)))
        at = m.end()
    return out


class Encoder:
    """A byte-level encoder that knows the bytes of its tokens, and so their offsets."""

    def __init__(self, path: str):
        import tiktoken

        lines = Path(local_path(path)).read_bytes().split(b"\n")
        ranks = {base64.b64decode(piece): int(rank) for piece, rank in (line.split() for line in lines if line.strip())}
        self.encoding = tiktoken.Encoding("chat", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for piece, rank in ranks.items():
            self.sizes[rank] = len(piece)

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(ids, rows of start and end in code points); a token inside a character spans all of it."""
        ids = np.array(self.encoding.encode_ordinary(text), np.int32)
        ends = np.cumsum(self.sizes[ids])
        spans = np.column_stack([ends - self.sizes[ids], ends])
        if not text.isascii():
            seen = np.cumsum((np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80)
            spans = np.column_stack([seen[spans[:, 0]] - 1, seen[spans[:, 1] - 1]])
        return ids, spans


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def token_mask(offsets: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """Which tokens (sorted rows of start, end) meet one of the sorted, disjoint spans."""
    if not len(spans) or not len(offsets):
        return np.zeros(len(offsets), bool)
    k = np.searchsorted(spans[:, 1], offsets[:, 0], "right")  # first span that ends after the token begins
    inside = k < len(spans)
    return inside & (spans[np.minimum(k, len(spans) - 1), 0] < offsets[:, 1])


def masked_text(turns: list[tuple[str, str, int, int]], formatted: str, spans: np.ndarray) -> list[str]:
    """The texts of turns under masked token spans (sorted rows of start, end), unescaped: spans are merged and cut to the turns' texts."""
    if not len(spans):
        return []
    gap = np.flatnonzero(spans[1:, 0] > spans[:-1, 1])
    low, high = spans[np.r_[0, gap + 1], 0], spans[np.r_[gap, len(spans) - 1], 1]
    out = []
    for _, _, a, b in turns:
        first, last = np.searchsorted(high, a, "right"), np.searchsorted(low, b, "left")
        if first < last and b > a:
            out.append(unescaped("".join(formatted[max(a, x) : min(b, y)] for x, y in zip(low[first:last].tolist(), high[first:last].tolist(), strict=True))))
    return out


def format_conversations(turns: DataFrame, tokenizer: str = TOKENIZER, loss_role: str = LOSS_ROLE) -> DataFrame:
    """(conv_id, segment, formatted, ids, starts, ends, mask): one row a segment, one segment for most conversations.

    Segments of a conversation follow each other in one partition.
    """

    def run(batches):
        encode = encoder(tokenizer)
        parts, spans, size, segment, current = [], [], 0, 0, object()
        ready: list[tuple] = []

        def close():
            nonlocal parts, spans, size, segment
            if parts:
                ready.append((current, segment, "".join(parts), np.array(spans, np.int64).reshape(-1, 2)))
                segment += 1
            parts, spans, size = [], [], 0

        def flush():
            ids, spans, masks = [], [], []
            for *_, formatted, wanted in ready:
                tokens, offsets = encode.encode(formatted)
                ids.append(tokens)
                spans.append(offsets)
                masks.append(token_mask(offsets, wanted))
            at = pa.array(np.r_[0, np.cumsum([len(x) for x in ids])], pa.int32())
            every, span, mask = np.concatenate(ids), np.concatenate(spans).astype(np.int32), np.concatenate(masks)
            lists = [pa.ListArray.from_arrays(at, pa.array(x)) for x in (every, np.ascontiguousarray(span[:, 0]), np.ascontiguousarray(span[:, 1]), mask)]
            rows = [pa.array([r[0] for r in ready], pa.int64()), pa.array([r[1] for r in ready], pa.int32()), pa.array([r[2] for r in ready], pa.string())]
            ready.clear()
            return pa.RecordBatch.from_arrays([*rows, *lists], ["conv_id", "segment", "formatted", "ids", "starts", "ends", "mask"])

        started = False
        for batch in batches:
            for conv, role, text in zip(batch.column("conv_id").to_pylist(), batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if not started or conv != current:
                    if started:
                        close()
                    started, current, segment = True, conv, 0
                turn, a, b = rendered(role or "", text or "")
                if size and size + len(turn) > SEGMENT_CHARS:
                    close()
                if role == loss_role and b > a:
                    spans.append((size + a, size + b))
                parts.append(turn)
                size += len(turn)
                if len(ready) >= 256 or sum(len(r[2]) for r in ready[-8:]) > 4 * SEGMENT_CHARS:
                    yield flush()
        close()
        if ready:
            yield flush()

    turns = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(run, "conv_id long, segment int, formatted string, ids array<int>, starts array<int>, ends array<int>, mask array<boolean>")


def read_back(segments: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_tokens, n_loss_tokens), from the output alone.

    ``segments`` must come straight from ``format_conversations``: the segments of a conversation are read in their order.
    """

    def run(batches):
        current, state, out = None, None, []

        def done():
            conv, turns, all_text, loss_chars, loss, chars, tokens, masked = state
            out.append((conv, turns, all_text.hexdigest(), loss_chars, loss.hexdigest(), chars, tokens, masked))

        def table():
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens", "n_loss_tokens"]
            kinds = [pa.string() if n.endswith("sha256") else pa.int64() for n in names]
            columns = [pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            starts, ends, mask = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("starts", "ends", "mask"))
            at = np.r_[0, np.cumsum(batch.column("mask").value_lengths().to_numpy())]
            for k, (conv, segment, formatted) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("conv_id", "segment", "formatted")), strict=True)):
                if state is None or segment == 0 or conv != current:
                    if state is not None:
                        done()
                    current, state = conv, [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0]
                own = mask[at[k] : at[k + 1]]
                spans = np.column_stack([starts[at[k] : at[k + 1]][own], ends[at[k] : at[k + 1]][own]])
                turns = read_turns(formatted)
                state[1] += len(turns)
                state[2].update("".join(f"{role}\n{text}\n" for role, text, _, _ in turns).encode())
                for text in masked_text(turns, formatted, spans):
                    state[3] += len(text)
                    state[4].update(text.encode())
                state[5] += len(formatted)
                state[6] += len(own)
                state[7] += len(spans)
            if out:
                yield table()
        if state is not None:
            done()
            yield table()

    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, n_loss_tokens long"
    return segments.mapInArrow(run, schema)
