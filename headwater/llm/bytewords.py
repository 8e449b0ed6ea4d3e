"""Word scanning over Arrow text buffers with numpy: spans and 64-bit hashes of every word, no Python string per word.

Texts are UTF-8 bytes. A word is a maximal run of bytes of a given class; ASCII letters are
lower-cased while hashing. Rows are handled in slices of bounded bytes, so memory does not
follow the Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
PLACES = 128
_BASE, _ODD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)


def byte_class(member) -> np.ndarray:
    return np.array([bool(member(b)) for b in range(256)])


#: Runs of anything but ASCII white space (0x20, 0x09-0x0D).
NON_SPACE = byte_class(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
#: Digits, ASCII letters and everything outside ASCII.
ALNUM = byte_class(lambda b: b >= 0x80 or 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (splitmix64)."""
    x = np.asarray(x, dtype=np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=2)
def _place_codes(fold: bool) -> np.ndarray:
    """A random number for each byte at each of the first PLACES places of a word."""
    codes = placed(np.arange(PLACES, dtype=np.uint64)[:, None], np.arange(256, dtype=np.uint64))
    if fold:
        codes[:, 0x41:0x5B] = codes[:, 0x61:0x7B]
    return codes.ravel()


def placed(place: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """A random number for a symbol at a place of its word. Sums of these tell words apart whatever their form, unlike polynomials modulo 2**64."""
    return mix(mix(place * _BASE + np.uint64(1)) + (symbol + np.uint64(1)) * _ODD)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, row offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if offsets else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes each, one row at least."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(max(last, first + 1), rows)
        yield first, last
        first = last


def words_of(raw: np.ndarray, offsets: np.ndarray, member: np.ndarray, fold: bool = True):
    """(start, end, hash) of every word and the first word of each row, over concatenated rows."""
    n = len(raw)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = member[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cuts = offsets[:-1][offsets[:-1] < n]
    first[cuts] = inside[cuts]
    cuts = cuts[cuts > 0] - 1
    last[cuts] = inside[cuts]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    length = end - start
    heads = np.r_[0, start]
    place = np.arange(n, dtype=np.int32) - np.repeat(heads, np.diff(np.r_[heads, n])).astype(np.int32)
    codes = _place_codes(fold)[(np.minimum(place, PLACES - 1) << 8) + raw]
    if len(length) and length.max() > PLACES:
        far = np.flatnonzero((place >= PLACES) & inside)
        symbol = raw[far].astype(np.uint64)
        symbol[(symbol >= 0x41) & (symbol <= 0x5A) & fold] += np.uint64(32)
        codes[far] = placed(place[far].astype(np.uint64), symbol)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(codes, out=total[1:])
    hashed = mix(total[end] - total[start] + length.astype(np.uint64))
    return start, end, hashed, np.searchsorted(start, offsets)


def shingles_of(hashed: np.ndarray, width: int) -> np.ndarray:
    """Distinct shingles of one text's word hashes, ascending; fewer words than ``width`` make one shingle."""
    if len(hashed) == 0:
        return np.zeros(0, np.uint64)
    span = min(width, len(hashed))
    total = np.full(len(hashed) - span + 1, span, np.uint64)
    for i in range(span):
        total = mix(total * _BASE + hashed[i : len(hashed) - span + 1 + i])
    return np.unique(total)
