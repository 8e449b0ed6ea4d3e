"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked by a self-join of their binary trie.

A bit of a fingerprint is 1 if it is set in more than half of the hashes of a text's shingles (repeats count). Fingerprints
link at ``budget`` differing bits or fewer, and the components of the links are what the operator returns.

The join runs on the trie of the distinct fingerprints. Pairs of its nodes are traversed together from the same depth on: a pair
carries the bits in which its two prefixes differ, its children are the pairs of their children, and a pair whose bits exceed the budget is
pruned with all that lies below it. Two words of 64 bits that differ in 3 differ in 1 at most in one of their halves, so
there are two tries, the second with the halves exchanged, and above the middle only half the budget is allowed: each node then has some
dozens of partners instead of thousands.

The upper levels are DataFrames of node pairs: they begin where nodes have about UNIT fingerprints, and only pairs with crowded nodes
are opened further, STEP bits at a time, so no pair that is left has more than UNIT fingerprints on a side however alike the texts are.
What is left is shuffled by pair, and each pair is traversed to its leaves within a task over sorted arrays. A task returns a spanning
forest of its links (one edge a fingerprint at most), never all pairs. Texts are never shuffled; copies are one row from the first aggregation on.

Defined results: null, empty and blank texts have the fingerprint zero and link like any other. Repeated rows are copies. Rows without an id
get their component's smallest id like others (null if no row of it has one). Other columns are left out, whatever their names.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import NON_SPACE, slices, text_buffers
from .components import connected_components
from .keyed import looked_up
from .scratch import discard, materialize

BITS, HALF, SEED = 64, 32, 42
#: Fingerprints on one side of a node pair that is traversed within a task, bits by which a crowded pair is opened, and pairs tested at once.
UNIT, STEP, TESTED = 1024, 4, 1 << 20
#: Pairs of nodes are tested leaf by leaf once they hold so few pairs of fingerprints.
FEW = 16
_HASHED = 1 << 16
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] = _FOLD[0x61:0x7B]


def spaced(raw: np.ndarray, offsets: np.ndarray):
    """(bytes, start and end of every word in them, first word of each row): words in lower case, one space between those of a row."""
    inside = NON_SPACE[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets[offsets < len(raw)]] = True
    before = np.r_[False, inside[:-1]] & ~edge[:-1]
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~np.r_[inside[1:] & ~edge[1:-1], False]) + 1
    kept = inside | before
    at = np.cumsum(kept, dtype=np.int64)
    text = np.where(inside, _FOLD[raw], np.uint8(0x20))[kept].tobytes()
    return text, at[start] - 1, at[end - 1], np.searchsorted(start, offsets)


def shingle_spans(start: np.ndarray, end: np.ndarray, bounds: np.ndarray, width: int):
    """(row, first byte, last byte) of every shingle: ``width`` words in a row, or all words of a row that has fewer."""
    words = np.diff(bounds)
    row = np.repeat(np.arange(len(words)), np.where(words < width, words > 0, words - width + 1))
    place = np.arange(len(row)) - np.searchsorted(row, row)
    first = bounds[row] + place
    return row, start[first], end[first + np.minimum(width, words[row]) - 1]


def fingerprints_of(raw: np.ndarray, offsets: np.ndarray, width: int) -> np.ndarray:
    """The fingerprint (64 bits, unsigned) of every row of concatenated UTF-8 texts."""
    from xxhash import xxh64_intdigest

    text, start, end, bounds = spaced(raw, offsets)
    row, low, high = shingle_spans(start, end, bounds, width)
    ones = np.zeros((len(offsets) - 1, BITS), np.int64)
    for a in range(0, len(row), _HASHED):
        own = row[a : a + _HASHED]
        spans = zip(low[a : a + _HASHED].tolist(), high[a : a + _HASHED].tolist(), strict=True)
        hashed = np.fromiter((xxh64_intdigest(text[i:j], SEED) for i, j in spans), "<u8", len(own))
        bits = np.unpackbits(hashed.view(np.uint8), bitorder="little").reshape(-1, BITS)
        heads = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        ones[own[heads]] += np.add.reduceat(bits, heads, axis=0, dtype=np.int64)
    total = np.bincount(row, minlength=len(ones))
    return np.packbits(2 * ones > total[:, None], axis=1, bitorder="little").view("<u8").ravel()


def simhash(docs: DataFrame, width: int = 3, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, fingerprint) of every row; the fingerprint's 64 bits as a signed number."""

    def run(batches):
        for batch in batches:
            raw, offsets = text_buffers(batch.column(1))
            for first, last in slices(offsets):
                at = offsets[first : last + 1]
                found = fingerprints_of(raw[at[0] : at[-1]], at - at[0], width)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), pa.array(found.view(np.int64))], ["doc_id", "fingerprint"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, fingerprint long")


def allowed(depth: int, budget: int) -> int:
    """Differing bits that two prefixes of this length may have: half the budget up to the middle, where the other half must have the rest."""
    return budget // 2 if depth <= HALF else budget


@lru_cache(maxsize=64)
def _masks(bits: int, most: int) -> list[int]:
    """Numbers of so many bits, ``most`` of them set at most."""
    out = [0]
    for k in range(bits):
        out += [m | 1 << k for m in out if m.bit_count() < most]
    return sorted(out)


def _prefix(depth: int):
    return F.shiftrightunsigned("value", BITS - depth) if depth else F.lit(0).cast("long")


def _node_pairs(values: DataFrame, rows: int, budget: int) -> list[tuple[int, DataFrame]]:
    """(depth, pairs of nodes a <= b) of the trie of ``values``, such that no node has more than UNIT values and every link lies within a pair."""
    def nodes(depth: int, name: str) -> DataFrame:
        return values.groupBy(_prefix(depth).alias(name)).agg(F.count("*").alias(f"n_{name}"))

    def opened(sides: DataFrame, depth: int) -> DataFrame:
        """Pairs (a, b, bits) of nodes with their sizes: ``sides`` has a, b (a node that may not exist), the bits they differ in, and ``own`` where both orders of a pair come."""
        within = sides.filter((F.col("bits") <= allowed(depth, budget)) & (~F.col("own") | (F.col("a") <= F.col("b")))).drop("own")
        return materialize(within.join(nodes(depth, "b"), "b"), "nodes")

    depth = min((rows // UNIT).bit_length(), HALF)
    masks = F.array(*[F.lit(m).cast("long") for m in _masks(depth, allowed(depth, budget))])
    first = nodes(depth, "a").select("a", "n_a", F.explode(masks).alias("mask"))
    pairs = opened(first.select("a", "n_a", F.col("a").bitwiseXOR(F.col("mask")).alias("b"), F.bit_count("mask").alias("bits"), F.lit(True).alias("own")), depth)
    done = []
    while True:
        crowded = (F.col("n_a") > UNIT) | (F.col("n_b") > UNIT)
        done.append((depth, pairs.filter(~crowded).select("a", "b", "bits")))
        if depth == BITS or pairs.filter(crowded).isEmpty():
            return done
        step = min(STEP, HALF - depth) if depth < HALF else STEP
        live, depth = pairs.filter(crowded).select("a", "b", "bits"), depth + step
        masks = F.array(*[F.lit(m).cast("long") for m in _masks(step, budget)])
        below = nodes(depth, "child").select(F.shiftrightunsigned("child", step).alias("a"), "child", F.col("n_child").alias("n_a"))
        sides = live.join(below, "a").select("child", "n_a", "b", "bits", (F.col("a") == F.col("b")).alias("own"), F.explode(masks).alias("mask")).select(
            F.col("child").alias("a"), "n_a",
            F.shiftleft("b", step).bitwiseOR(F.col("child").bitwiseAND(F.lit((1 << step) - 1)).bitwiseXOR(F.col("mask"))).alias("b"),
            (F.col("bits") + F.bit_count("mask")).alias("bits"), "own",
        )
        pairs = opened(sides, depth)


def linked_leaves(a: np.ndarray, b: np.ndarray | None, depth: int, differing: int, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) of the links between two sorted arrays of leaves (or within one, i < j): two nodes of ``depth`` traversed together."""
    same = b is None
    b = a if same else b
    at = np.array([[0, len(a), 0, len(b), differing]], np.int64)
    left, right = [], []
    while len(at):
        few = ((at[:, 1] - at[:, 0]) * (at[:, 3] - at[:, 2]) <= FEW) | (depth == BITS)
        small, at = at[few], at[~few]
        while len(small):
            size = (small[:, 1] - small[:, 0]) * (small[:, 3] - small[:, 2])
            some = max(int(np.searchsorted(np.cumsum(size), TESTED, "right")), 1)
            now, small, size = small[:some], small[some:], size[:some]
            pair = np.repeat(np.arange(len(now)), size)
            k = np.arange(len(pair)) - np.repeat(np.cumsum(size) - size, size)
            wide = (now[:, 3] - now[:, 2])[pair]
            i, j = now[pair, 0] + k // wide, now[pair, 2] + k % wide
            near = np.bitwise_count(a[i] ^ b[j]) <= budget
            near &= (i < j) if same else True
            left.append(i[near])
            right.append(j[near])
        if not len(at):
            break
        shift = np.uint64(BITS - 1 - depth)
        zero = [np.r_[0, np.cumsum((x >> shift) & np.uint64(1) == 0)] for x in (a, b)]
        mid_a = at[:, 0] + zero[0][at[:, 1]] - zero[0][at[:, 0]]
        mid_b = at[:, 2] + zero[1][at[:, 3]] - zero[1][at[:, 2]]
        a0, a1, b0, b1 = (at[:, 0], mid_a), (mid_a, at[:, 1]), (at[:, 2], mid_b), (mid_b, at[:, 3])
        kids = [np.column_stack([*x, *y, at[:, 4] + more]) for x, y, more in ((a0, b0, 0), (a1, b1, 0), (a0, b1, 1), (a1, b0, 1))]
        if same:  # of a node with itself, the pair of its two children comes once
            kids[3] = kids[3][(at[:, 0] != at[:, 2]) | (at[:, 1] != at[:, 3])]
        at = np.concatenate(kids)
        depth += 1
        at = at[(at[:, 0] < at[:, 1]) & (at[:, 2] < at[:, 3]) & (at[:, 4] <= allowed(depth, budget))]
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of ``n`` rows the least row that it is linked with, directly or not."""
    root = np.arange(n)
    while True:
        least = np.minimum(root[i], root[j])
        was = root.copy()
        np.minimum.at(root, root[i], least)
        np.minimum.at(root, root[j], least)
        while (further := root[root] != root).any():
            root[further] = root[root[further]]
        if (root == was).all():
            return root


def _traverse(budget: int):
    def run(part: pd.DataFrame) -> pd.DataFrame:
        head = part.iloc[0]
        value = np.sort(part["value"].to_numpy().astype(np.int64).view(np.uint64))
        depth, a, b = int(head["depth"]), int(head["a"]), int(head["b"])
        cut = len(value) if a == b else int(np.searchsorted(value, np.uint64(b << (BITS - depth))))  # those of a come before those of b
        i, j = linked_leaves(value[:cut], None if a == b else value[cut:], depth, int(head["bits"]), budget)
        root = forest(len(value), i, j + (0 if a == b else cut))
        linked = np.flatnonzero(root != np.arange(len(root)))
        return pd.DataFrame({"left": value[linked].view(np.int64), "right": value[root[linked]].view(np.int64)})

    return run


def fingerprint_links(classes: DataFrame, budget: int = 3) -> DataFrame:
    """(left, right): edges between distinct ``fingerprint`` values with the components of all links of ``budget`` bits or fewer."""
    rows, found = classes.count(), None
    for turned in (False, True):
        swapped = F.shiftleft("fingerprint", HALF).bitwiseOR(F.shiftrightunsigned("fingerprint", HALF))
        values = classes.select((swapped if turned else F.col("fingerprint")).alias("value"))
        for depth, pairs in _node_pairs(values, rows, budget):
            back = lambda c, name: (F.shiftleft(c, HALF).bitwiseOR(F.shiftrightunsigned(c, HALF)) if turned else F.col(c)).alias(name)  # noqa: B023, E731
            if depth == BITS:  # leaves: what is left of the pairs are links
                links = pairs.filter("a <> b").select(back("a", "left"), back("b", "right"))
                found = links if found is None else found.union(links)
                continue
            ends = pairs.select("a", "b", "bits", F.explode(F.array_distinct(F.array("a", "b"))).alias("node"))
            units = values.withColumn("node", _prefix(depth)).join(ends, "node").withColumn("depth", F.lit(depth))
            links = units.groupBy("a", "b").applyInPandas(_traverse(budget), "left long, right long")
            links = links.select(back("left", "left"), back("right", "right"))
            found = links if found is None else found.union(links)
    return found


def simhash_components(docs: DataFrame, width: int = 3, budget: int = 3, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of ``docs``; ``component_id`` is the smallest id reachable by links."""
    if not 0 <= budget < HALF:
        raise ValueError("the budget of differing bits must be from 0 to 31")
    prints = materialize(simhash(docs, width, text, key), "fingerprints")
    classes = materialize(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least")), "classes")
    edges = materialize(fingerprint_links(classes, budget), "links")
    roots = materialize(connected_components(edges, "left", "right").withColumnRenamed("node", "fingerprint"), "roots")
    discard(edges)
    smallest = classes.join(roots, "fingerprint").groupBy("root").agg(F.min("least").alias("component_id"))
    named = looked_up(roots, smallest, "root").select("fingerprint", "component_id", F.lit(True).alias("linked"))
    ids = classes.join(named, "fingerprint", "left").select("fingerprint", F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("least")).alias("component_id"))
    return looked_up(prints, materialize(ids, "components"), "fingerprint").select("doc_id", "fingerprint", "component_id")
