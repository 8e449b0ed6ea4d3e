"""Feature collections read by many tasks: the one JSON value of a GeoJSON document, cut into its features wherever a split begins.

Spark's text source cuts the file behind every ``}`` and hands out its splits. What state a split begins in is not known to its task, so a first pass
finds for each split how it changes the state from outside and from inside a string: quotes passed and brackets opened less closed, counted outside strings.
Running over these few rows (one a split) gives each split its true beginning. A second pass finds the last member name and bracket at
the top, in the few pieces that come up there, and a third one puts out the features: a piece that ends two levels deep in ``features`` ends one. Features that go
over a split's border come in parts, which are joined behind it. Everything outside features is a small document of its own.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_TOKEN = re.compile(r'\\.|["{}\[\]]', re.S)
_ESCAPE = re.compile(r"\\.", re.S)
#: Parts of features, and what lies outside of them.
WHOLE, HEAD, MIDDLE, TAIL, REST = range(5)


@dataclass
class State:
    """Where a place of the document lies: inside a string, how deep, and which member and bracket lead down from the top."""

    inside: bool = False
    depth: int = 0
    member: str = ""
    bracket: str = ""
    #: What has come of the string that a piece ends in; a split that begins in one does not know its beginning.
    string: str = "\0"

    @property
    def among_features(self) -> bool:
        return self.member == "features" and self.bracket == "["


def _change(text: str, inside: bool, closed: bool) -> tuple[bool, int]:
    """(inside a string after a piece?, brackets opened less closed): a ``}`` stands behind the piece if it is ``closed``."""
    if "\\" in text:
        text = _ESCAPE.sub("", text)
    parts = text.split('"')
    depth = sum(p.count("{") + p.count("[") - p.count("}") - p.count("]") for p in parts[int(inside) :: 2])
    inside ^= len(parts) % 2 == 0
    return inside, depth - (closed and not inside)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", "}").text(path).select("value", F.col("_metadata.file_block_start").alias("split"))


def _by_split(batches) -> Iterator[tuple[int, Iterator[str]]]:
    """(split, its pieces) one after the other."""
    held: list = []

    def rows():
        for batch in batches:
            yield from zip(batch.column("split").to_pylist(), batch.column("value").to_pylist(), strict=True)

    stream = rows()
    first = next(stream, None)
    while first is not None:
        split, held = first[0], [first]

        def own(split=split):
            nonlocal first
            yield held.pop()[1]
            for row in stream:
                if row[0] != split:
                    first = row
                    return
                yield row[1]
            first = None

        yield split, own()


def _changes(pieces: DataFrame) -> list:
    """Of each split: where it ends from outside and from inside a string."""

    def run(batches):
        for split, texts in _by_split(batches):
            ends = [[False, 0], [True, 0]]
            for text in texts:
                for end in ends:
                    end[0], more = _change(text, end[0], True)
                    end[1] += more
            yield pa.RecordBatch.from_pydict({"split": [split], "from_out": [ends[0][0]], "depth_out": [ends[0][1]], "from_in": [ends[1][0]], "depth_in": [ends[1][1]]})

    return pieces.mapInArrow(run, "split long, from_out boolean, depth_out long, from_in boolean, depth_in long").orderBy("split").collect()


def _walk(text: str, state: State, rest: list[str] | None = None) -> int:
    """Go through a piece with its ``}``, a bracket at a time; returns where the last feature in it begins (-1: none does).

    ``rest`` gets the document outside features, of which values that lie more than two levels deep are 0.
    """
    kept = lambda: state.depth == 1 or (state.depth == 2 and not state.among_features)
    begins, opened, named = -1, -1, state.member
    shown = 0 if kept() else None
    text += "}"
    for token in _TOKEN.finditer(text):
        mark, at = token[0], token.start()
        if mark == '"':
            state.inside = not state.inside
            if state.inside:
                state.string, opened = "", at
            elif state.depth == 1:
                named = state.string + text[opened + 1 : at]
        elif state.inside or len(mark) > 1:
            continue
        elif mark in "{[":
            state.depth += 1
            if state.depth == 2:
                state.member, state.bracket = named, mark
            if state.depth == 3 and state.among_features and mark == "{":
                begins = at
            if state.depth == 1:
                shown = at
            elif shown is not None and not kept():
                if rest is not None:
                    rest.append(text[shown : at + 1] if state.depth == 2 else text[shown:at] + "0")
                shown = None
        else:
            was, state.depth = shown, state.depth - 1
            if state.depth == 0 and was is not None and rest is not None:
                rest.append(text[was : at + 1])
            shown = None if state.depth < 1 else was if was is not None else at + (state.depth > 1) if kept() else None
    if state.inside and state.depth == 1:
        state.string += text[opened + 1 :]
    if shown is not None and rest is not None:
        rest.append(text[shown:])
    return begins


def _deep(text: str, state: State) -> bool:
    """Does a piece stay among the features from its beginning to its end?"""
    return state.among_features and state.depth >= 3 and state.depth - text.count("]") - 1 >= 2


def _tops(pieces: DataFrame, begins: dict[int, State]) -> list:
    """Of each split: the last member and bracket that lead down from the top in it, null if none do."""

    def run(batches):
        for split, texts in _by_split(batches):
            state = replace(begins[split], member="", bracket="")
            for text in texts:
                inside, depth = _change(text, state.inside, True)
                if state.depth - text.count("]") - 1 >= 2 and not (state.depth < 3 and "{" in text and not state.bracket):
                    state.inside, state.depth = inside, state.depth + depth
                else:
                    _walk(text, state)
            yield pa.RecordBatch.from_pydict({"split": [split], "member": pa.array([state.member if state.bracket else None], pa.string()), "bracket": pa.array([state.bracket or None], pa.string())})

    return pieces.mapInArrow(run, "split long, member string, bracket string").orderBy("split").collect()


def _parts(pieces: DataFrame, begins: dict[int, State]) -> DataFrame:
    """(split, place, kind, text): whole features, parts of those that go over a border, and what lies outside."""

    def run(batches):
        for split, texts in _by_split(batches):
            state, rest, held, place = replace(begins[split]), [], [], 0
            started = False
            within = state.among_features and state.depth >= 3  # the split begins in a feature
            out: list[tuple] = []
            for text in texts:
                if _deep(text, state) and within:
                    inside, depth = _change(text, state.inside, True)
                    state.inside, state.depth = inside, state.depth + depth
                    held.append(text + "}")
                else:
                    among = state.among_features and state.depth >= 3
                    first = _walk(text, state, rest)
                    if first >= 0:
                        held, started, within = [(text + "}")[first:]], True, True
                    elif among and within:
                        held.append(text + "}")
                if within and not state.inside and state.depth == 2 and state.among_features:
                    out.append((split, place, WHOLE if started else TAIL, "".join(held)))
                    held, started, within, place = [], False, False, place + 1
                    if len(out) >= 1000:
                        yield _table(out)
            if held:
                out.append((split, place, HEAD if started else MIDDLE, "".join(held)))
            out.append((split, -1, REST, "".join(rest)))
            yield _table(out)

    return pieces.mapInArrow(run, "split long, place long, kind int, text string")


def _table(out: list[tuple]) -> pa.RecordBatch:
    split, place, kind, text = zip(*out, strict=True)
    out.clear()
    return pa.RecordBatch.from_arrays([pa.array(split, pa.int64()), pa.array(place, pa.int64()), pa.array(kind, pa.int32()), pa.array(text, pa.string())], ["split", "place", "kind", "text"])


def collection(spark: SparkSession, path: str) -> tuple[dict | None, DataFrame]:
    """(the document without its features, rows (ord, feature)) of a feature collection; (None, ...) for a document that is none."""
    from headwater.plans.lineage import cut

    pieces = _pieces(spark, path)
    begins, state = {}, State()
    for r in _changes(pieces):
        begins[r["split"]] = replace(state)
        inside, depth = (r["from_in"], r["depth_in"]) if state.inside else (r["from_out"], r["depth_out"])
        state = State(inside, state.depth + depth)
    member = bracket = ""
    for r in _tops(pieces, begins):
        begins[r["split"]].member, begins[r["split"]].bracket = member, bracket
        if r["bracket"]:
            member, bracket = r["member"], r["bracket"]
    parts = cut(_parts(pieces, begins))
    rest = "".join(r["text"] for r in parts.filter(F.col("kind") == REST).orderBy("split").collect())
    try:
        document = json.loads(rest)
    except ValueError:
        document = None
    # one part or two a split: joined to whole features behind the split that each begins in
    pieces_of = parts.filter(F.col("kind").isin(HEAD, MIDDLE, TAIL))
    chain = Window.orderBy("split", "place")
    named = pieces_of.withColumn("head", F.sum((F.col("kind") == HEAD).cast("int")).over(chain))
    joined = named.groupBy("head").agg(F.min(F.struct("split", "place")).alias("at"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("split", "place", "text"))), lambda p: p["text"]), "").alias("text"))
    every = parts.filter(F.col("kind") == WHOLE).select("split", "place", "text").unionByName(joined.select("at.split", "at.place", "text"))
    counts = every.groupBy("split").agg(F.count("*").alias("n"), F.min("place").alias("low"))
    offsets = counts.select("split", "low", (F.sum("n").over(Window.orderBy("split")) - F.col("n")).alias("offset"))
    return document, every.join(offsets, "split").select((F.col("offset") + F.col("place") - F.col("low")).alias("ord"), F.col("text").alias("feature"))
