"""Toxicity scores: a weighted lexicon matched by Aho-Corasick over folded text, with exception phrases.

Folding lower-cases, replaces look-alike letters of other scripts, drops invisible characters, reads digits and
signs inside words as the letters they stand for, and merges ``l`` with ``i`` (``1`` stands for either). Entries are
whole words or beginnings of words; their weights are log-odds learned from labelled texts. A hit inside an
exception phrase does not count: some phrases are given, others are learned (a hit with its next word, seen in clean texts
only). The hits' weights, as a sum and normalised by length, go through a logistic curve fitted on other labelled
texts than the lexicon.

About ``MAX_TRAIN_ROWS`` labelled rows are learned from, so the lexicon is bounded by ``SUPPORT`` and ``SHARE``: an entry is in one of 200 toxic
ones at least. Null, empty and hitless texts score alike, low. Without toxic labels every text scores 0. Repeated rows score alike, null ids
like others; a text counts whole, however long. A column ``score`` is replaced, other columns are kept.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .labelled import training_rows
from .scratch import materialize

MAX_TRAIN_ROWS = 20_000
#: An entry was seen in so many toxic texts, or one in so many of them if that is more, and has these log-odds at least.
SUPPORT, SHARE, LEAST_ODDS = 5, 200, 2.8
PREFIXES = range(3, 9)
EXCEPTIONS = ("trash can", "trash cans", "trash bin", "trash bag", "clown fish", "pond scum", "idiot proof")

#: Letters of other scripts that look like Latin ones, Latin equivalents in the same order.
_ALIKE = str.maketrans("аеорсухкіјѕԁһԛѡвмнтгαορντικυχеο", "aeopcyxkijsdhqwbmhtraopvtikuxeo")
_INVISIBLE = dict.fromkeys([0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF])
_FULLWIDTH = {0xFF01 + i: 0x21 + i for i in range(94)}
_LETTERS = str.maketrans("0134578@$!|l", "oieastbasiii")
_INNER = re.compile(r"[0134578@$!|]+(?=[^\W\d_])|(?<=[^\W\d_])[0134578]+(?![\w])")
_BREAK = re.compile(r"[\W\d_]+")
_TABLE = {**_INVISIBLE, **_FULLWIDTH, **_ALIKE, ord("l"): "i"}


def folded(text: str | None) -> str:
    """Folded words, one space between, before and after."""
    text = (text or "").casefold().translate(_TABLE)
    text = _INNER.sub(lambda m: m[0].translate(_LETTERS), text)
    return f" {_BREAK.sub(' ', text).strip()} "


def _entries(words: set[str]) -> set[str]:
    out = {f" {w} " for w in words if len(w) >= 3}
    for w in words:
        out.update(f" {w[:n]}" for n in PREFIXES if n < len(w))
    return out


@dataclass
class Lexicon:
    weights: dict[str, float]
    exceptions: list[str] = field(default_factory=list)
    curve: np.ndarray = field(default_factory=lambda: np.array([-50.0, 0, 0, 0]))
    _automaton: object = None

    def __getstate__(self):
        return {**self.__dict__, "_automaton": None}

    def automaton(self):
        if self._automaton is None:
            import ahocorasick

            a = ahocorasick.Automaton()
            for entry, weight in self.weights.items():
                a.add_word(entry, (len(entry), weight))
            for phrase in self.exceptions:
                a.add_word(phrase, (len(phrase), None))
            if len(a):
                a.make_automaton()
            self._automaton = a
        return self._automaton

    def hits(self, text: str) -> dict[int, float]:
        """Largest weight by position of the word's leading space, outside exception phrases."""
        found: dict[int, float] = {}
        excepted: list[tuple[int, int]] = []
        automaton = self.automaton()
        for end, (length, weight) in automaton.iter(text) if len(automaton) else ():
            start = end - length + 1
            if weight is None:
                excepted.append((start, end))
            elif weight > found.get(start, 0):
                found[start] = weight
        if not excepted:
            return found
        # one sweep over places and phrases in order
        covered, phrases, reach, k = set(), sorted(excepted), 0, 0
        for at in sorted(found):
            while k < len(phrases) and phrases[k][0] <= at:
                reach, k = max(reach, phrases[k][1]), k + 1
            if at < reach:
                covered.add(at)
        return {at: weight for at, weight in found.items() if at not in covered}

    def vector(self, text: str | None) -> tuple[float, float, float, float]:
        text = folded(text)
        total = sum(self.hits(text).values())
        words = text.count(" ")
        return 1.0, float(np.log1p(total)), float(np.log1p(20 * total / words)), float(total > 0)

    def scores(self, texts) -> np.ndarray:
        x = np.array([self.vector(t) for t in texts], float).reshape(-1, 4)
        return 1 / (1 + np.exp(-np.clip(x @ self.curve, -50, 50)))


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.1) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty * np.eye(len(w)), x.T @ (y - p) - penalty * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _counted(rows: DataFrame, entries_of) -> DataFrame:
    """(entry, texts) over all rows: counted in each batch, then summed."""

    def count(batches):
        for batch in batches:
            texts = batch.column(0)
            for first in range(0, len(texts), 500):
                seen: Counter[str] = Counter()
                for t in texts.slice(first, 500).to_pylist():
                    seen.update(entries_of(folded(t)))
                yield pa.RecordBatch.from_pydict({"entry": pa.array(list(seen), pa.string()), "texts": pa.array(list(seen.values()), pa.int64())})

    return rows.select("text").mapInArrow(count, "entry string, texts long").groupBy("entry").agg(F.sum("texts").alias("texts"))


def train_toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS, exceptions: tuple[str, ...] = EXCEPTIONS) -> Lexicon:
    """Lexicon and exceptions from folds 1 to 3, the curve from fold 4; fold 0 stays held out."""
    spark = docs.sparkSession
    rows = materialize(training_rows(docs, labels, "toxic", max_rows), "toxicity")
    learn = rows.filter("fold <= 3")
    n_clean, n_toxic = (learn.filter(f"label = {k}").count() for k in (0, 1))
    fixed = [folded(e) for e in exceptions]
    if not n_clean or not n_toxic:
        return Lexicon({}, fixed)
    seen = _counted(learn.filter("label = 1"), lambda t: _entries(set(t.split())))
    toxic = {r["entry"]: r["texts"] for r in seen.filter(F.col("texts") >= max(SUPPORT, n_toxic // SHARE)).collect()}
    wanted = spark.sparkContext.broadcast(set(toxic))
    clean = {r["entry"]: r["texts"] for r in _counted(learn.filter("label = 0"), lambda t: _entries(set(t.split())) & wanted.value).collect()}
    weights = {}
    for entry, n in toxic.items():
        odds = np.log((n + 0.5) / (n_toxic + 1)) - np.log((clean.get(entry, 0) + 0.5) / (n_clean + 1))
        if odds >= LEAST_ODDS:
            weights[entry] = float(odds)
    lexicon = Lexicon(weights, fixed)
    shared = spark.sparkContext.broadcast(lexicon)

    def phrases(text: str) -> set[str]:
        words = text.split()
        starts = dict(zip(np.r_[0, np.cumsum([len(w) + 1 for w in words])].tolist(), range(len(words)), strict=False))
        return {f" {words[starts[at]]} {words[starts[at] + 1]} " for at in shared.value.hits(text) if at in starts and starts[at] + 1 < len(words)}

    harmless = {r["entry"]: r["texts"] for r in _counted(learn.filter("label = 0"), phrases).filter("texts >= 3").collect()}
    if harmless:
        meant = {r["entry"] for r in _counted(learn.filter("label = 1"), lambda t: phrases(t) & set(harmless)).collect()}
        lexicon = Lexicon(weights, fixed + sorted(set(harmless) - meant))
        shared = spark.sparkContext.broadcast(lexicon)

    def vectors(batches):
        for batch in batches:
            x = [list(shared.value.vector(t)) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column(1)], ["x", "label"])

    got = rows.filter("fold = 4").select("text", "label").mapInArrow(vectors, "x array<double>, label int").collect()
    if len({r["label"] for r in got}) == 2:
        x = np.array(sorted([*r["x"], r["label"]] for r in got))
        lexicon.curve = _logistic(x[:, :4], x[:, 4])
    else:  # no other texts to fit on: half a chance at one strong hit in twenty words
        lexicon.curve = np.array([-4.0, 1.0, 1.0, 1.0])
    return lexicon


def toxicity_score(lexicon: Lexicon, spark, text: str = "text") -> Column:
    shared = spark.sparkContext.broadcast(lexicon)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.scores(texts))

    return score(F.col(text))


def score_toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS) -> DataFrame:
    """``docs`` with ``score``; lexicon and curve are trained on ``labels`` first."""
    return docs.withColumn("score", toxicity_score(train_toxicity(docs, labels, max_rows), docs.sparkSession))
