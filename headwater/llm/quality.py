"""Quality classifier: Bradley-Terry scores learned from preference pairs, cut at a quantile.

Every text becomes a vector of counts and ratios over its bytes, words and lines. Pairs of a good and a bad
labelled text state preferences; logistic loss on the difference of their vectors gives the weights, so a
document's strength is a weighted sum. The cut is the quantile of training strengths that tells the labels apart
best; strengths are mapped to 0..1 so that the cut lies at ``CUT``.

About ``MAX_TRAIN_ROWS`` labelled rows are learned from, by ``PAIRS`` pairs drawn from them. Null, empty and wordless texts have the
zero vector's score. Labels of one kind only (or none) give every text the score ``CUT``, so nothing is rejected. Repeated rows score
alike, null ids like others; a column ``score`` is replaced, other columns are kept.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytewords import NON_SPACE, byte_class, slices, text_buffers, words_of
from .labelled import training_rows

MAX_TRAIN_ROWS = 20_000
PAIRS = 60_000
CUT = 0.3
#: Bytes of text whose counts are held at a time.
SLICE = 1 << 18

_CLASSES = [
    byte_class(lambda b: 0x41 <= b <= 0x5A), byte_class(lambda b: 0x61 <= b <= 0x7A), byte_class(lambda b: 0x30 <= b <= 0x39),
    byte_class(lambda b: b >= 0x80), byte_class(lambda b: b in b" \t\r\x0b\x0c"), byte_class(lambda b: b == 10),
    byte_class(lambda b: b in b".!?"), byte_class(lambda b: b in b",;:"), byte_class(lambda b: b in b"|"),
    byte_class(lambda b: b in b"#$%&*@^~"), byte_class(lambda b: b in b"!"), byte_class(lambda b: b in b"<>{}[]()=/\\_+"),
    byte_class(lambda b: b in b"\"'`-"), byte_class(lambda b: b < 32 and b not in b"\t\n\r\x0b\x0c"),
]
_LINE = byte_class(lambda b: b != 10)
N_FEATURES = len(_CLASSES) + 13


def _per_row(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.r_[0, np.cumsum(values, dtype=np.float64)]
    return total[bounds[1:]] - total[bounds[:-1]]


def _repeats(hashed: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per row: distinct values, and the most frequent one's count."""
    rows = len(bounds) - 1
    if not len(hashed):
        return np.zeros(rows), np.zeros(rows)
    row = np.repeat(np.arange(rows), np.diff(bounds))
    order = np.lexsort((hashed, row))
    r, h = row[order], hashed[order]
    first = np.flatnonzero(np.r_[True, (r[1:] != r[:-1]) | (h[1:] != h[:-1])])
    most = np.zeros(rows)
    np.maximum.at(most, r[first], np.diff(np.r_[first, len(h)]))
    return np.bincount(r[first], minlength=rows).astype(float), most


def features(column: pa.Array) -> np.ndarray:
    """One row of N_FEATURES numbers per text."""
    raw_all, offsets_all = text_buffers(column)
    out = [np.zeros((0, N_FEATURES))]
    for first, last in slices(offsets_all, SLICE):
        at = offsets_all[first : last + 1] - offsets_all[first]
        raw = raw_all[offsets_all[first] : offsets_all[last]]
        start, end, hashed, bounds = words_of(raw, at, NON_SPACE)
        n_bytes, n_words = np.diff(at), np.diff(bounds).astype(float)
        sums = [np.r_[0, np.cumsum(c[raw], dtype=np.int32)] for c in _CLASSES]
        shares = [(s[at[1:]] - s[at[:-1]]) / np.maximum(n_bytes, 1) for s in sums]
        in_word = [s[end] - s[start] for s in sums]
        length = (end - start).astype(float)
        letters = in_word[0] + in_word[1] + in_word[3]
        of_words = lambda mask: _per_row(mask, bounds) / np.maximum(n_words, 1)  # noqa: E731, B023
        distinct, most = _repeats(hashed, bounds)
        gram = hashed[:-2] * np.uint64(3) + hashed[1:-1] * np.uint64(5) + hashed[2:] * np.uint64(7) if len(hashed) > 2 else hashed[:0]
        # a row's grams end two words before it does; those that run into the next row are left out
        owner = np.searchsorted(bounds, np.arange(len(gram)), "right") - 1
        own = np.arange(len(gram)) + 2 < bounds[owner + 1]
        grams, _ = _repeats(gram[own], np.r_[0, np.cumsum(np.bincount(owner[own], minlength=len(bounds) - 1))])
        _, _, lines, line_bounds = words_of(raw, at, _LINE)
        n_lines = np.diff(line_bounds).astype(float)
        whole_lines, _ = _repeats(lines, line_bounds)
        mean = of_words(length)
        more = [
            np.log1p(n_bytes), np.log1p(n_words), mean, np.sqrt(np.maximum(of_words(length**2) - mean**2, 0)),
            of_words((in_word[0] == letters) & (letters > 1)), of_words(letters == 0), of_words(letters < length),
            of_words(length <= 3), np.where(n_words > 0, distinct / np.maximum(n_words, 1), 1), most / np.maximum(n_words, 1),
            np.where(n_words > 2, np.minimum(grams / np.maximum(n_words - 2, 1), 1), 1),
            np.where(n_lines > 0, whole_lines / np.maximum(n_lines, 1), 1), np.log1p(n_words / np.maximum(n_lines, 1)),
        ]
        out.append(np.column_stack(shares + more) * (n_words > 0)[:, None])
    return np.concatenate(out)


@dataclass
class BradleyTerry:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float
    spread: float

    def _strength(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return (np.hstack([z, z * z]) * self.weights).sum(1)  # row by row, so equal texts score alike to the last bit

    def score(self, x: np.ndarray) -> np.ndarray:
        """0..1, ``CUT`` at the cut."""
        z = (self._strength(x) - self.cut) / self.spread + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(x: np.ndarray, label: np.ndarray, pairs: int = PAIRS, penalty: float = 1.0, rounds: int = 25) -> BradleyTerry:
    """Newton steps on the logistic loss of feature differences of (good, bad) pairs."""
    mean, scale = (x.mean(0), x.std(0) + 1e-6) if len(x) else (np.zeros(N_FEATURES), np.ones(N_FEATURES))
    model = BradleyTerry(mean, scale, np.zeros(2 * N_FEATURES), 0.0, 1.0)
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    if not len(good) or not len(bad):
        return model
    rng = np.random.default_rng(0)
    z = np.clip((x - mean) / scale, -6, 6)
    z = np.hstack([z, z * z])
    d = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]
    for _ in range(rounds):
        p = 1 / (1 + np.exp(np.clip(d @ model.weights, -40, 40)))
        grad = d.T @ p - penalty * model.weights
        hess = (d * (p * (1 - p))[:, None]).T @ d + penalty * np.eye(d.shape[1])
        step = np.linalg.solve(hess, grad)
        model.weights = model.weights + step
        if np.abs(step).max() < 1e-6:
            break
    s = model._strength(x)
    levels = np.unique(np.quantile(s, np.linspace(0, 1, 401)))
    gain = np.array([(s[good] >= c).mean() + (s[bad] < c).mean() for c in levels])
    best = np.flatnonzero(gain >= gain.max() - 1e-12)
    model.cut = float((levels[best[0]] + levels[max(best[0] - 1, 0)]) / 2)
    model.spread = float(max(np.std(s) / 4, 1e-6))
    return model


def train_quality(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS) -> BradleyTerry:
    """Fit on labelled rows outside the held-out fold; only their feature vectors reach the driver."""

    def vectors(batches):
        for batch in batches:
            x = features(batch.column(0))
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), batch.column(1)], ["x", "label"])

    rows = training_rows(docs, labels, "quality", max_rows).select("text", "label").mapInArrow(vectors, "x array<double>, label int").collect()
    x = np.array([r["x"] for r in rows], float).reshape(-1, N_FEATURES)
    order = np.lexsort(x.T)
    return fit(x[order], np.array([r["label"] for r in rows], int)[order])


def quality_score(model: BradleyTerry, text: str = "text") -> Column:
    """The score of each text, 0 to 1."""

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(model.score(features(texts)))

    return score(F.col(text))


def score_quality(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS) -> DataFrame:
    """``docs`` with ``score``; the model is trained on ``labels`` first."""
    return docs.withColumn("score", quality_score(train_quality(docs, labels, max_rows)))
