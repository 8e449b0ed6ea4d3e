"""Secret scans in DataFrame functions only: fixed patterns, plus character Markov models.

Base spans come from three patterns. Further spans are long runs of token characters outside them whose
log-likelihood ratio between two first-order character models is high: one model of random strings, one of
ordinary identifiers. Both are trained from the corpus: values that the patterns capture are the labelled random
strings, other tokens of the same rows the ordinary ones (but for long mixtures of letters and digits). About ``MAX_TRAIN_ROWS`` rows,
picked by hash, are learned from; every row is scanned. The model is a table of 67 by 67 ratios, whatever the corpus.

Null or empty texts have no spans. Offsets are code points, end exclusive. Rows are scanned one by one: repeated rows alike, null ids
like others, other columns kept. The work on a text grows with its length.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .labelled import picked

MAX_TRAIN_ROWS = 20_000
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
CANDIDATE = "(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
#: Natural log of how much likelier "random" must be than "ordinary" over the whole token.
THRESHOLD = 12.0

_ANY_CASE = "|".join("".join(f"[{c.upper()}{c}]" for c in w) for w in ("password", "passwd", "secret", "token")) + "|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
#: (kind, pattern of a match, least characters of its value), in the order of kinds. Runs of a class that are too short
#: can't hide a longer one, so their least length stands in the pattern; a short assignment does take its text, so it is matched first and dropped then.
BASE = (
    ("assign", rf"(?:{_ANY_CASE})[\x22\x27]?\x20*[:=]\x20*[\x22\x27]?[A-Za-z0-9+/_.=-]+", 8),
    ("access", "AKIA[A-Z0-9]{12,}", 16),
    ("hex", "(?<![0-9a-f])[0-9a-f]{32,}", 32),
)
_VALUE = rf"^(?:{_ANY_CASE})[\x22\x27]?\x20*[:=]\x20*[\x22\x27]?([A-Za-z0-9+/_.=-]+)"
#: What any match of a kind holds; long runs of all kinds share one test, so most texts are read twice only.
_LONG, _GIVEN = "[A-Za-z0-9+/_=-]{16}", r"[:=]\x20*[\x22\x27]?[A-Za-z0-9+/_.=-]{8}"
_MATCHES = "array<struct<start:int,end:int,match:string,value:string>>"
#: Running sums are taken in blocks of so many numbers, so appending to an array never copies a long one.
_SUMS = 64


def _bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _appended(numbers: Column) -> Column:
    step = lambda acc, x: F.struct((acc["sum"] + x).alias("sum"), F.concat(acc["out"], F.array(acc["sum"] + x)).alias("out"))
    return F.aggregate(numbers, F.struct(F.lit(0).alias("sum"), F.array().cast("array<int>").alias("out")), step, lambda acc: acc["out"])


def running_sums(numbers: Column) -> Column:
    """array<int> of the sums up to each element of an array<int>."""
    starts = lambda n: F.sequence(F.lit(1), F.greatest(n, F.lit(1)), F.lit(_SUMS))
    blocks = F.transform(starts(F.size(numbers)), lambda i: _appended(F.slice(numbers, i, F.lit(_SUMS))))

    def shifted(b: Column) -> Column:
        ends = _appended(F.transform(b, lambda x: F.coalesce(F.try_element_at(x, F.lit(-1)), F.lit(0))))
        return _bound(ends, lambda e: F.flatten(F.transform(b, lambda x, k: F.transform(x, lambda v: v + F.when(k > 0, F.get(e, k - 1)).otherwise(0)))))

    return _bound(blocks, shifted)


def _located(text: Column, pattern: str, value=lambda match: match) -> Column:
    """array<struct<start,end,match,value>> of the leftmost non-overlapping matches, by running sums of the lengths of matches and of what lies between."""

    def spans(m: Column) -> Column:
        gaps = F.transform(F.split(text, pattern, -1), F.length)
        steps = F.zip_with(F.slice(gaps, F.lit(1), F.size(m)), m, lambda gap, x: gap + F.length(x))
        one = lambda end, x: F.struct((end - F.length(x)).alias("start"), end.alias("end"), x.alias("match"), value(x).alias("value"))
        return _bound(steps, lambda n: F.zip_with(running_sums(n), m, one))

    found = _bound(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), spans)
    return F.when(text.rlike(pattern), found).otherwise(_none())


def _none() -> Column:
    return F.array().cast(_MATCHES)


def _base_matches(text: Column, kind: int) -> Column:
    _, pattern, least = BASE[kind]
    found = _located(text, pattern, (lambda m: F.regexp_extract(m, _VALUE, 1)) if kind == 0 else (lambda m: m))
    kept = F.filter(found, lambda x: F.length(x["value"]) >= least)
    return F.when(text.rlike(_GIVEN), kept).otherwise(_none()) if kind == 0 else kept


def _with_base(docs: DataFrame) -> DataFrame:
    out = docs.withColumn("_text", F.coalesce("text", F.lit("")))
    for k, (kind, *_rest) in enumerate(BASE):
        found = _base_matches(F.col("_text"), k)
        out = out.withColumn(f"_{kind}", F.when(F.col("_text").rlike(_LONG), found).otherwise(_none()) if k else found)
    return out


def train_models(docs: DataFrame, max_rows: int = MAX_TRAIN_ROWS) -> list[float]:
    """Log-likelihood ratio (random over ordinary) of each pair of ALPHABET characters, row by row.

    All zero (nothing is called random) where the sample holds no random or no ordinary token.
    """
    sample = _with_base(docs.filter(picked(max_rows, docs.count(), "doc_id", "text")).select("text"))
    values = F.concat(*[F.transform(f"_{kind}", lambda x: x["value"]) for kind, *_ in BASE])
    rest = F.col("_text")
    for _, pattern, *_x in BASE:
        rest = F.regexp_replace(rest, pattern, " ")
    # long tokens of letters and digits may be either, so they are no samples
    ordinary = lambda v: ~((F.length(v) >= 20) & v.rlike("[0-9]") & v.rlike("[A-Za-z]"))
    tokens = sample.select(
        F.explode(F.concat(
            F.transform(F.array_distinct(values), lambda v: F.struct(F.lit(1).alias("random"), v.alias("token"))),
            F.transform(F.filter(F.array_distinct(F.regexp_extract_all(rest, F.lit("[A-Za-z0-9+/_=-]{8,}"), F.lit(0))), ordinary), lambda v: F.struct(F.lit(0).alias("random"), v.alias("token"))),
        )).alias("t")
    ).select("t.*").distinct()
    pairs = tokens.select("random", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length("token") - 1, F.lit(1))), lambda i: F.substring("token", i, F.lit(2)))).alias("pair"))
    counted = pairs.filter(F.col("pair").rlike("^[A-Za-z0-9+/_=-]{2}$")).groupBy("random", "pair").count().collect()
    return ratios({(r["random"], r["pair"]): r["count"] for r in counted})


def ratios(count: dict[tuple[int, str], int]) -> list[float]:
    """The table of a count of (is random, pair of characters)."""
    out, n = [], len(ALPHABET)
    total = {(k, a): sum(count.get((k, a + b), 0) for b in ALPHABET) for k in (0, 1) for a in ALPHABET}
    if not all(any(total[k, a] for a in ALPHABET) for k in (0, 1)):
        return [0.0] * (n * n)
    for a in ALPHABET:
        for b in ALPHABET:
            # a character that no ordinary token has speaks for a random one
            p = [count.get((k, a + b), 0) / total[k, a] if total[k, a] else k / n for k in (0, 1)]
            out.append(math.log(0.5 * p[1] + 0.5 / n) - math.log(0.98 * p[0] + 0.02 / n))
    return out


def _ratio(token: Column, table: Column) -> Column:
    place = lambda i: F.instr(F.lit(ALPHABET), F.substring(token, i, F.lit(1))) - 1
    return F.aggregate(F.sequence(F.lit(1), F.length(token) - 1), F.lit(0.0), lambda acc, i: acc + F.get(table, place(i) * len(ALPHABET) + place(i + 1)))


def scan_secrets(docs: DataFrame, model: list[float] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``base`` and ``spans``: arrays of (start, rank, kind, end), ordered by start, then kind.

    ``base`` holds the spans of the fixed patterns; ``spans`` also those that the Markov models add (kind
    ``random``), which never overlap base ones. Columns of ``docs`` of those two names are replaced, others are kept.
    """
    model = train_models(docs) if model is None else model
    table = F.split(F.lit(",".join(f"{x:.6f}" for x in model)), ",").cast("array<double>")

    def spans(found: Column, rank: int, kind: str) -> Column:
        return F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), x["end"].alias("end")))

    def added(text: Column, base: Column) -> Column:
        apart = lambda x: ~F.exists(base, lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))
        return F.filter(_located(text, CANDIDATE), lambda x: (_ratio(x["match"], table) >= threshold) & apart(x))

    def whole(base: Column, more: Column) -> Column:
        return F.struct(base.alias("base"), F.array_sort(F.concat(base, more)).alias("spans"))

    def scanned(text: Column) -> Column:
        found = [spans(_base_matches(text, k), k, kind) for k, (kind, *_) in enumerate(BASE)]
        with_runs = _bound(F.array_sort(F.concat(*found)), lambda b: whole(b, spans(added(text, b), len(BASE), "random")))
        return F.when(text.rlike(_LONG), with_runs).otherwise(_bound(F.array_sort(found[0]), lambda b: F.struct(b.alias("base"), b.alias("spans"))))

    found = docs.drop("base", "spans", "_found").withColumn("_found", _bound(F.coalesce("text", F.lit("")), scanned))
    return found.withColumns({"base": F.col("_found.base"), "spans": F.col("_found.spans")}).drop("_found")


def joined(spans: str) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def redacted(text: str = "text", spans: str = "spans", mask: str = "[SECRET]") -> Column:
    """The text with every span replaced by ``mask``; overlapping spans make one."""
    column = F.col(text)

    def step(acc, s):
        gap = F.substring(column, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        return F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(s["start"] >= acc["at"], F.concat(acc["out"], gap, F.lit(mask))).otherwise(acc["out"]).alias("out"),
        )

    done = F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substring(column, acc["at"] + 1, F.lit(2147483647))))
    return F.when(F.size(spans) > 0, done).otherwise(column)
