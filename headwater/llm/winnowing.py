"""Document fingerprints by winnowing, in DataFrame functions only.

Texts are lower-cased, white space becomes one space, and every ``K`` consecutive bytes of UTF-8 are hashed; of each
``WINDOW`` consecutive hashes the smallest is chosen, the rightmost on ties, and kept with its position. Two texts that
share ``K + WINDOW - 1`` bytes in a row share a fingerprint, with or without spaces. Shorter texts make one window (or
one gram) of all they have; null, empty and blank texts have no fingerprints and are alike only among themselves.

Neighbours in descending id order are found without a global sort: distinct ids are dealt into ranges by their own
distribution (Spark's range partitioning), ordered within each range, and ranges are tied by their largest ids. Texts move once to
meet their neighbours. Only windows at the seam of an edited text are hashed; the choices of all others are known from the two texts it
is made of, whose bytes are compared first. A hash keeps 31 bits: of two unrelated texts with n and m fingerprints about n * m / 2**31 agree by chance.

Rows without an id have no next document; rows of one id are each paired with one row of the next; other columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import materialize

K, WINDOW = 16, 32
#: Windows of one text that are held at a time.
_BLOCK = 4096
#: Ids that one task sorts, and a bound on the ranges (a row of 12 bytes each is broadcast).
IDS_PER_RANGE, MOST_RANGES = 100_000, 200_000


def _bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, however often it is used; a row's binary is copied whenever it is read from the row."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _folded(text: Column | str) -> Column:
    """The bytes that are hashed."""
    folded = F.lower(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))
    return F.trim(F.regexp_replace(folded, r"[\s\p{Z}]+", " ")).cast("binary")


def _gram(b: Column, i: Column, k: int) -> Column:
    hashed = F.xxhash64(F.substring(b, i + 1, F.lit(k)))
    return F.shiftleft(hashed.bitwiseAND(F.lit(0x7FFFFFFF)), 32) + (F.lit(0xFFFFFFFF) - i)


def _chosen(b: Column, first: Column, last: Column, k: int, window: int) -> Column:
    """array<array<bigint>>: the choices of the windows that begin at ``first`` to ``last``, _BLOCK windows an entry."""
    def grams(start: Column) -> Column:
        end = F.least(start + (_BLOCK + window - 2), last + (window - 1), F.greatest(F.length(b) - k, F.lit(0)))
        return F.transform(F.sequence(start, end), lambda i: _gram(b, i, k))

    # minima of up to four times as many hashes at each step; what lies beyond the end is null, which least() leaves out
    def minima(g: Column, span: int) -> Column:
        if span >= window:
            return F.array_distinct(F.slice(g, F.lit(1), F.greatest(F.size(g) - (window - 1), F.lit(1))))
        ahead = sorted({min(j * span, window - span) for j in (1, 2, 3)})
        return _bound(F.transform(g, lambda x, i: F.least(x, *[F.get(g, i + j) for j in ahead])), lambda m: minima(m, span + ahead[-1]))

    return F.transform(F.sequence(first, last, F.lit(_BLOCK)), lambda s: _bound(grams(s), lambda g: minima(g, 1)))


def _last(b: Column, k: int, window: int) -> Column:
    """Where the last window begins."""
    return F.greatest(F.length(b) - (k + window - 1), F.lit(0))


def _every(b: Column, k: int, window: int) -> Column:
    return F.when(F.length(b) > 0, _chosen(b, F.lit(0), _last(b, k, window), k, window)).otherwise(F.array().cast("array<array<bigint>>"))


def winnow(text: Column | str, k: int = K, window: int = WINDOW) -> Column:
    """array<bigint>: chosen hashes in text order; the low 32 bits count down with the position, the rest is the hash.

    Such a number is smaller for a smaller hash and, for equal hashes, for a later position, so the least of a
    window is the rightmost minimum.
    """
    return _bound(_folded(text), lambda b: F.array_distinct(F.flatten(_every(b, k, window))))


def _low(x: Column) -> Column:
    return x.bitwiseAND(F.lit(0xFFFFFFFF))


def places(b: Column | str, k: int = K, window: int = WINDOW) -> Column:
    """The positions that are chosen in folded bytes, counted from the beginning of their block of _BLOCK windows; ``at_places`` makes a fingerprint of them."""
    kind = "smallint" if _BLOCK + window <= 1 << 15 else "int"
    return _bound(F.col(b) if isinstance(b, str) else b, lambda b: F.transform(
        _every(b, k, window), lambda block, j: F.transform(block, lambda x: (F.lit(0xFFFFFFFF) - _low(x) - j * _BLOCK).cast(kind))
    ))


def at_places(b: Column | str, where: Column | str, k: int = K, shift: Column | None = None) -> Column:
    """The fingerprint of folded bytes whose places (moved by ``shift``) are known: only its chosen grams are hashed."""
    shift = F.lit(0) if shift is None else shift
    return _bound(F.col(b) if isinstance(b, str) else b, lambda b: F.array_distinct(F.flatten(F.transform(
        where, lambda block, j: F.transform(block, lambda o: _gram(b, o + j * _BLOCK + shift, k))
    ))))


def places_of_start(start: Column, b: Column, where: Column, k: int = K, window: int = WINDOW) -> Column:
    """``places(start)``, taken from those of ``b`` where that begins with ``start``.

    Choices never step back from a window to the next, so the choices of the first windows are those up to the choice of the last of them.
    """
    last = F.length(start) - (k + window - 1)
    least = _bound(start, lambda start: F.array_min(F.transform(F.sequence(last, last + (window - 1)), lambda i: _gram(start, i, k))))
    upto = lambda c: F.transform(F.slice(where, F.lit(1), F.floor(c / _BLOCK).cast("int") + 1), lambda block, j: F.filter(block, lambda o: o + j * _BLOCK <= c))
    inside = (last >= 0) & (F.substring(b, F.lit(1), F.length(start)) == start)
    return F.when(inside, _bound((F.lit(0xFFFFFFFF) - _low(least)).cast("int"), upto)).otherwise(places(start, k, window))


def shared_start(x: Column, y: Column) -> Column:
    """How many bytes two binaries have in common before they differ: a bit of that number at a time."""
    def counted(x: Column, y: Column, longest: Column) -> Column:
        longer = lambda n, bit: (bit <= longest - n) & (F.substring(x, n + 1, bit) == F.substring(y, n + 1, bit))
        return F.aggregate(F.array(*[F.lit(1 << p) for p in range(30, -1, -1)]), F.lit(0), lambda n, bit: F.when(longer(n, bit), n + bit).otherwise(n))

    return _bound(x, lambda x: _bound(y, lambda y: _bound(F.least(F.length(x), F.length(y)), lambda longest: counted(x, y, longest))))


def fresh_windows(edited: Column, b: Column, tail: Column, k: int = K, window: int = WINDOW) -> Column:
    """(first, last, before, after): which windows of ``edited`` are neither in the start it shares with ``b`` nor in the end ``tail``.

    The choice of ``first`` is that of ``b`` too, if ``before``, and the choice of ``last`` that of the first window of ``tail``, if ``after``
    (both binaries folded).
    """
    reach, size, end = k + window - 1, F.length(edited), F.length(tail)
    after = (end >= reach) & (size >= end) & (F.substring(edited, size - end + 1, end) == tail)
    last = F.when(after, size - end).otherwise(F.greatest(size - reach, F.lit(0)))
    return _bound(F.struct(shared_start(edited, b).alias("start"), after.alias("after"), last.alias("last")), lambda x: F.struct(
        F.least(F.greatest(x["start"] - reach, F.lit(0)), x["last"]).alias("first"), x["last"].alias("last"), (x["start"] >= reach).alias("before"), x["after"].alias("after"),
    ))


def winnow_edited(edited: Column, fresh: Column, fingerprint: Column, tail: Column, tail_places: Column, k: int = K, window: int = WINDOW) -> Column:
    """``winnow`` of folded bytes of which ``fresh_windows`` are not known from a fingerprint and from the places of the tail."""
    none = F.array().cast("array<bigint>")

    def joined(mid: Column) -> Column:
        before = _bound(_low(mid[0]), lambda c: F.filter(fingerprint, lambda x: _low(x) >= c))  # up to the choice of the first fresh window
        after = _bound(F.length(edited) - F.length(tail), lambda shift: at_places(edited, tail_places, k, shift))
        return F.array_distinct(F.concat(F.when(fresh["before"], before).otherwise(none), mid, F.when(fresh["after"], after).otherwise(none)))

    mid = _bound(edited, lambda e: F.flatten(_chosen(e, fresh["first"], fresh["last"], k, window)))
    return F.when(F.length(edited) > 0, _bound(mid, joined)).otherwise(none)


def hashes(fingerprint: Column | str) -> Column:
    """Distinct hashes of a fingerprint, without positions: 31 bits each."""
    return F.array_distinct(F.transform(fingerprint, lambda x: F.shiftright(x, 32).cast("int")))


def shown(fingerprint: Column | str) -> Column:
    """hash@position in hexadecimal, comma-joined in text order."""
    one = lambda x: F.concat(F.hex(F.shiftright(x, 32)), F.lit("@"), F.hex(F.lit(0xFFFFFFFF) - _low(x)))
    return F.lower(F.array_join(F.transform(fingerprint, one), ","))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two hash sets; 1 for two empty ones."""
    shared = F.size(F.array_intersect(a, b)).cast("double")
    total = F.size(a) + F.size(b) - shared
    return F.when(total == 0, F.lit(1.0)).otherwise(shared / total)


def next_ids(ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, next_id): the next smaller distinct id; after the smallest, the largest. Null ids have none."""
    ids = ids.select(F.col(key).alias("id")).filter("id is not null").distinct()
    # ranges of the ids' own distribution, as many as the rows ask for; the range of an id is fixed once it is written
    rows = ids.count()
    ranges = min(max(rows // IDS_PER_RANGE, 1), MOST_RANGES)
    placed = materialize(ids.repartitionByRange(int(ranges), "id").withColumn("range", F.spark_partition_id()), "ids")
    within = placed.withColumn("below", F.lag("id").over(Window.partitionBy("range").orderBy("id")))
    # one row a range
    tops = placed.groupBy("range").agg(F.max("id").alias("top"))
    lower = tops.select("range", F.coalesce(F.lag("top").over(Window.orderBy("range")), F.max("top").over(Window.partitionBy(F.lit(0)))).alias("top_below"))
    joined = within.join(F.broadcast(lower), "range")
    return joined.select(F.col("id").alias(key), F.coalesce("below", "top_below").cast("long").alias("next_id"))


def fingerprint_edits(docs: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next) of every row.

    The edited text is the row's with its last half (rounded down) replaced by as many first code points of the next
    document's (or all). Rows with the same id as another are each paired with one row of the next id; rows without an
    id have no next document.
    """
    if dict(docs.dtypes)["doc_id"] != "bigint":
        docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("places", places(_folded("text"), k, window))
    # both joins read this side through one shuffle of texts and positions, so it must be the same plan in both
    texts = docs.filter("doc_id is not null")
    ids = docs.select("doc_id", F.length("text").alias("n")).filter("doc_id is not null")
    sizes = ids.groupBy("doc_id").agg(F.max("n").alias("n"))
    wanted = sizes.join(next_ids(ids), "doc_id").select(F.col("doc_id").alias("asking"), F.col("next_id").alias("doc_id"), F.floor(F.col("n") / 2).cast("int").alias("take"))
    asked = texts.join(wanted, "doc_id").withColumns({"head": F.substring("text", F.lit(1), F.col("take")), "b": _folded("text")}).withColumn("tail", _folded("head"))
    given = asked.select(
        F.col("asking").alias("doc_id"), "head", hashes(at_places("b", "places", k)).alias("next_hashes"),
        places_of_start(F.col("tail"), F.col("b"), F.col("places"), k, window).alias("head_places"),
    ).groupBy("doc_id").agg(F.min_by(F.struct("head", "next_hashes", "head_places"), F.struct("head")).alias("given")).select("doc_id", "given.*")
    alone = docs.filter("doc_id is null").withColumns({"head": F.lit(""), "next_hashes": F.array().cast("array<int>"), "head_places": F.array().cast(dict(docs.dtypes)["places"])})
    both = texts.join(given, "doc_id").unionByName(alone).withColumns({"n_chars": F.length("text"), "b": _folded("text")})
    half = F.floor(F.col("n_chars") / 2).cast("int")
    both = both.withColumn("put", F.substring("head", F.lit(1), half)).withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars") - half), F.col("put")))
    both = both.withColumns({"fingerprint": at_places("b", "places", k), "e": _folded("edited"), "tail": _folded("put")})
    # a row of an id that has longer ones takes less than the head it was given, whose places are then left alone
    tail = F.when(F.length("put") == F.length("head"), F.col("tail")).otherwise(F.lit("").cast("binary"))
    both = both.withColumn("tail", tail).withColumn("fresh", fresh_windows(F.col("e"), F.col("b"), F.col("tail"), k, window))
    both = both.withColumn("edited_fingerprint", winnow_edited(F.col("e"), F.col("fresh"), F.col("fingerprint"), F.col("tail"), F.col("head_places"), k, window))
    own = hashes("fingerprint")
    return both.select(
        "doc_id", F.col("n_chars").cast("long").alias("n_chars"), "edited", "fingerprint", "edited_fingerprint",
        likeness(own, hashes("edited_fingerprint")).alias("near_edited"), likeness(own, F.col("next_hashes")).alias("near_next"),
    )
