"""Labelled rows for the trained operators: which may be learned from, and how many are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS, SEED = 5, 11


def fold(key: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo FOLDS; fold 0 is held out and never learned from."""
    return F.crc32(F.col(key).cast("string")) % FOLDS


#: Hashes are compared within this range, so the share of a sample may be far below one in 10**12.
_RANGE = 1 << 60


def picked(max_rows: int, rows: int, *keys: str) -> Column:
    """A condition that about ``max_rows`` of ``rows`` rows meet, by the hash of their keys; all of them if they are fewer."""
    if rows <= max_rows:
        return F.lit(True)
    return F.pmod(F.xxhash64(*keys), F.lit(_RANGE)) < _RANGE * max_rows // rows


def training_rows(docs: DataFrame, labels: DataFrame, target: str, max_rows: int) -> DataFrame:
    """(text, label, fold) of labelled rows outside fold 0: all of them, or about ``max_rows`` of them.

    Repeated label rows count once; an id with both labels, or without an id, is not learned from. Ids are picked by their hash;
    only they and their labels, about ``max_rows``, are sent to every task; texts are not shuffled. Of the document rows of picked ids, should ids repeat, about ``max_rows``
    are drawn by chance.
    """
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(target).cast("int").alias("label")).filter((fold() != 0) & F.col("label").isin(0, 1))
    known = rows.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other")).filter("label = other").select("doc_id", "label")
    chosen = known.filter(picked(max_rows, known.count(), "doc_id"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    found = texts.count()
    if found > max_rows:
        texts = texts.filter(F.rand(SEED) < max_rows / found)
    return texts.select("text", "label", fold().alias("fold"))
