"""Text and number formatting where Spark's own functions differ from the required results."""

from __future__ import annotations

import math
import re
from decimal import ROUND_CEILING, ROUND_FLOOR, Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

PLACES = Decimal("0.0001")


def casefolded(column: Column | str) -> Column:
    """Full case folding; ``lower`` keeps letters such as sharp s apart."""

    @F.pandas_udf(StringType())
    def fold(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else v.casefold())

    return fold(column)


def matches_name(column: Column | str) -> Column:
    """Letters, digits, _ and - only, from the first character to the last (no trailing line feed)."""
    return F.col(column).rlike(r"\A[A-Za-z0-9][A-Za-z0-9_-]*\z") if isinstance(column, str) else column.rlike(r"\A[A-Za-z0-9][A-Za-z0-9_-]*\z")


def file_stem(column: Column | str) -> Column:
    """A name as a file stem: runs of other characters become _, trimmed; ``project`` if nothing is left."""
    value = F.col(column) if isinstance(column, str) else column
    stem = F.regexp_replace(F.regexp_replace(value, "[^A-Za-z0-9_-]+", "_"), "^_+|_+$", "")
    return F.when(stem == "", F.lit("project")).otherwise(stem)


def stem_of(name: str) -> str:
    return re.sub(r"[^A-Za-z0-9_-]+", "_", name).strip("_") or "project"


def padded_limit(value: float, pad: float | int, most: int, low: bool) -> str:
    """A bound moved outwards by ``pad``, clipped to ``most`` degrees and rounded outwards to four places."""
    exact = Decimal(str(value)) + (-Decimal(str(pad)) if low else Decimal(str(pad)))
    clipped = max(Decimal(-most), exact) if low else min(Decimal(most), exact)
    return format(clipped.quantize(PLACES, rounding=ROUND_FLOOR if low else ROUND_CEILING), ".4f")


def fixed(places: int, *columns: Column | str) -> list[Column]:
    """Each column with so many places, the exact binary value rounded half to even."""

    @F.pandas_udf(StringType())
    def show(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None or math.isnan(v) else f"{v:.{places}f}")

    return [show(c) for c in columns]
