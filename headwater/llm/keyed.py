"""Equi-joins whose left side may have a third of its rows under one key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot if it has more than one row in so many; there are fewer than this many such keys, whatever the data.
HOT = 1000


def looked_up(rows: DataFrame, values: DataFrame, key: str) -> DataFrame:
    """``rows`` with the columns of ``values`` (one row a key); rows whose key has no value get nulls.

    Rows of hot keys meet their values by broadcast (fewer than HOT of them), so they are not shuffled to one task; all others by an ordinary
    join. ``rows`` is read three times and should be a written table. Keys must not be null.
    """
    counts = rows.groupBy(key).agg(F.count("*").alias("_times"))
    hot = counts.filter(F.col("_times") * HOT > rows.count()).select(key)
    crowded = rows.join(F.broadcast(hot), key, "left_semi").join(F.broadcast(values.join(F.broadcast(hot), key, "left_semi")), key, "left")
    return rows.join(F.broadcast(hot), key, "left_anti").join(values, key, "left").unionByName(crowded)
