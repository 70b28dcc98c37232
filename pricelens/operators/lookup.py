"""Joins against one-row-per-key tables that stay balanced when a key is hot."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

# Tables up to this many rows are broadcast after their size has been counted.
BROADCAST_ROWS = 200_000
# A key is heavy above this many rows; with the share below, at most 2 000 keys can be heavy.
HEAVY_ROWS = 200_000
HEAVY_SHARE = 2_000


def skew_left_join(rows: DataFrame, unique: DataFrame, keys: Sequence[str], total: int) -> DataFrame:
    """Left join ``rows`` to ``unique`` (one row per key), ``total`` being the number of rows.

    Keys holding more than 1/2000 of the rows number fewer than 2000, so their few partners are
    broadcast and their rows are never shuffled; everything else is an ordinary hash join.
    """
    keys = list(keys)
    threshold = max(HEAVY_ROWS, total // HEAVY_SHARE)
    if total <= threshold:
        return rows.join(unique, keys, "left")
    present = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    heavy = rows.where(present).groupBy(*keys).agg(F.count("*").alias("__n")).where(F.col("__n") > threshold).drop("__n")
    marked = rows.join(F.broadcast(heavy.withColumn("__heavy", F.lit(True))), keys, "left")
    partners = unique.join(F.broadcast(heavy), keys, "left_semi")
    hot = marked.where(F.col("__heavy")).drop("__heavy").join(F.broadcast(partners), keys, "left")
    cold = marked.where(F.col("__heavy").isNull()).drop("__heavy").join(unique, keys, "left")
    return hot.unionByName(cold)


def lookup_join(rows: DataFrame, unique: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join to a table whose size decides the strategy: counted and broadcast, or skew-safe."""
    size = unique.limit(BROADCAST_ROWS + 1).count()
    if size <= BROADCAST_ROWS:
        return rows.join(F.broadcast(unique), list(keys), "left")
    return skew_left_join(rows, unique, keys, rows.count())
