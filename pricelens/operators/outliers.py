"""Group-wise price outliers."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from pricelens.operators.lookup import lookup_join
from pricelens.operators.quantiles import price_statistics
from pricelens.session import materialize


@dataclass(frozen=True)
class UpperBoundPolicy:
    """Placeholder-like asking prices: far above both the upper quartile and the median."""

    min_group_size: int = 50
    median_multiplier: float = 20.0
    iqr_multiplier: float = 3.0


def upper_bounds(rows: DataFrame, keys: Sequence[str], policy: UpperBoundPolicy, value: str = "price") -> DataFrame:
    """(keys, upper) of the groups large enough to judge; only groups that break their bound are kept."""
    stats = price_statistics(rows, keys, value, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    upper = F.greatest(
        F.col("q3") + policy.iqr_multiplier * (F.col("q3") - F.col("q1")), F.col("median") * policy.median_multiplier
    )
    judged = stats.where(F.col("count") >= policy.min_group_size).withColumn("upper", upper)
    return judged.where(F.col("maximum") > F.col("upper")).select(*keys, "upper")


def mark_extreme_prices(rows: DataFrame, policy: UpperBoundPolicy, keys: Sequence[str] = ("brand", "series", "model")) -> DataFrame:
    """Add ``is_extreme``; rows with a blank key part are never extreme."""
    named = rows
    for key in keys:
        named = named.where(F.coalesce(F.col(key), F.lit("")) != "")
    bounds = materialize(upper_bounds(named, keys, policy), "price-bounds")
    joined = lookup_join(rows, bounds, list(keys))
    return joined.withColumn("is_extreme", F.coalesce(F.col("price") > F.col("upper"), F.lit(False))).drop("upper")


def fences(rows: DataFrame, keys: Sequence[str], value: str, min_records: int, iqr_multiplier: float) -> DataFrame:
    """Two-sided fence of groups with enough records and some spread."""
    stats = price_statistics(rows, keys, value, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    iqr = F.col("q3") - F.col("q1")
    return stats.where((F.col("count") >= min_records) & (iqr > 0)).select(
        *keys, (F.col("q1") - iqr_multiplier * iqr).alias("lower_fence"), (F.col("q3") + iqr_multiplier * iqr).alias("upper_fence")
    )


def mark_outside_fences(rows: DataFrame, keys: Sequence[str], value: str, min_records: int = 8, iqr_multiplier: float = 3.0) -> DataFrame:
    bounds = materialize(fences(rows, keys, value, min_records, iqr_multiplier), "price-fences")
    joined = lookup_join(rows, bounds, list(keys))
    outside = ~F.col(value).between(F.col("lower_fence"), F.col("upper_fence"))
    return joined.withColumn("is_outlier", F.coalesce(outside, F.lit(False))).drop("lower_fence", "upper_fence")
