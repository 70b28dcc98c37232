"""Exact order statistics that never gather a group in one task.

A plain ``percentile`` keeps every distinct value of a group in one aggregation buffer, so a
key with a third of all rows lands in one task. Here the group is first collapsed to
(key, value, count) with map-side combine, then to a logarithmic histogram whose size depends
only on the value range; the histogram tells which bucket holds each wanted rank, and only the
rows of those buckets are ordered. Every window therefore sees one histogram (at most a few
thousand rows) or one bucket of distinct values.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

QUARTILES = (0.25, 0.5, 0.75)
BUCKETS_PER_OCTAVE = 256

_N, _W, _B = "__n", "__w", "__b"


def _octave_bucket(value: Column) -> Column:
    """Monotone bucket number: 256 buckets per doubling of the value."""
    magnitude = F.floor(F.log2(F.abs(value.cast("double")) + 1) * BUCKETS_PER_OCTAVE)
    return F.when(value < 0, -magnitude).otherwise(magnitude).cast("int")


def value_counts(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    *,
    segments: Mapping[str, Column] | None = None,
    weight: Column | None = None,
    count: Column | None = None,
) -> DataFrame:
    """(keys, [segment], value, __n, [__w]) with one shuffle and map-side combine.

    ``segments`` counts several overlapping row subsets in the same pass; ``weight`` is a
    whole-number weight; ``count`` is a multiplicity for rows that are already collapsed.
    """
    unit = count if count is not None else F.lit(1)
    present = df.where(F.col(value).isNotNull())
    if segments:
        counters = [F.sum(F.when(cond, unit).otherwise(0)).cast("bigint").alias(f"__s{i}") for i, cond in enumerate(segments.values())]
        wide = present.groupBy(*keys, value).agg(*counters)
        pairs = [F.struct(F.lit(name).alias("segment"), F.col(f"__s{i}").alias(_N)) for i, name in enumerate(segments)]
        return wide.select(*keys, value, F.inline(F.array(*pairs))).where(F.col(_N) > 0)
    sums = [F.sum(unit).cast("bigint").alias(_N)]
    if weight is not None:
        sums.append(F.sum(weight * unit).cast("bigint").alias(_W))
    return present.groupBy(*keys, value).agg(*sums)


def statistics_from_counts(
    counts: DataFrame,
    keys: Sequence[str],
    value: str,
    quantiles: Mapping[str, float],
    *,
    weighted: Mapping[str, float] | None = None,
) -> DataFrame:
    """One row per key (exactly one row without keys): ``count, total, minimum, maximum, mean`` plus the named quantiles.

    ``quantiles`` interpolate linearly between ranks; ``weighted`` names are the first value
    whose running weight reaches the share, and add ``weight_total`` and ``weighted_mean``.
    """
    keys = list(keys)
    by = keys or [F.lit(0)]
    weighted = weighted or {}
    whole = dict(counts.dtypes)[value] in ("bigint", "int")
    exact = (lambda c: c.cast("decimal(38,0)")) if whole else (lambda c: c)
    val = F.col(value)

    # the not-null filter is spelled out so that both readers of the counts share one shuffle
    bucketed = counts.withColumn(_B, _octave_bucket(val)).where(F.col(_B).isNotNull())
    parts = [
        F.sum(_N).alias(_N), F.sum(exact(val * F.col(_N).cast(val_type(whole)))).alias("__sum"),
        F.min(value).alias("__min"), F.max(value).alias("__max"),
    ]
    if weighted:
        parts += [F.sum(_W).alias(_W), F.sum(exact(val.cast(val_type(whole)) * F.col(_W).cast(val_type(whole)))).alias("__wsum")]
    hist = bucketed.groupBy(*keys, _B).agg(*parts)

    group = W.partitionBy(*by)
    running = group.orderBy(_B).rowsBetween(W.unboundedPreceding, W.currentRow)
    columns = [
        *keys, F.col(_B).alias("__hb"), F.col(_N).alias("__bn"),
        (F.sum(_N).over(running) - F.col(_N)).alias("__before"),
        F.sum(_N).over(group).alias("__total"), F.sum("__sum").over(group).alias("__gsum"),
        F.min("__min").over(group).alias("__gmin"), F.max("__max").over(group).alias("__gmax"),
    ]
    if weighted:
        columns += [
            F.col(_W).alias("__bw"), (F.sum(_W).over(running) - F.col(_W)).alias("__wbefore"),
            F.sum(_W).over(group).alias("__wtotal"), F.sum("__wsum").over(group).alias("__gwsum"),
        ]
    hist = hist.select(*columns)

    total = F.col("__total")
    position = {name: (total - 1) * F.lit(float(q)) for name, q in quantiles.items()}
    low_rank = {name: F.floor(p).cast("bigint") for name, p in position.items()}
    ranks = {**{f"{n}__lo": r for n, r in low_rank.items()}, **{f"{n}__hi": F.least(r + 1, total - 1) for n, r in low_rank.items()}}
    cuts = {name: F.col("__wtotal") * F.lit(float(q)) for name, q in weighted.items()}

    def holds_rank(start: Column, size: Column, rank: Column) -> Column:
        return (start <= rank) & (rank < start + size)

    def holds_cut(start: Column, size: Column, cut: Column) -> Column:
        return (start < cut) & (cut <= start + size)

    in_bucket = [holds_rank(F.col("__before"), F.col("__bn"), r) for r in ranks.values()]
    in_bucket += [holds_cut(F.col("__wbefore"), F.col("__bw"), c) for c in cuts.values()]
    wanted = hist.where(reduce(lambda a, b: a | b, in_bucket))

    renamed = wanted.select(*[F.col(k).alias(f"__k_{k}") for k in keys], *[c for c in wanted.columns if c not in keys])
    match = reduce(
        lambda a, b: a & b,
        [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys],
        F.col(_B) == F.col("__hb"),
    )
    located = bucketed.join(renamed, match).drop(*[f"__k_{k}" for k in keys])
    inside = W.partitionBy(*keys, _B).orderBy(value).rowsBetween(W.unboundedPreceding, W.currentRow)
    located = located.withColumn("__start", F.col("__before") + F.sum(_N).over(inside) - F.col(_N))
    hits = [holds_rank(F.col("__start"), F.col(_N), r) for r in ranks.values()]
    if weighted:
        located = located.withColumn("__wstart", F.col("__wbefore") + F.sum(_W).over(inside) - F.col(_W))
        hits += [holds_cut(F.col("__wstart"), F.col(_W), c) for c in cuts.values()]
    located = located.where(reduce(lambda a, b: a | b, hits))

    picks = [F.max(c).alias(c) for c in ("__total", "__gsum", "__gmin", "__gmax")]
    picks += [F.max(F.when(holds_rank(F.col("__start"), F.col(_N), r), val)).alias(f"__{n}") for n, r in ranks.items()]
    if weighted:
        picks += [F.max(c).alias(c) for c in ("__wtotal", "__gwsum")]
        picks += [F.min(F.when(holds_cut(F.col("__wstart"), F.col(_W), c), val)).alias(f"__{n}") for n, c in cuts.items()]
    # without keys the result is one row even when nothing matched
    picked = located.groupBy(*keys).agg(*picks)

    out = [
        *keys, F.coalesce(total, F.lit(0)).alias("count"), F.col("__gmin").cast("double").alias("minimum"),
        F.col("__gmax").cast("double").alias("maximum"), (F.col("__gsum").cast("double") / total).alias("mean"),
    ]
    for name, pos in position.items():
        low, high = F.col(f"__{name}__lo").cast("double"), F.col(f"__{name}__hi").cast("double")
        out.append((low + (high - low) * (pos - F.floor(pos))).alias(name))
    for name in weighted:
        out.append(F.col(f"__{name}").cast("double").alias(name))
    if weighted:
        out += [F.col("__wtotal").alias("weight_total"), (F.col("__gwsum").cast("double") / F.col("__wtotal")).alias("weighted_mean")]
    return picked.select(*out)


def val_type(whole: bool) -> str:
    return "decimal(19,0)" if whole else "double"


def price_statistics(
    df: DataFrame,
    keys: Sequence[str],
    value: str = "price",
    quantiles: Mapping[str, float] | None = None,
    *,
    segments: Mapping[str, Column] | None = None,
    weight: Column | None = None,
    weighted: Mapping[str, float] | None = None,
    count: Column | None = None,
) -> DataFrame:
    """Counts then statistics in one call; with ``segments`` the key gains a ``segment`` column."""
    quantiles = quantiles if quantiles is not None else {"median": 0.5}
    counts = value_counts(df, keys, value, segments=segments, weight=weight, count=count)
    full_keys = [*keys, "segment"] if segments else list(keys)
    return statistics_from_counts(counts, full_keys, value, quantiles, weighted=weighted)
