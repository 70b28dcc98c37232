"""Similarity, confidence and comparison scores."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from pricelens.functions.folding import casefold
from pricelens.functions.vocabulary import python_key

# Fixed weights and neutral values of the similarity score.
YEAR_WEIGHT, MILEAGE_WEIGHT, MODEL_WEIGHT, FRESHNESS_WEIGHT = 0.42, 0.34, 0.14, 0.10
NO_TARGET, NO_VALUE = 0.65, 0.55
YEAR_SCALE = 6.0
MIN_SAMPLE = 8
# Scores are summed as whole millionths so totals do not depend on summation order.
WEIGHT_UNITS = 1_000_000


def clip(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def distance_score(value: Column, target: Column, scale: Column | float) -> Column:
    scale = scale if isinstance(scale, Column) else F.lit(scale)
    closeness = clip(1 - F.abs(value.cast("double") - target.cast("double")) / scale, 0.0, 1.0)
    return F.when(target.isNull(), NO_TARGET).when(value.isNull(), NO_VALUE).otherwise(closeness)


def mileage_scale(target: Column) -> Column:
    # a zero target counts as "not given" for the scale only
    basis = F.coalesce(F.nullif(target.cast("double"), F.lit(0.0)), F.lit(100_000.0))
    return F.greatest(basis * 0.75, F.lit(80_000.0))


def freshness_score(age_days: Column, any_dates: Column) -> Column:
    aged = clip(1 - age_days / 45.0, 0.35, 1.0)
    return F.when(~any_dates, NO_TARGET).when(age_days.isNull(), NO_VALUE).otherwise(aged)


def model_score(selected: str | None, model: Column, title: Column) -> Column:
    """Whether the wanted model name occurs in a listing; no name, or 'all', is neutral."""
    wanted = (selected or "").strip().casefold()
    if not wanted or python_key(wanted) in ("tum", "tumu"):
        return F.lit(0.75)
    haystack = casefold(F.concat_ws(" ", F.coalesce(model, F.lit("")), F.coalesce(title, F.lit(""))))
    return F.when(haystack.contains(wanted), 1.0).otherwise(0.65)


def similarity(year: Column, mileage: Column, model: Column, freshness: Column | float = NO_TARGET) -> Column:
    freshness = freshness if isinstance(freshness, Column) else F.lit(freshness)
    total = YEAR_WEIGHT * year + MILEAGE_WEIGHT * mileage + MODEL_WEIGHT * model + FRESHNESS_WEIGHT * freshness
    return clip(total, 0.05, 1.0)


def weight_units(score: Column) -> Column:
    return F.round(score * WEIGHT_UNITS).cast("bigint")


def mileage_tolerance(target: Column) -> Column:
    return F.greatest(F.floor(target * F.lit(0.30)).cast("bigint"), F.lit(25_000).cast("bigint"))


def mileage_window(target: Column) -> tuple[Column, Column]:
    tolerance = mileage_tolerance(target)
    return F.greatest(target - tolerance, F.lit(0).cast("bigint")), target + tolerance


def confidence(count: Column) -> Column:
    return (
        F.when(count >= 50, "Yuksek").when(count >= 20, "Orta").when(count >= MIN_SAMPLE, "Dusuk").otherwise("Yetersiz")
    )


def sample_status(count: Column) -> Column:
    return F.when(count.isNull() | (count == 0), "empty").when(count >= MIN_SAMPLE, "ok").otherwise("low_sample")


def percent_change(new: Column, old: Column) -> Column:
    return F.when(old != 0, (new - old) / old * 100)


def price_delta(asking: Column, market: Column) -> Column:
    return F.when(market > 0, (asking.cast("double") - market) / market * 100)


# Labels for below, above and inside the market, in display and in plain spelling.
POSITIONS = ("Piyasa altı", "Piyasa üstü", "Piyasa içinde")
PLAIN_POSITIONS = ("Piyasa alti", "Piyasa ustu", "Piyasa icinde")


def price_position(delta: Column, labels: tuple[str, str, str] = POSITIONS) -> Column:
    below, above, inside = labels
    return F.when(delta <= -8, below).when(delta >= 8, above).when(delta.isNotNull(), inside)
