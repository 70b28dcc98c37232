"""Listing filters as predicates that reach the Parquet scan."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, fields
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

TEXT_FILTERS = ("brand", "series", "model", "body_type", "fuel_type", "transmission")


@dataclass(frozen=True)
class ListingFilters:
    """Optional restrictions of one market question; blank values are ignored."""

    brand: str | None = None
    series: str | None = None
    model: str | None = None
    body_type: str | None = None
    fuel_type: str | None = None
    transmission: str | None = None
    year_min: int | None = None
    year_max: int | None = None
    mileage_max: int | None = None
    clean_only: bool = False

    def active(self) -> dict[str, object]:
        values = {f.name: getattr(self, f.name) for f in fields(self)}
        return {k: v for k, v in values.items() if v not in (None, "", False)}

    def predicate(self, columns: Iterable[str]) -> Column:
        """Conjunction over the columns that exist; a priced listing is always required."""
        present = set(columns)
        terms = [F.col("price") > 0]
        for name in TEXT_FILTERS:
            wanted = getattr(self, name)
            if wanted and name in present:
                terms.append(F.lower(F.coalesce(F.col(name), F.lit(""))) == wanted.strip().lower())
        if self.clean_only and "is_clean_claimed" in present:
            terms.append(is_clean())
        if self.year_min is not None and "year" in present:
            terms.append(F.col("year") >= int(self.year_min))
        if self.year_max is not None and "year" in present:
            terms.append(F.col("year") <= int(self.year_max))
        if self.mileage_max is not None and "mileage_km" in present:
            terms.append(F.col("mileage_km") <= int(self.mileage_max))
        return reduce(lambda a, b: a & b, terms)

    def snapshot_scope(self) -> tuple[str, str] | None:
        """Snapshot dimension that equals this filter, if any."""
        active = self.active()
        if not active:
            return "market", "all"
        if set(active) == {"brand"}:
            return "brand", str(active["brand"])
        return None


def is_clean() -> Column:
    return F.coalesce(F.col("is_clean_claimed"), F.lit(0)) == 1


def apply_filters(listings: DataFrame, filters: ListingFilters | None = None) -> DataFrame:
    return listings.where((filters or ListingFilters()).predicate(listings.columns))


def coerce_numbers(listings: DataFrame, columns: Iterable[str] = ("price", "year", "mileage_km")) -> DataFrame:
    """Text becomes a number, fractions kept; what is no finite number becomes null. Rows without a price are dropped."""
    text = {c for c, t in listings.dtypes if t == "string"}

    def finite(name: str) -> Column:
        value = F.col(name).try_cast("double")
        return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)

    return listings.withColumns({c: finite(c) for c in columns if c in text}).dropna(subset=["price"])


def request_problem() -> Column:
    """Reason a request row is invalid, or null."""
    def outside(name: str, low: int, high: int | None) -> Column:
        bad = F.col(name) < low
        return bad if high is None else bad | (F.col(name) > high)

    rules = [
        ("year", outside("year", 1900, 2100)),
        ("mileage_km", outside("mileage_km", 0, 2_000_000)),
        ("asking_price", outside("asking_price", 1, None)),
        ("changed_parts", outside("changed_parts", 0, 30)),
        ("painted_parts", outside("painted_parts", 0, 30)),
    ]
    lengths = {"brand": 80, "series": 100, "model": 140, "body_type": 60, "fuel_type": 60, "transmission": 60}
    rules += [(name, F.length(F.col(name)) > size) for name, size in lengths.items()]
    return F.coalesce(*[F.when(bad, name) for name, bad in rules])


def filter_problem() -> Column:
    """Reason a market filter row is invalid, or null."""
    return F.coalesce(
        F.when(~F.col("year_min").between(1900, 2100), "year_min"),
        F.when(~F.col("year_max").between(1900, 2100), "year_max"),
        F.when(~F.col("mileage_max").between(0, 2_000_000), "mileage_max"),
        F.when(F.col("year_min") > F.col("year_max"), "year_order"),
    )
