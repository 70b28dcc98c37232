"""Listing tables: choice of table, projection and schema growth."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pricelens.operators.filters import ListingFilters, apply_filters, coerce_numbers
from pricelens.schemas import RAW_LISTING, STATUS_COLUMNS, ensure_columns

SERVED_COLUMNS = (
    "id", "title", "brand", "series", "model", "year", "mileage_km", "transmission", "fuel_type", "body_type", "city",
    "district", "price", "currency", "listing_date", "listing_url", "image_url", "is_clean_claimed", "scraped_at",
)


class ListingsUnavailable(RuntimeError):
    """No listing table exists."""


def read_table(spark: SparkSession, path: str) -> DataFrame | None:
    """The Parquet table with all column generations merged, or None when there is none."""
    try:
        return spark.read.option("mergeSchema", True).parquet(path)
    except Exception as error:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(error) or "UNABLE_TO_INFER_SCHEMA" in str(error):
            return None
        raise


def choose_table(clean: DataFrame | None, raw: DataFrame | None) -> DataFrame:
    """Clean rows if there are any, else raw rows, else whichever empty table exists."""
    present = [t for t in (clean, raw) if t is not None]
    if not present:
        raise ListingsUnavailable("no listing table exists")
    return next((t for t in present if not t.limit(1).isEmpty()), present[0])


def load_listings(listings: DataFrame, filters: ListingFilters | None = None) -> DataFrame:
    """Served columns that exist, numbers coerced, filters applied; the price column is required."""
    if "price" not in listings.columns:
        raise ListingsUnavailable("the listing table has no price column")
    shown = listings.select(*[c for c in SERVED_COLUMNS if c in listings.columns])
    return apply_filters(coerce_numbers(shown), filters)


def with_full_schema(raw: DataFrame) -> DataFrame:
    """Raw table of any age with today's columns; flags default to 0 and rows to active."""
    full = ensure_columns(ensure_columns(raw, RAW_LISTING), STATUS_COLUMNS)
    return full.withColumns({
        "is_clean_claimed": F.coalesce("is_clean_claimed", F.lit(0)), "is_active": F.coalesce("is_active", F.lit(1)),
        "currency": F.coalesce("currency", F.lit("TRY")),
    })
