"""Market questions over a listing frame."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from pricelens.functions import vocabulary as vocab
from pricelens.functions.dates import listing_date
from pricelens.functions.text import turkish_lower
from pricelens.operators.bands import band_label, band_order
from pricelens.operators.lookup import lookup_join
from pricelens.operators.filters import ListingFilters, apply_filters, is_clean
from pricelens.operators.quantiles import QUARTILES, price_statistics

GROUPABLE = ("brand", "body_type", "fuel_type")
MIN_POINT_SAMPLE = 3


def _segments() -> dict[str, Column]:
    return {"all": F.lit(True), "clean": is_clean()}


def overview(listings: DataFrame, filters: ListingFilters | None = None) -> DataFrame:
    """Median, mean and count of the filtered listings (one row; nulls and a zero count when nothing matches)."""
    stats = price_statistics(apply_filters(listings, filters), [])
    return stats.select(
        F.col("median").alias("median_price"), F.col("mean").alias("average_price"), F.col("count").alias("listing_count")
    )


def price_quartiles(listings: DataFrame, keys: list[str]) -> DataFrame:
    names = dict(zip(("q1", "median", "q3"), QUARTILES))
    return price_statistics(apply_filters(listings), keys, quantiles=names)


def group_table(listings: DataFrame, group_by: str = "brand", filters: ListingFilters | None = None, limit: int = 100) -> DataFrame:
    """Largest groups by listing count, then by median."""
    column = group_by if group_by in GROUPABLE else "brand"
    if column not in listings.columns:
        return overview(listings).limit(0).withColumn("label", F.lit(None).cast("string"))
    labelled = apply_filters(listings, filters).select(F.trim(column).alias("label"), "price").where(F.col("label") != "")
    stats = price_statistics(labelled, ["label"])
    # the label settles ties so the cut is the same on every run
    return (
        stats.select("label", F.col("mean").alias("average_price"), F.col("median").alias("median_price"), F.col("count").alias("listing_count"))
        .orderBy(F.desc("listing_count"), F.desc("median_price"), "label")
        .limit(limit)
    )


def search_table(table: DataFrame, search: str = "", sort: str = "listing_count", descending: bool = True) -> DataFrame:
    """Label search with Turkish letter case and re-sort by any column, nulls lowest."""
    hits = table.where(turkish_lower(F.col("label")).contains(search.replace("I", "ı").replace("İ", "i").lower()))
    return hits.orderBy(F.desc_nulls_last(sort) if descending else F.asc_nulls_first(sort))


def _points(stats: DataFrame) -> DataFrame:
    return stats.where(F.col("count") >= MIN_POINT_SAMPLE).select(
        "segment", "position", "label", F.col("median").alias("median_price"),
        F.col("mean").alias("average_price"), F.col("count").alias("listing_count"),
    )


def year_points(listings: DataFrame, filters: ListingFilters | None = None) -> DataFrame:
    """Price by model year for all and for clean-claimed listings."""
    rows = apply_filters(listings, filters).where(F.col("year").between(1950, 2100))
    stats = price_statistics(rows, ["year"], segments=_segments())
    return _points(stats.withColumns({"position": F.col("year").cast("int"), "label": F.col("year").cast("string")}))


def mileage_points(listings: DataFrame, filters: ListingFilters | None = None) -> DataFrame:
    """Price by fixed mileage band for all and for clean-claimed listings."""
    km = F.col("mileage_km")
    rows = apply_filters(listings, filters).withColumns(
        {"position": band_order(km, vocab.MILEAGE_BANDS), "label": band_label(km, vocab.MILEAGE_BANDS)}
    ).where(F.col("label").isNotNull())
    return _points(price_statistics(rows, ["position", "label"], segments=_segments()))


def attach_clean_points(points: DataFrame) -> DataFrame:
    """All-listing points with the clean-claimed figures of the same label beside them."""
    clean = points.where(F.col("segment") == "clean").select(
        "label", F.col("median_price").alias("clean_median_price"), F.col("listing_count").alias("clean_listing_count")
    )
    return points.where(F.col("segment") == "all").drop("segment").join(clean, "label", "left")


def relationship_summary(listings: DataFrame, filters: ListingFilters | None = None) -> DataFrame:
    """Row counts and availability flags of the year and mileage comparisons, in one pass.

    Availability needs only counts, so no price statistic is computed here.
    """
    km = F.col("mileage_km")
    clean = is_clean()
    rows = apply_filters(listings, filters).select(
        F.when(F.col("year").between(1950, 2100), F.col("year")).alias("y"),
        band_order(km, vocab.MILEAGE_BANDS).alias("b"), F.when(clean, 1).otherwise(0).alias("c"),
    )
    cells = rows.groupBy("y", "b").agg(F.count("*").alias("n"), F.sum("c").alias("nc"))
    # at most 151 years x 9 bands from here on
    years = cells.where(F.col("y").isNotNull()).groupBy("y").agg(F.sum("n").alias("n"), F.sum("nc").alias("nc"))
    bands = cells.where(F.col("b").isNotNull()).groupBy("b").agg(F.sum("n").alias("n"), F.sum("nc").alias("nc"))
    parts = [
        cells.select(F.lit("total").alias("kind"), "n", "nc"),
        years.select(F.lit("year").alias("kind"), "n", "nc"),
        bands.select(F.lit("mileage").alias("kind"), "n", "nc"),
    ]
    kinds = parts[0].unionByName(parts[1]).unionByName(parts[2])

    def available(kind: str, counter: str) -> Column:
        return F.coalesce(F.max((F.col("kind") == kind) & (F.col(counter) >= MIN_POINT_SAMPLE)), F.lit(False))

    total = F.col("kind") == "total"
    return kinds.agg(
        F.coalesce(F.sum(F.when(total, F.col("n"))), F.lit(0)).alias("listing_count"),
        F.coalesce(F.sum(F.when(total, F.col("nc"))), F.lit(0)).alias("clean_listing_count"),
        available("year", "n").alias("year_available"), available("mileage", "n").alias("mileage_available"),
        available("year", "nc").alias("clean_year_available"), available("mileage", "nc").alias("clean_mileage_available"),
    )


def with_listing_day(listings: DataFrame, run_date: dt.date | str) -> DataFrame:
    if "listing_day" in listings.columns:
        return listings
    # each written date is parsed once, however many listings share it
    days = listings.select("listing_date").distinct().withColumn("listing_day", listing_date(F.col("listing_date"), run_date))
    return lookup_join(listings, days, ["listing_date"])


def daily_trend(
    listings: DataFrame, run_date: dt.date | str, filters: ListingFilters | None = None,
    start: dt.date | str | None = None, end: dt.date | str | None = None,
) -> DataFrame:
    """Price per publication day with clean-claimed figures attached; clean columns are null when absent."""
    rows = with_listing_day(apply_filters(listings, filters), run_date).where(F.col("listing_day").isNotNull())
    if start:
        rows = rows.where(F.col("listing_day") >= F.lit(str(start)).cast("date"))
    if end:
        rows = rows.where(F.col("listing_day") <= F.lit(str(end)).cast("date"))
    if "is_clean_claimed" not in rows.columns:
        rows = rows.withColumn("is_clean_claimed", F.lit(0))
    stats = price_statistics(rows, ["listing_day"], segments=_segments())
    # days x 2 rows: fold the two segments of a day into one row without a second pass over listings
    pick = lambda seg, col: F.max(F.when(F.col("segment") == seg, F.col(col)))
    return stats.groupBy(F.col("listing_day").alias("date")).agg(
        pick("all", "median").alias("median_price"), pick("all", "mean").alias("average_price"),
        pick("all", "count").alias("listing_count"), pick("clean", "median").alias("clean_median_price"),
        pick("clean", "mean").alias("clean_average_price"), pick("clean", "count").alias("clean_listing_count"),
    )


def trend_summary(trend: DataFrame, clean_rows: DataFrame | None = None) -> DataFrame:
    """Availability of a trend: two dates for the line, two clean dates for its clean companion."""
    dates, clean_dates = F.count("*"), F.count("clean_listing_count")
    return trend.agg(
        (dates >= 2).alias("available"), ((dates >= 2) & (clean_dates >= 2)).alias("clean_available"),
        dates.alias("date_count"), clean_dates.alias("clean_date_count"),
        F.coalesce(F.sum("listing_count"), F.lit(0)).alias("dated_listing_count"),
    )


def newest_listings(listings: DataFrame, filters: ListingFilters | None = None, limit: int = 12) -> DataFrame:
    """Most recently seen listings shaped for display."""
    shown = ["id", "title", "brand", "series", "model", "year", "mileage_km", "price", "city", "listing_date", "listing_url"]
    rows = apply_filters(listings, filters)
    top = rows.orderBy(F.desc_nulls_last("scraped_at"), *([F.desc("id")] if "id" in rows.columns else [])).limit(limit)
    out = [F.col(c) if c in rows.columns else F.lit(None).alias(c) for c in shown if c not in ("title", "price")]
    title = F.coalesce(F.nullif(F.col("title"), F.lit("")), F.lit(vocab.UNTITLED)) if "title" in rows.columns else F.lit(vocab.UNTITLED)
    return top.select(*out, title.alias("title"), F.col("price").cast("double").alias("price"), F.lit(None).cast("double").alias("similarity_score"))


def distinct_values(listings: DataFrame, column: str, filters: ListingFilters | None = None) -> DataFrame:
    return (
        apply_filters(listings, filters).select(F.trim(column).alias("name")).where(F.col("name") != "").distinct().orderBy("name")
    )


def selector_counts(listings: DataFrame, column: str, filters: ListingFilters | None = None) -> DataFrame:
    rows = apply_filters(listings, filters).where(F.col(column).isNotNull())
    return rows.groupBy(F.col(column).alias("name")).agg(F.count("*").alias("listing_count"))


def table_facts(listings: DataFrame) -> DataFrame:
    """Row count and newest capture time of the unfiltered table."""
    newest = F.max("scraped_at") if "scraped_at" in listings.columns else F.lit(None).cast("timestamp")
    return listings.agg(F.count("*").alias("listing_count"), newest.alias("last_updated_at"))
