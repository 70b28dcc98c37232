"""Listing pages to the raw table: parse, repair, keep recent rows, label, merge."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, functions as F

from pricelens.functions import text as tx, vocabulary as vocab
from pricelens.functions.dates import as_date, ingest_date
from pricelens.functions.folding import casefold
from pricelens.operators.merge import merge_into_table
from pricelens.session import materialize

@dataclass(frozen=True)
class IngestRun:
    """The merged batch and one row of counters: parsed, recent, old, unknown_date, added, upserted, stored."""

    rows: DataFrame
    counters: DataFrame


GENERAL, CLEAN_CLAIMED = "general_24h", "clean_24h"


@dataclass(frozen=True)
class PageFilters:
    """What a result page was filtered by; the site leaves the matching tags out of its rows."""

    brand: str | None = None
    series: str | None = None
    city: str | None = None
    district: str | None = None


def repair_shift(rows: DataFrame, filters: PageFilters) -> DataFrame:
    """Move tags back where a filtered page left out the brand or series tag, and set the filtered place."""
    out: dict[str, Column] = {}
    if filters.city:
        elsewhere = F.col("city").isNotNull() & (casefold(F.col("city")) != casefold(F.lit(filters.city)))
        no_district = F.coalesce("district", F.lit("")) == ""
        moved = F.when(no_district & elsewhere, F.col("city")).otherwise(F.col("district"))
        out["district"] = F.coalesce(F.nullif(moved, F.lit("")), F.lit(filters.district)) if filters.district else moved
        out["city"] = F.lit(filters.city)
    if filters.brand:
        brand, series, model, engine = (F.col(c) for c in ("brand", "series", "model", "engine"))
        key = tx.normalize_key(brand)
        same_brand = key == vocab.python_key(filters.brand)
        next_engine = F.coalesce(model, engine)
        if filters.series:
            series_key = vocab.python_key(filters.series)
            kept = same_brand & (series.isNull() | (tx.normalize_key(series) == series_key))
            one_missing = same_brand | (key == series_key)
            out["model"] = F.when(kept, model).when(one_missing, series).otherwise(brand)
            out["engine"] = F.when(kept, engine).when(one_missing, next_engine).otherwise(F.coalesce(series, model, engine))
            out["series"] = F.lit(filters.series)
        else:
            shifted = brand.isNotNull() & ~same_brand
            out["engine"] = F.when(shifted, next_engine).otherwise(engine)
            out["model"] = F.when(shifted, series).otherwise(model)
            out["series"] = F.when(shifted, brand).otherwise(series)
        out["brand"] = F.lit(filters.brand)
    # one projection: every rule reads the values from before the repair
    return rows.withColumns(out) if out else rows


def apply_query_defaults(rows: DataFrame, search: str) -> DataFrame:
    """A search for 'brand series...' fixes both fields of every row it returned."""
    words = search.split()
    values = {"brand": words[0] if words else None, "series": " ".join(words[1:]) or None}
    return rows.withColumns({c: F.lit(v) for c, v in values.items() if v})


def label_segment(rows: DataFrame, segment: str) -> DataFrame:
    """Segment name, and for the clean-claimed segment what its page filter guarantees."""
    labels: dict[str, Column] = {"scrape_segment": F.lit(segment)}
    if segment == CLEAN_CLAIMED:
        labels |= {
            "paint_status": F.lit(vocab.UNPAINTED), "changed_part_status": F.lit(vocab.UNCHANGED),
            "damage_status": F.lit(vocab.CLAIMED_BY_SEGMENT), "is_clean_claimed": F.lit(1),
        }
    return rows.withColumns(labels)


def with_recency(rows: DataFrame, cutoff: dt.date | str, run_date: dt.date | str) -> DataFrame:
    """Mark rows ``recent``, ``old`` or ``unknown``; unknown dates count as recent when kept."""
    dated = rows.withColumn("__day", ingest_date(F.col("listing_date"), run_date))
    label = F.when(F.col("__day").isNull(), "unknown").when(F.col("__day") >= as_date(cutoff), "recent").otherwise("old")
    return dated.withColumn("recency", label).drop("__day")


def keep_recent(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("recency") != "old").drop("recency")


COUNTERS = ("parsed", "recent", "old", "unknown_date")
#: Which of two captures of a listing is the newer one.
MERGE_ORDER = ("scraped_at", "page_key", "position")


def counter_columns() -> list[Column]:
    kind = F.col("recency")
    values = (F.count("*"), F.count_if(kind != "old"), F.count_if(kind == "old"), F.count_if(kind == "unknown"))
    return [v.alias(n) for n, v in zip(COUNTERS, values)]


def batch_counters(rows: DataFrame) -> DataFrame:
    """Parsed, recent (with unknown), old and unknown rows of one batch."""
    return rows.agg(*counter_columns())


def ingest_rows(
    parsed: DataFrame, table_path: str, filters: PageFilters, segment: str, *, cutoff: dt.date | str, run_date: dt.date | str, captured_at: str,
    search: str = "", batch_id: int = 0,
) -> IngestRun:
    """Parsed page rows into the raw table: repair, defaults, segment, recency, number and capture time, merge.

    Rows get an ``id`` from their source and listing id (or address), which a later capture of the same
    listing gets again, so merging is an upsert and a replayed batch changes nothing.
    """
    spark = parsed.sparkSession
    rows = apply_query_defaults(repair_shift(parsed, filters), search)
    rows = with_recency(label_segment(rows, segment), cutoff, run_date)
    identity = F.concat_ws("\x1f", "source", F.coalesce("source_listing_id", "listing_url", "title"))
    rows = rows.withColumns({"id": F.xxhash64(identity), "scraped_at": F.lit(captured_at).cast("timestamp")})
    # the counters are observed while the rows are written, not by passes of their own
    seen = Observation()
    rows = materialize(rows.observe(seen, *counter_columns()), "ingest-rows")
    recent = keep_recent(rows)
    merged = merge_into_table(spark, table_path, recent, MERGE_ORDER, batch_id=batch_id)
    unique = recent.agg(F.count_distinct("id")).scalar()
    observed = [F.lit(seen.get[c]).cast("bigint").alias(c) for c in COUNTERS]
    counters = merged.select(*observed, "added", (unique - F.col("added")).alias("upserted"), "stored")
    return IngestRun(recent, counters)
