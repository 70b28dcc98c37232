"""Dated market snapshots, their changes over time, and movers."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from pricelens.functions.folding import casefold
from pricelens.functions.scoring import percent_change
from pricelens.functions.text import strip
from pricelens.operators.filters import ListingFilters, apply_filters
from pricelens.operators.quantiles import QUARTILES, statistics_from_counts, value_counts
from pricelens.schemas import SNAPSHOT, conform
from pricelens.session import materialize

MIN_BRAND_ROWS = 8
LOOKBACKS = {"change_30d": 30, "change_90d": 90, "change_yoy": 365}
TOP_MOVERS = 4


def snapshot_rows(listings: DataFrame, date_column: str = "snapshot_date") -> DataFrame:
    """Market row and one row per brand with enough listings, for every snapshot date in the frame.

    Both levels come from one (date, brand, price) count: the market level adds the brands up.
    """
    counts = value_counts(apply_filters(listings), [date_column, "brand"], "price")
    brand = counts.where(F.col("brand").isNotNull()).withColumn("level", F.lit("brand"))
    market = counts.groupBy(date_column, "price").agg(F.sum("__n").alias("__n"))
    market = market.withColumns({"brand": F.lit(None).cast("string"), "level": F.lit("market")})
    names = dict(zip(("q1", "median", "q3"), QUARTILES))
    stats = statistics_from_counts(brand.unionByName(market), [date_column, "level", "brand"], "price", names)
    stats = stats.where((F.col("level") == "market") | (F.col("count") >= MIN_BRAND_ROWS))
    value = F.when(F.col("level") == "market", "all").otherwise(strip(F.col("brand")))
    keyed = stats.withColumns({
        "dimension_value": value,
        "dimension_key": F.concat_ws(":", "level", F.when(F.col("level") == "market", "all").otherwise(casefold(value))),
    })
    # spellings that fold to one key collide: the first spelling keeps its name, the last one its figures
    order = F.coalesce("brand", F.lit(""))
    merged = keyed.groupBy(F.col(date_column).alias("snapshot_date"), F.col("level").alias("dimension_type"), "dimension_key").agg(
        F.min_by("dimension_value", order).alias("dimension_value"), F.min_by("brand", order).alias("raw_brand"),
        *[F.max_by(src, order).alias(name) for src, name in (
            ("mean", "average_price"), ("median", "median_price"), ("q1", "q1_price"), ("q3", "q3_price"), ("count", "listing_count"),
        )],
    )
    return conform(merged.withColumn("brand", strip(F.col("raw_brand"))), SNAPSHOT)


def daily_snapshot(listings: DataFrame, day: dt.date | str) -> DataFrame:
    return snapshot_rows(listings.withColumn("snapshot_date", F.lit(str(day)).cast("date")))


def save_snapshot(rows: DataFrame, path: str) -> None:
    """Upsert on (date, type, key): the dates present in ``rows`` are rewritten, others stay."""
    spark = rows.sparkSession
    rows = materialize(rows, "snapshot-new")
    try:
        stored = conform(spark.read.parquet(path), SNAPSHOT)
    except Exception as error:  # noqa: BLE001 - only a missing table means "first snapshot"
        if "PATH_NOT_FOUND" not in str(error):
            raise
        stored = rows.limit(0)
    keys = ["snapshot_date", "dimension_type", "dimension_key"]
    touched = stored.join(F.broadcast(rows.select("snapshot_date").distinct()), "snapshot_date", "left_semi")
    merged = materialize(rows.unionByName(touched.join(rows.select(*keys), keys, "left_anti")), "snapshot-merged")
    writer = merged.repartition("snapshot_date").write.mode("overwrite").partitionBy("snapshot_date")
    writer.option("partitionOverwriteMode", "dynamic").parquet(path)


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    return conform(spark.read.parquet(path), SNAPSHOT)


def snapshot_changes(snapshots: DataFrame) -> DataFrame:
    """Latest median per dimension against the last one on or before 30, 90 and 365 days earlier.

    A dimension has one row per day, so the per-dimension window stays short.
    """
    latest = F.max("snapshot_date").over(W.partitionBy("dimension_type", "dimension_value"))
    rows = snapshots.withColumn("latest", latest)
    price = F.col("median_price")
    bases = [
        F.max_by(F.when(F.col("snapshot_date") <= F.date_sub("latest", days), price), F.when(F.col("snapshot_date") <= F.date_sub("latest", days), F.col("snapshot_date"))).alias(f"base_{name}")
        for name, days in LOOKBACKS.items()
    ]
    folded = rows.groupBy("dimension_type", "dimension_value").agg(
        F.count("*").alias("snapshots"), F.max("snapshot_date").alias("latest_date"), F.max_by(price, "snapshot_date").alias("latest_price"), *bases
    )
    changes = [F.when(F.col("snapshots") >= 2, percent_change(F.col("latest_price"), F.col(f"base_{n}"))).alias(n) for n in LOOKBACKS]
    return folded.select("dimension_type", "dimension_value", "latest_date", "latest_price", *changes)


def overview_with_changes(overview: DataFrame, facts: DataFrame, snapshots: DataFrame, filters: ListingFilters | None = None) -> DataFrame:
    """Overview row with table facts and, when the filter equals a snapshot dimension, its changes."""
    scope = (filters or ListingFilters()).snapshot_scope()
    out = overview.withColumn("last_updated_at", facts.select("last_updated_at").scalar())
    if scope is None:
        return out.withColumns({name: F.lit(None).cast("double") for name in LOOKBACKS})
    kind, value = scope
    matching = snapshots.where((F.col("dimension_type") == kind) & (F.col("dimension_value") == value))
    # a scalar of an aggregate is null, not missing, when there is no history
    changes = snapshot_changes(matching).agg(F.max(F.struct(*LOOKBACKS)).alias("changes")).scalar()
    return out.withColumn("changes", changes).select("*", *[F.col(f"changes.{name}").alias(name) for name in LOOKBACKS]).drop("changes")


def movers(snapshots: DataFrame, direction: str = "down", limit: int = TOP_MOVERS) -> DataFrame:
    """Brands with the largest change between their two newest snapshots, in one direction."""
    newest = W.partitionBy("dimension_value").orderBy(F.desc("snapshot_date"))
    brands = snapshots.where(F.col("dimension_type") == "brand")
    ranked = brands.withColumns({"rank": F.row_number().over(newest), "previous": F.lead("median_price").over(newest)})
    change = percent_change(F.col("median_price"), F.col("previous"))
    latest = ranked.where(F.col("rank") == 1).select(
        F.col("dimension_value").alias("label"), "average_price", "listing_count", change.alias("change_percent")
    )
    up = direction == "up"
    moved = latest.where(F.col("change_percent") > 0 if up else F.col("change_percent") < 0).withColumn("direction", F.lit("up" if up else "down"))
    return moved.orderBy(F.desc("change_percent") if up else F.asc("change_percent"), "label").limit(limit)
