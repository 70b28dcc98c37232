"""Table schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

RAW_LISTING = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("source", T.StringType()),
    T.StructField("source_listing_id", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("brand", T.StringType()),
    T.StructField("series", T.StringType()),
    T.StructField("model", T.StringType()),
    T.StructField("year", T.IntegerType()),
    T.StructField("mileage_km", T.IntegerType()),
    T.StructField("transmission", T.StringType()),
    T.StructField("fuel_type", T.StringType()),
    T.StructField("body_type", T.StringType()),
    T.StructField("color", T.StringType()),
    T.StructField("engine", T.StringType()),
    T.StructField("city", T.StringType()),
    T.StructField("district", T.StringType()),
    T.StructField("seller_type", T.StringType()),
    T.StructField("price", T.LongType()),
    T.StructField("currency", T.StringType()),
    T.StructField("listing_date", T.StringType()),
    T.StructField("listing_url", T.StringType()),
    T.StructField("image_url", T.StringType()),
    T.StructField("paint_status", T.StringType()),
    T.StructField("changed_part_status", T.StringType()),
    T.StructField("damage_status", T.StringType()),
    T.StructField("is_clean_claimed", T.IntegerType()),
    T.StructField("scrape_segment", T.StringType()),
    T.StructField("scraped_at", T.TimestampType()),
])

STATUS_COLUMNS = T.StructType([
    T.StructField("is_active", T.IntegerType()),
    T.StructField("status_checked_at", T.TimestampType()),
    T.StructField("removed_at", T.TimestampType()),
    T.StructField("status_reason", T.StringType()),
])

SNAPSHOT = T.StructType([
    T.StructField("snapshot_date", T.DateType()),
    T.StructField("dimension_type", T.StringType()),
    T.StructField("dimension_value", T.StringType()),
    T.StructField("dimension_key", T.StringType()),
    T.StructField("brand", T.StringType()),
    T.StructField("average_price", T.DoubleType()),
    T.StructField("median_price", T.DoubleType()),
    T.StructField("q1_price", T.DoubleType()),
    T.StructField("q3_price", T.DoubleType()),
    T.StructField("listing_count", T.LongType()),
])

CATALOG = T.StructType([
    T.StructField("brands", T.ArrayType(T.StructType([
        T.StructField("name", T.StringType()),
        T.StructField("series", T.ArrayType(T.StructType([
            T.StructField("name", T.StringType()),
            T.StructField("models", T.ArrayType(T.StringType())),
        ]))),
    ]))),
])

REQUEST = T.StructType([
    T.StructField("request_id", T.StringType()),
    T.StructField("brand", T.StringType()),
    T.StructField("series", T.StringType()),
    T.StructField("model", T.StringType()),
    T.StructField("body_type", T.StringType()),
    T.StructField("fuel_type", T.StringType()),
    T.StructField("transmission", T.StringType()),
    T.StructField("year", T.IntegerType()),
    T.StructField("mileage_km", T.LongType()),
    T.StructField("asking_price", T.LongType()),
    T.StructField("clean_only", T.BooleanType()),
    T.StructField("changed_parts", T.IntegerType()),
    T.StructField("painted_parts", T.IntegerType()),
])

TRAINING = T.StructType([
    T.StructField("marka", T.StringType()),
    T.StructField("seri", T.StringType()),
    T.StructField("model", T.StringType()),
    T.StructField("yil", T.DoubleType()),
    T.StructField("kilometre", T.DoubleType()),
    T.StructField("degisen_sayisi", T.DoubleType()),
    T.StructField("boyali_sayisi", T.DoubleType()),
    T.StructField("fiyat", T.DoubleType()),
])


def ensure_columns(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Add the schema's missing columns as typed nulls; existing columns are left alone."""
    missing = {f.name: F.lit(None).cast(f.dataType) for f in schema if f.name not in df.columns}
    return df.withColumns(missing) if missing else df


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Exactly the schema's columns in its order and types."""
    full = ensure_columns(df, schema)
    return full.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])
