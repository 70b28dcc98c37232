"""Listing view over the benchmark tables.

Only the tables behind the requested columns are joined: every line item has its order, part,
customer and nation, so a join that supplies no column would only cost a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# column -> (tables it needs beyond lineitem, expression)
_SPEC: dict[str, tuple[tuple[str, ...], str]] = {
    "id": ((), "concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber, cast(l_quantity as int))"),
    "source": ((), "'market'"),
    "source_listing_id": ((), "concat_ws('-', l_orderkey, l_linenumber)"),
    "title": (("part",), "concat_ws(' ', p_brand, p_type, p_name)"),
    "brand": (("part",), "p_brand"),
    "series": (("part",), "p_type"),
    "model": (("part",), "p_name"),
    "year": (("orders",), "year(o_orderdate)"),
    "mileage_km": ((), "cast(l_quantity * 10000 as int)"),
    "transmission": ((), "l_returnflag"),
    "fuel_type": (("orders",), "o_orderpriority"),
    "body_type": (("orders", "customer"), "c_mktsegment"),
    "city": (("orders", "customer", "nation"), "n_name"),
    "price": ((), "cast(round(l_extendedprice * 100) as bigint)"),
    "currency": ((), "'TRY'"),
    "listing_date": ((), "date_format(l_shipdate, 'yyyy-MM-dd')"),
    "listing_day": ((), "cast(l_shipdate as date)"),
    "listing_url": ((), "concat('https://listings.test/', l_orderkey, '/', l_linenumber)"),
    "is_clean_claimed": ((), "if(l_linestatus = 'F', 1, 0)"),
    "scraped_at": ((), "l_shipdate"),
    "changed_parts": ((), "cast(l_discount * 100 as int)"),
    "painted_parts": ((), "cast(l_tax * 100 as int)"),
}

LISTING_COLUMNS = tuple(_SPEC)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def listings(spark: SparkSession, sf_dir: str, columns: Iterable[str]) -> DataFrame:
    columns = list(columns)
    needed = {t for c in columns for t in _SPEC[c][0]}
    df = table(spark, sf_dir, "lineitem")
    if "part" in needed:
        df = df.join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    if "orders" in needed:
        df = df.join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    if "customer" in needed:
        df = df.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    if "nation" in needed:
        df = df.join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return df.select(*[expression(c).alias(c) for c in columns])


def expression(column: str) -> Column:
    return F.expr(_SPEC[column][1])


# The same view for the DuckDB oracle, always fully joined.
LISTINGS_SQL = """listings AS MATERIALIZED (
  SELECT concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber, cast(l_quantity as int)) AS id, 'market' AS source,
         concat_ws('-', l_orderkey, l_linenumber) AS source_listing_id,
         concat_ws(' ', p_brand, p_type, p_name) AS title, p_brand AS brand, p_type AS series, p_name AS model,
         year(o_orderdate) AS year, CAST(l_quantity * 10000 AS INTEGER) AS mileage_km, l_returnflag AS transmission,
         o_orderpriority AS fuel_type, c_mktsegment AS body_type, n_name AS city,
         CAST(round(l_extendedprice * 100) AS BIGINT) AS price, 'TRY' AS currency,
         strftime(l_shipdate, '%Y-%m-%d') AS listing_date, CAST(l_shipdate AS DATE) AS listing_day,
         concat('https://listings.test/', l_orderkey, '/', l_linenumber) AS listing_url,
         CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS is_clean_claimed, l_shipdate AS scraped_at,
         CAST(trunc(l_discount * 100) AS INTEGER) AS changed_parts, CAST(trunc(l_tax * 100) AS INTEGER) AS painted_parts
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey
       JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
)"""
