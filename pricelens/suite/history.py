"""Snapshot, mover, catalog and coverage queries."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from pricelens.operators.filters import ListingFilters
from pricelens.plans import coverage as cov, market, snapshots as snap
from pricelens.plans.clean_build import decide_rows
from pricelens.session import work_dir
from pricelens.sources import listings as src
from pricelens.sources.catalog import brand_map, canonical_entries, flatten_catalog, read_catalog, write_catalog
from pricelens.sources.warehouse import LISTINGS_SQL, listings, table
from pricelens.suite import messy
from pricelens.suite.registry import query, rounded, text_date

MONTHLY_SQL = f"""WITH {LISTINGS_SQL}, d AS MATERIALIZED (SELECT CAST(date_trunc('month', listing_day) AS DATE) AS snapshot_date, brand, price FROM listings WHERE price > 0),
snaps AS MATERIALIZED (
  SELECT snapshot_date, 'market' AS dimension_type, 'all' AS dimension_value, 'market:all' AS dimension_key, CAST(NULL AS VARCHAR) AS brand, avg(price) AS average_price,
         median(price) AS median_price, quantile_cont(price, 0.25) AS q1_price, quantile_cont(price, 0.75) AS q3_price, count(*) AS listing_count FROM d GROUP BY 1
  UNION ALL
  SELECT snapshot_date, 'brand', brand, 'brand:' || lower(brand), brand, avg(price), median(price), quantile_cont(price, 0.25), quantile_cont(price, 0.75), count(*)
  FROM d GROUP BY snapshot_date, brand HAVING count(*) >= 8)"""


def monthly(spark: SparkSession, sf: str) -> DataFrame:
    """Every month of listings as one snapshot."""
    rows = listings(spark, sf, ["brand", "price", "listing_day"])
    return snap.snapshot_rows(rows.withColumn("snapshot_date", F.trunc("listing_day", "month")))


_SNAP_COLUMNS = """strftime(snapshot_date, '%Y-%m-%d') AS snapshot_date, dimension_type, dimension_value, dimension_key, brand, round(average_price, 4) AS average_price,
  round(median_price, 4) AS median_price, round(q1_price, 4) AS q1_price, round(q3_price, 4) AS q3_price, listing_count"""


@query("market_snapshots", "A8", "U3", "T9", "I6", sql=f"{MONTHLY_SQL} SELECT {_SNAP_COLUMNS} FROM snaps")
def market_snapshots(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(monthly(spark, sf).withColumn("snapshot_date", text_date("snapshot_date")))


@query("snapshot_table", "S8", "I6", sql=f"{MONTHLY_SQL} SELECT {_SNAP_COLUMNS} FROM snaps")
def snapshot_table(spark: SparkSession, sf: str) -> DataFrame:
    # saved twice: the second run must leave the same rows

    path = f"{work_dir(spark)}/snapshots-{uuid.uuid4().hex}"
    rows = monthly(spark, sf)
    snap.save_snapshot(rows, path)
    snap.save_snapshot(rows, path)
    return rounded(snap.read_snapshots(spark, path).withColumn("snapshot_date", text_date("snapshot_date")))


def _change_sql(days: int) -> str:
    base = f"arg_max(median_price, snapshot_date) FILTER (snapshot_date <= latest - INTERVAL {days} DAY)"
    return f"CASE WHEN count(*) >= 2 THEN round((arg_max(median_price, snapshot_date) - {base}) / {base} * 100, 4) END"


@query("snapshot_changes", "J7", "C26", "T12", sql=f"""{MONTHLY_SQL}, l AS (SELECT *, max(snapshot_date) OVER (PARTITION BY dimension_type, dimension_value) AS latest FROM snaps)
SELECT dimension_type, dimension_value, strftime(max(snapshot_date), '%Y-%m-%d') AS latest_date, round(arg_max(median_price, snapshot_date), 4) AS latest_price,
  {_change_sql(30)} AS change_30d, {_change_sql(90)} AS change_90d, {_change_sql(365)} AS change_yoy FROM l GROUP BY 1, 2""")
def snapshot_changes(spark: SparkSession, sf: str) -> DataFrame:
    changes = snap.snapshot_changes(monthly(spark, sf))
    return rounded(changes.withColumn("latest_date", text_date("latest_date")))


def _overview_sql(where: str, kind: str, value: str) -> str:
    return f"""{MONTHLY_SQL}, l AS (SELECT *, max(snapshot_date) OVER () AS latest FROM snaps WHERE dimension_type = '{kind}' AND dimension_value = '{value}'),
c AS (SELECT {_change_sql(30)} AS change_30d, {_change_sql(90)} AS change_90d, {_change_sql(365)} AS change_yoy FROM l)
SELECT round(median(price), 4) AS median_price, round(avg(price), 4) AS average_price, count(*) AS listing_count,
  (SELECT strftime(max(scraped_at), '%Y-%m-%d') FROM listings) AS last_updated_at, any_value(change_30d) AS change_30d, any_value(change_90d) AS change_90d,
  any_value(change_yoy) AS change_yoy FROM listings, c WHERE price > 0 AND {where}"""


def _overview(spark: SparkSession, sf: str, filters: ListingFilters) -> DataFrame:
    rows = listings(spark, sf, ["brand", "year", "price", "scraped_at"])
    out = snap.overview_with_changes(market.overview(rows, filters), market.table_facts(rows), monthly(spark, sf), filters)
    return rounded(out.withColumn("last_updated_at", text_date("last_updated_at")))


@query("overview_with_changes", "D7", "C27", sql=_overview_sql("TRUE", "market", "all"))
def overview_with_changes(spark: SparkSession, sf: str) -> DataFrame:
    return _overview(spark, sf, ListingFilters())


@query("overview_of_brand", "D7", "C27", "T11", sql=_overview_sql("lower(brand) = 'brand#9'", "brand", "Brand#9"))
def overview_of_brand(spark: SparkSession, sf: str) -> DataFrame:
    return _overview(spark, sf, ListingFilters(brand="Brand#9"))


def _movers_sql(direction: str) -> str:
    compare, order = (">", "DESC") if direction == "up" else ("<", "ASC")
    return f"""{MONTHLY_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY dimension_value ORDER BY snapshot_date DESC) AS rn FROM snaps WHERE dimension_type = 'brand'),
p AS (SELECT a.dimension_value AS label, a.average_price, a.listing_count, (a.median_price - b.median_price) / b.median_price * 100 AS ch
      FROM r a JOIN r b ON a.dimension_value = b.dimension_value WHERE a.rn = 1 AND b.rn = 2)
SELECT label, round(average_price, 4) AS average_price, listing_count, round(ch, 4) AS change_percent, '{direction}' AS direction FROM p WHERE ch {compare} 0 ORDER BY ch {order}, label LIMIT 4"""


@query("movers_up", "D9", "W1", "J1", "K1", sql=_movers_sql("up"))
def movers_up(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(snap.movers(monthly(spark, sf), "up"))


@query("movers_down", "D9", "W1", "J1", "K1", sql=_movers_sql("down"))
def movers_down(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(snap.movers(monthly(spark, sf), "down"))


def catalog_entries(spark: SparkSession, sf: str) -> DataFrame:
    """Catalog from the part table: some names differ in spelling, some were never listed."""
    part = table(spark, sf, "part")
    return part.select(
        F.upper("p_brand").alias("brand"), F.when(F.col("p_size") > 48, F.concat("p_type", F.lit(" X"))).otherwise(F.col("p_type")).alias("series"),
        F.when(F.col("p_size") > 40, F.concat("p_name", F.lit(" plus"))).otherwise(F.col("p_name")).alias("model"),
    ).distinct()


def canonical(spark: SparkSession, sf: str) -> DataFrame:
    names = table(spark, sf, "part").select("p_brand").distinct()
    return canonical_entries(catalog_entries(spark, sf), brand_map(names))


_KEY = "regexp_replace(lower({0}), '[^a-z0-9]', '', 'g')"
_KEYS3 = ", ".join(f"{_KEY.format(c)} AS {k}" for c, k in (("brand", "bk"), ("series", "sk"), ("model", "mk")))
CATALOG_SQL = """cat AS MATERIALIZED (SELECT DISTINCT p_brand AS brand, CASE WHEN p_size > 48 THEN p_type || ' X' ELSE p_type END AS series,
  CASE WHEN p_size > 40 THEN p_name || ' plus' ELSE p_name END AS model FROM part)"""


def _coverage_sql(tables: str, rows: str) -> str:
    return f"""WITH {tables}, {CATALOG_SQL}, lk AS MATERIALIZED (SELECT {_KEYS3}, count(*) AS n FROM {rows} GROUP BY 1, 2, 3),
ck AS (SELECT *, {_KEYS3} FROM cat),
cbrands AS (SELECT DISTINCT brand, bk FROM ck), cseries AS (SELECT DISTINCT brand, series, bk, sk FROM ck),
rep AS (
  SELECT 'brand' AS level, brand, CAST(NULL AS VARCHAR) AS series, CAST(NULL AS VARCHAR) AS model,
         coalesce((SELECT sum(n) FROM lk WHERE lk.bk = cbrands.bk), 0) AS n, 7 AS low FROM cbrands
  UNION ALL SELECT 'series', brand, series, NULL, coalesce((SELECT sum(n) FROM lk WHERE lk.bk = cseries.bk AND lk.sk = cseries.sk), 0), 7 FROM cseries
  UNION ALL SELECT 'model', brand, series, model, coalesce((SELECT sum(n) FROM lk WHERE lk.bk = ck.bk AND lk.sk = ck.sk AND lk.mk = ck.mk), 0), 2 FROM ck),
report AS (SELECT level, brand, series, model, CAST(n AS BIGINT) AS listing_count, CASE WHEN n = 0 THEN 'missing' WHEN n <= low THEN 'low' ELSE 'covered' END AS status FROM rep)"""


COVERAGE_SQL = _coverage_sql(LISTINGS_SQL, "listings")


@query("catalog_coverage", "D10", "A11", "A12", "J5", "C12", sql=f"{COVERAGE_SQL} SELECT * FROM report")
def catalog_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return cov.coverage(listings(spark, sf, ["brand", "series", "model"]), canonical(spark, sf))


@query("coverage_of_raw", "D10", "J5", sql=f"{_coverage_sql(messy.KEYED_SQL, 'ok')} SELECT * FROM report")
def coverage_of_raw(spark: SparkSession, sf: str) -> DataFrame:
    # the clean table is still empty, so the raw rows that the rules accept are audited
    raw = messy.raw_listings(spark, sf)
    accepted = lambda rows: decide_rows(rows, brand_map(messy.brand_names(spark, sf)), messy.RULES, ["brand", "series", "model"]).where(F.col("rejection_reason").isNull())
    return cov.coverage(cov.audit_source(raw.limit(0), raw, accepted), canonical(spark, sf))


@query("coverage_totals", "A12", sql=f"{COVERAGE_SQL} SELECT level, status, count(*) AS entries FROM report GROUP BY 1, 2")
def coverage_totals(spark: SparkSession, sf: str) -> DataFrame:
    return cov.coverage_totals(cov.coverage(listings(spark, sf, ["brand", "series", "model"]), canonical(spark, sf)))


@query("coverage_csv", "S7", sql=f"{COVERAGE_SQL} SELECT brand, series, model AS package, listing_count, status FROM report WHERE level = 'model'")
def coverage_csv(spark: SparkSession, sf: str) -> DataFrame:

    folder = f"{work_dir(spark)}/coverage-{uuid.uuid4().hex}"
    cov.write_coverage(cov.coverage(listings(spark, sf, ["brand", "series", "model"]), canonical(spark, sf)), folder)
    schema = "brand string, series string, package string, listing_count bigint, status string"
    return spark.read.schema(schema).option("header", True).csv(f"{folder}/package_coverage")


@query("coverage_reports", "S7", sql=f"{COVERAGE_SQL} SELECT level, brand, series, model AS package, listing_count, status FROM report")
def coverage_reports(spark: SparkSession, sf: str) -> DataFrame:
    # all three report files, written and read back
    folder = f"{work_dir(spark)}/coverage-{uuid.uuid4().hex}"
    cov.write_coverage(cov.coverage(listings(spark, sf, ["brand", "series", "model"]), canonical(spark, sf)), folder)
    names = {"brand": ["brand"], "series": ["brand", "series"], "package": ["brand", "series", "package"]}
    every = ["brand", "series", "package", "listing_count", "status"]

    def report(level: str, columns: list[str]) -> DataFrame:
        schema = ", ".join(f"{c} string" for c in columns) + ", listing_count bigint, status string"
        rows = spark.read.schema(schema).option("header", True).csv(f"{folder}/{level}_coverage")
        shown = [F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in every]
        return rows.select(F.lit("model" if level == "package" else level).alias("level"), *shown)

    return reduce(DataFrame.unionByName, [report(level, columns) for level, columns in names.items()])


@query("catalog_flattened", "S5", sql="""SELECT DISTINCT upper(p_brand) AS brand, CASE WHEN p_size > 48 THEN p_type || ' X' ELSE p_type END AS series,
  CASE WHEN p_size > 40 THEN p_name || ' plus' ELSE p_name END AS model FROM part""")
def catalog_flattened(spark: SparkSession, sf: str) -> DataFrame:
    # written as catalog files, then read and flattened
    path = f"{work_dir(spark)}/catalog-{uuid.uuid4().hex}"
    write_catalog(catalog_entries(spark, sf), path)
    return flatten_catalog(read_catalog(spark, path, multi_line=False))


@query("model_options", "J6", "U1", sql=f"""WITH {LISTINGS_SQL}, {CATALOG_SQL}, l AS (
  SELECT model, count(*) AS n FROM listings WHERE price > 0 AND lower(brand) = 'brand#4' AND lower(series) = 'economy' GROUP BY 1),
names AS (SELECT trim(model) AS name FROM cat WHERE lower(brand) = 'brand#4' AND lower(series) = 'economy' UNION SELECT trim(model) FROM l)
SELECT name, coalesce(n, 0) AS listing_count FROM names LEFT JOIN l ON name = model WHERE name <> ''""")
def model_options(spark: SparkSession, sf: str) -> DataFrame:
    return cov.selector_options(listings(spark, sf, ["brand", "series", "model", "price"]), canonical(spark, sf), "model", "brand#4", "Economy")


@query("table_fallback", "S2", "S3", sql=f"WITH {LISTINGS_SQL} SELECT brand, count(*) AS listing_count FROM listings WHERE price > 0 GROUP BY 1")
def table_fallback(spark: SparkSession, sf: str) -> DataFrame:
    # the clean table is empty, so the raw one is served; columns it lacks appear with their defaults
    raw = listings(spark, sf, ["brand", "price"])
    full = src.with_full_schema(raw)
    served = src.load_listings(src.choose_table(full.limit(0), full))
    return served.groupBy("brand").agg(F.count("*").alias("listing_count"))
