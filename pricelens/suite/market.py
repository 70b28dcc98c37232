"""Market questions: scans, filters, summaries, trends."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pricelens.operators.bands import band_label, default_price_bands
from pricelens.operators.filters import coerce_numbers, ListingFilters, apply_filters
from pricelens.plans import market
from pricelens.sources.warehouse import LISTINGS_SQL, listings
from pricelens.suite.registry import query, rounded, text_date

RUN_DATE = "2026-07-01"
WITH = f"WITH {LISTINGS_SQL}"
NARROW = ListingFilters(brand=" brand#7 ", series="economy", year_min=1996, year_max=2000, mileage_max=300_000, clean_only=True)
NARROW_SQL = """price > 0 AND lower(coalesce(brand, '')) = 'brand#7' AND lower(coalesce(series, '')) = 'economy'
  AND year >= 1996 AND year <= 2000 AND mileage_km <= 300000 AND is_clean_claimed = 1"""
CLEAN = "is_clean_claimed = 1"


@query("filtered_listing_scan", "S1", "F1", "F2", "F3", "F4", sql=f"""{WITH}
SELECT id, title, brand, series, model, year, mileage_km, city, price, listing_date FROM listings WHERE {NARROW_SQL}""")
def filtered_listing_scan(spark: SparkSession, sf: str) -> DataFrame:
    cols = ["id", "title", "brand", "series", "model", "year", "mileage_km", "city", "price", "listing_date", "is_clean_claimed"]
    return apply_filters(listings(spark, sf, cols), NARROW).drop("is_clean_claimed")


@query("overview_all", "A1", sql=f"""{WITH}
SELECT round(median(price), 4) AS median_price, round(avg(price), 4) AS average_price, count(*) AS listing_count
FROM listings WHERE price > 0""")
def overview_all(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(market.overview(listings(spark, sf, ["price"])))


@query("overview_filtered", "A1", "F2", "F3", "F4", sql=f"""{WITH}
SELECT round(median(price), 4) AS median_price, round(avg(price), 4) AS average_price, count(*) AS listing_count
FROM listings WHERE {NARROW_SQL}""")
def overview_filtered(spark: SparkSession, sf: str) -> DataFrame:
    cols = ["brand", "series", "year", "mileage_km", "is_clean_claimed", "price"]
    return rounded(market.overview(listings(spark, sf, cols), NARROW))


def _table_sql(column: str) -> str:
    return f"""{WITH}
SELECT trim({column}) AS label, round(avg(price), 4) AS average_price, round(median(price), 4) AS median_price,
       count(*) AS listing_count
FROM listings WHERE price > 0 AND trim({column}) <> '' GROUP BY 1 ORDER BY 4 DESC, 3 DESC, 1 LIMIT 100"""


def _register_tables() -> None:
    for column in market.GROUPABLE:
        def run(spark: SparkSession, sf: str, column: str = column) -> DataFrame:
            return rounded(market.group_table(listings(spark, sf, [column, "price"]), column))
        query(f"table_by_{column}", "A2", "K2", sql=_table_sql(column))(run)


_register_tables()


@query("table_search", "F20", sql=f"""{WITH}
SELECT * FROM (SELECT trim(brand) AS label, round(avg(price), 4) AS average_price, round(median(price), 4) AS median_price,
       count(*) AS listing_count
FROM listings WHERE price > 0 GROUP BY 1 ORDER BY 4 DESC, 3 DESC, 1 LIMIT 100) WHERE contains(lower(label), 'd#1')""")
def table_search(spark: SparkSession, sf: str) -> DataFrame:
    table = market.group_table(listings(spark, sf, ["brand", "price"]), "brand")
    return rounded(market.search_table(table, "D#1", "median_price", descending=False))


@query("price_by_year", "A5", "A6b", "F7", sql=f"""{WITH}, rows AS (
  SELECT 'all' AS segment, year, price FROM listings WHERE price > 0
  UNION ALL SELECT 'clean', year, price FROM listings WHERE price > 0 AND {CLEAN})
SELECT segment, CAST(year AS INTEGER) AS position, CAST(year AS VARCHAR) AS label, round(median(price), 4) AS median_price,
       round(avg(price), 4) AS average_price, count(*) AS listing_count
FROM rows WHERE year BETWEEN 1950 AND 2100 GROUP BY segment, year HAVING count(*) >= 3""")
def price_by_year(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(market.year_points(listings(spark, sf, ["year", "is_clean_claimed", "price"])))


BAND_SQL = """CASE WHEN mileage_km BETWEEN 0 AND 25000 THEN 0 WHEN mileage_km BETWEEN 25001 AND 50000 THEN 1
  WHEN mileage_km BETWEEN 50001 AND 75000 THEN 2 WHEN mileage_km BETWEEN 75001 AND 100000 THEN 3
  WHEN mileage_km BETWEEN 100001 AND 150000 THEN 4 WHEN mileage_km BETWEEN 150001 AND 200000 THEN 5
  WHEN mileage_km BETWEEN 200001 AND 300000 THEN 6 WHEN mileage_km BETWEEN 300001 AND 500000 THEN 7
  WHEN mileage_km >= 500001 THEN 8 END"""
LABEL_SQL = """CASE position WHEN 0 THEN '0-25 bin km' WHEN 1 THEN '25-50 bin km' WHEN 2 THEN '50-75 bin km'
  WHEN 3 THEN '75-100 bin km' WHEN 4 THEN '100-150 bin km' WHEN 5 THEN '150-200 bin km' WHEN 6 THEN '200-300 bin km'
  WHEN 7 THEN '300-500 bin km' WHEN 8 THEN '500 bin km+' END"""


@query("price_by_mileage_band", "A6", "A6b", "J11", sql=f"""{WITH}, rows AS (
  SELECT 'all' AS segment, {BAND_SQL} AS position, price FROM listings WHERE price > 0
  UNION ALL SELECT 'clean', {BAND_SQL}, price FROM listings WHERE price > 0 AND {CLEAN})
SELECT segment, position, {LABEL_SQL} AS label, round(median(price), 4) AS median_price,
       round(avg(price), 4) AS average_price, count(*) AS listing_count
FROM rows WHERE position IS NOT NULL GROUP BY segment, position HAVING count(*) >= 3""")
def price_by_mileage_band(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(market.mileage_points(listings(spark, sf, ["mileage_km", "is_clean_claimed", "price"])))


@query("year_points_with_clean", "J3", sql=f"""{WITH}, a AS (
  SELECT year, round(median(price), 4) AS median_price, round(avg(price), 4) AS average_price, count(*) AS listing_count
  FROM listings WHERE price > 0 AND year BETWEEN 1950 AND 2100 GROUP BY year HAVING count(*) >= 3), c AS (
  SELECT year, round(median(price), 4) AS clean_median_price, count(*) AS clean_listing_count
  FROM listings WHERE price > 0 AND {CLEAN} AND year BETWEEN 1950 AND 2100 GROUP BY year HAVING count(*) >= 3)
SELECT CAST(a.year AS VARCHAR) AS label, CAST(a.year AS INTEGER) AS position, median_price, average_price, listing_count,
       clean_median_price, clean_listing_count FROM a LEFT JOIN c USING (year)""")
def year_points_with_clean(spark: SparkSession, sf: str) -> DataFrame:
    points = market.year_points(listings(spark, sf, ["year", "is_clean_claimed", "price"]))
    return rounded(market.attach_clean_points(points))


@query("relationship_summary", "A6b", sql=f"""{WITH}, l AS (SELECT *, {BAND_SQL} AS band FROM listings WHERE price > 0)
SELECT (SELECT count(*) FROM l) AS listing_count, (SELECT count(*) FROM l WHERE {CLEAN}) AS clean_listing_count,
  EXISTS (SELECT 1 FROM l WHERE year BETWEEN 1950 AND 2100 GROUP BY year HAVING count(*) >= 3) AS year_available,
  EXISTS (SELECT 1 FROM l WHERE band IS NOT NULL GROUP BY band HAVING count(*) >= 3) AS mileage_available,
  EXISTS (SELECT 1 FROM l WHERE {CLEAN} AND year BETWEEN 1950 AND 2100 GROUP BY year HAVING count(*) >= 3) AS clean_year_available,
  EXISTS (SELECT 1 FROM l WHERE {CLEAN} AND band IS NOT NULL GROUP BY band HAVING count(*) >= 3) AS clean_mileage_available""")
def relationship_summary(spark: SparkSession, sf: str) -> DataFrame:
    return market.relationship_summary(listings(spark, sf, ["year", "mileage_km", "is_clean_claimed", "price"]))


TREND_SQL = f"""{WITH}, d AS (
  SELECT listing_day, median(price) AS median_price, avg(price) AS average_price, count(*) AS listing_count
  FROM listings WHERE price > 0 GROUP BY 1), c AS (
  SELECT listing_day, median(price) AS clean_median_price, avg(price) AS clean_average_price, count(*) AS clean_listing_count
  FROM listings WHERE price > 0 AND {CLEAN} GROUP BY 1)"""


@query("daily_trend", "A7", "D8", "J2", "C16", sql=f"""{TREND_SQL}
SELECT strftime(listing_day, '%Y-%m-%d') AS date, round(median_price, 4) AS median_price, round(average_price, 4) AS average_price,
       listing_count, round(clean_median_price, 4) AS clean_median_price, round(clean_average_price, 4) AS clean_average_price,
       clean_listing_count FROM d LEFT JOIN c USING (listing_day)
WHERE listing_day BETWEEN DATE '1996-03-01' AND DATE '2000-06-30'""")
def daily_trend(spark: SparkSession, sf: str) -> DataFrame:
    # the date is parsed from its text form, as the listing table stores it
    rows = listings(spark, sf, ["listing_date", "is_clean_claimed", "price"])
    trend = market.daily_trend(rows, RUN_DATE, start="1996-03-01", end="2000-06-30")
    return rounded(trend.withColumn("date", text_date("date")))


# One line per layout: Spark expression, DuckDB expression, both of listing_day.
_LAYOUTS = (
    ("date_format(listing_day, 'yyyy-MM-dd') || 'T12:00:00Z'", "strftime(listing_day, '%Y-%m-%d') || 'T12:00:00Z'"), ("date_format(listing_day, 'dd.MM.yy')", "strftime(listing_day, '%d.%m.%y')"),
    ("date_format(listing_day, 'MMM d, yyyy')", "strftime(listing_day, '%b %-d, %Y')"), ("date_format(listing_day, 'd-MMM-yyyy')", "strftime(listing_day, '%-d-%b-%Y')"),
    ("date_format(listing_day, 'yyyyMMdd')", "strftime(listing_day, '%Y%m%d')"), ("date_format(listing_day, 'yyyy.MM.dd')", "strftime(listing_day, '%Y.%m.%d')"),
    ("date_format(listing_day, 'd/M/yyyy') || ' 12:30:45'", "strftime(listing_day, '%-d/%-m/%Y') || ' 12:30:45'"), ("date_format(listing_day, 'yyyy-MM-dd') || ' 01:02:03.123456'", "strftime(listing_day, '%Y-%m-%d') || ' 01:02:03.123456'"),
    ("date_format(listing_day, 'd-M-yyyy')", "strftime(listing_day, '%-d-%-m-%Y')"), ("'not a date'", "'not a date'"),
)


@query("general_dates", "C16", sql=f"""{WITH}
SELECT id, CASE mileage_km // 10000 % {len(_LAYOUTS)} {' '.join(f'WHEN {i} THEN {d}' for i, (_, d) in enumerate(_LAYOUTS))} END AS listing_date,
  CASE WHEN mileage_km // 10000 % {len(_LAYOUTS)} <> {len(_LAYOUTS) - 1} THEN strftime(listing_day, '%Y-%m-%d') END AS day FROM listings""")
def general_dates(spark: SparkSession, sf: str) -> DataFrame:
    kind = f"mileage_km div 10000 % {len(_LAYOUTS)}"
    written = F.expr(f"case {' '.join(f'when {kind} = {i} then {e}' for i, (e, _) in enumerate(_LAYOUTS))} end")
    rows = listings(spark, sf, ["id", "mileage_km", "listing_day"]).select("id", written.alias("listing_date"))
    return market.with_listing_day(rows, RUN_DATE).select("id", "listing_date", text_date("listing_day").alias("day"))


@query("numbers_from_text", "F5", sql=f"""{WITH}, t AS (SELECT brand, price, CASE CAST(mileage_km // 10000 % 7 AS INTEGER) WHEN 0 THEN 'NaN' WHEN 1 THEN 'Infinity' WHEN 2 THEN 'ask' WHEN 3 THEN price || '.5' ELSE price || '' END AS txt FROM listings)
SELECT brand, count(*) AS rows, sum(CAST(txt AS DOUBLE)) AS total FROM t WHERE txt NOT IN ('NaN', 'Infinity', 'ask') GROUP BY 1""")
def numbers_from_text(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.expr("mileage_km div 10000 % 7")
    text = F.when(kind == 0, "NaN").when(kind == 1, "Infinity").when(kind == 2, "ask").when(kind == 3, F.concat("price", F.lit(".5"))).otherwise(F.col("price").cast("string"))
    rows = coerce_numbers(listings(spark, sf, ["brand", "price", "mileage_km"]).withColumn("price", text))
    return rows.groupBy("brand").agg(F.count("*").alias("rows"), F.sum("price").alias("total"))


@query("trend_summary", "D8", sql=f"""{TREND_SQL}
SELECT count(*) >= 2 AS available, count(*) >= 2 AND count(clean_listing_count) >= 2 AS clean_available,
       count(*) AS date_count, count(clean_listing_count) AS clean_date_count,
       CAST(sum(listing_count) AS BIGINT) AS dated_listing_count
FROM d LEFT JOIN c USING (listing_day)""")
def trend_summary(spark: SparkSession, sf: str) -> DataFrame:
    return market.trend_summary(market.daily_trend(listings(spark, sf, ["listing_day", "is_clean_claimed", "price"]), RUN_DATE))


@query("newest_listings", "K3", "S12", sql=f"""{WITH}
SELECT id, brand, series, model, year, mileage_km, city, listing_date, listing_url, title, CAST(price AS DOUBLE) AS price, CAST(NULL AS DOUBLE) AS similarity_score
FROM listings WHERE price > 0 ORDER BY scraped_at DESC, id DESC LIMIT 12""")
def newest_listings(spark: SparkSession, sf: str) -> DataFrame:
    cols = ["id", "title", "brand", "series", "model", "year", "mileage_km", "price", "city", "listing_date", "listing_url", "scraped_at"]
    return market.newest_listings(listings(spark, sf, cols))


@query("distinct_models", "F6", sql=f"""{WITH}
SELECT DISTINCT trim(model) AS name FROM listings WHERE price > 0 AND lower(brand) = 'brand#3' AND trim(model) <> ''""")
def distinct_models(spark: SparkSession, sf: str) -> DataFrame:
    return market.distinct_values(listings(spark, sf, ["brand", "model", "price"]), "model", ListingFilters(brand="Brand#3"))


@query("table_facts", "S13", sql=f"""{WITH}
SELECT count(*) AS listing_count, strftime(max(scraped_at), '%Y-%m-%d %H:%M:%S') AS last_updated_at FROM listings""")
def table_facts(spark: SparkSession, sf: str) -> DataFrame:
    facts = market.table_facts(listings(spark, sf, ["scraped_at"]))
    return facts.withColumn("last_updated_at", F.date_format("last_updated_at", "yyyy-MM-dd HH:mm:ss"))


@query("selector_counts", "A22", "T16", sql=f"""{WITH}
SELECT 'brand' AS level, brand AS name, count(*) AS listing_count FROM listings WHERE price > 0 GROUP BY 2
UNION ALL SELECT 'series', series, count(*) FROM listings WHERE price > 0 AND lower(brand) = 'brand#5' GROUP BY 2
UNION ALL SELECT 'model', model, count(*) FROM listings WHERE price > 0 AND lower(brand) = 'brand#5' AND lower(series) = 'economy' GROUP BY 2""")
def selector_counts(spark: SparkSession, sf: str) -> DataFrame:
    rows = listings(spark, sf, ["brand", "series", "model", "price"])
    levels = {
        "brand": None, "series": ListingFilters(brand="brand#5"), "model": ListingFilters(brand="brand#5", series="Economy"),
    }
    parts = [market.selector_counts(rows, name, f).withColumn("level", F.lit(name)) for name, f in levels.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _price_band_sql() -> str:
    cases = " ".join(
        f"WHEN price >= {low}" + (f" AND price <= {high}" if high is not None else "") + f" THEN '{name}'"
        for low, high, name in default_price_bands()
    )
    return f"""{WITH} SELECT CASE {cases} END AS band, count(*) AS listing_count, min(price) AS lowest, max(price) AS highest
FROM listings WHERE price > 0 GROUP BY 1"""


@query("price_band_counts", "F13", "T13", sql=_price_band_sql())
def price_band_counts(spark: SparkSession, sf: str) -> DataFrame:
    rows = apply_filters(listings(spark, sf, ["price"]))
    return rows.groupBy(band_label(F.col("price"), default_price_bands()).alias("band")).agg(
        F.count("*").alias("listing_count"), F.min("price").alias("lowest"), F.max("price").alias("highest")
    )


@query("price_quartiles_by_model", "A9", sql=f"""{WITH}
SELECT brand, series, model, count(*) AS count, CAST(min(price) AS DOUBLE) AS minimum, CAST(max(price) AS DOUBLE) AS maximum,
       round(avg(price), 4) AS mean, round(quantile_cont(price, 0.25), 4) AS q1, round(median(price), 4) AS median,
       round(quantile_cont(price, 0.75), 4) AS q3
FROM listings WHERE price > 0 GROUP BY 1, 2, 3""")
def price_quartiles_by_model(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(market.price_quartiles(listings(spark, sf, ["brand", "series", "model", "price"]), ["brand", "series", "model"]))
