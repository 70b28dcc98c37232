"""Valuation queries: one request per part, with fields left blank by the part's size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pricelens.functions import scoring
from pricelens.functions.registered import register_functions
from pricelens.operators.filters import filter_problem, request_problem
from pricelens.operators.quantiles import price_statistics
from pricelens.plans import valuation
from pricelens.sources.warehouse import LISTINGS_SQL, listings, table
from pricelens.suite.registry import query, rounded, text_date

LISTING_COLS = ["brand", "series", "model", "year", "mileage_km", "price", "is_clean_claimed"]

# Which fields a request gives is a property of the part, so every part asks one question.
REQUEST_COLS = {
    "request_id": ("cast(p_partkey as string)", "CAST(p_partkey AS VARCHAR)"),
    "brand": ("if(p_size = 50, ' ', upper(p_brand))", "CASE WHEN p_size = 50 THEN ' ' ELSE upper(p_brand) END"),
    "series": ("if(p_size in (6, 12, 24, 36, 48, 50), null, p_type)", "CASE WHEN p_size IN (6, 12, 24, 36, 48, 50) THEN NULL ELSE p_type END"),
    "model": ("if(p_size in (3, 6, 9, 12, 24, 36, 48, 50), null, p_name)", "CASE WHEN p_size IN (3, 6, 9, 12, 24, 36, 48, 50) THEN NULL ELSE p_name END"),
    "year": ("if(p_size in (4, 8, 12, 24, 36, 44, 50), null, 1995 + cast(p_retailprice as int) % 7)",
             "CASE WHEN p_size IN (4, 8, 12, 24, 36, 44, 50) THEN NULL ELSE 1995 + CAST(trunc(p_retailprice) AS INTEGER) % 7 END"),
    "mileage_km": ("if(p_size in (5, 8, 10, 20, 24, 30, 40, 50), null, cast(p_size * 10000L as bigint))",
                   "CASE WHEN p_size IN (5, 8, 10, 20, 24, 30, 40, 50) THEN NULL ELSE CAST(p_size * 10000 AS BIGINT) END"),
    "asking_price": ("if(p_size = 7, null, cast(p_retailprice * 2500 as bigint))",
                     "CASE WHEN p_size = 7 THEN NULL ELSE CAST(trunc(p_retailprice * 2500) AS BIGINT) END"),
    "clean_only": ("p_type = 'STANDARD'", "p_type = 'STANDARD'"),
    "changed_parts": ("if(p_size % 7 = 0, null, p_size % 4)", "CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_size % 4 END"),
    "painted_parts": ("if(p_size % 5 = 0, null, p_size % 3)", "CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_size % 3 END"),
}


def requests(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(*[F.expr(e[0]).alias(c) for c, e in REQUEST_COLS.items()])


REQUESTS_SQL = "requests AS (SELECT " + ", ".join(f"{e[1]} AS {c}" for c, e in REQUEST_COLS.items()) + " FROM part)"

# Distinct contexts first, as plain conditions without any join key tricks.
PAIRS_SQL = f"""WITH {LISTINGS_SQL}, {REQUESTS_SQL},
ctx AS MATERIALIZED (
  SELECT *, CASE WHEN trim(coalesce(model, '')) = '' THEN 0.75 ELSE 1.0 END AS model_score,
         greatest(0, mileage_km - greatest(CAST(floor(mileage_km * 0.30::DOUBLE) AS BIGINT), 25000)) AS km_low,
         mileage_km + greatest(CAST(floor(mileage_km * 0.30::DOUBLE) AS BIGINT), 25000) AS km_high,
         greatest(coalesce(nullif(mileage_km, 0), 100000) * 0.75::DOUBLE, 80000.0::DOUBLE) AS km_scale
  FROM requests),
matched AS MATERIALIZED (
  SELECT c.request_id, c.year AS t_year, c.mileage_km AS t_km, c.km_low, c.km_high, c.km_scale, c.model_score,
         l.id, l.year, CAST(l.mileage_km AS BIGINT) AS mileage_km, l.price, l.listing_day
  FROM ctx c JOIN listings l
    ON (trim(coalesce(c.brand, '')) = '' OR lower(l.brand) = lower(trim(c.brand)))
   AND (trim(coalesce(c.series, '')) = '' OR lower(l.series) = lower(trim(c.series)))
   AND (trim(coalesce(c.model, '')) = '' OR lower(l.model) = lower(trim(c.model)))
   AND (NOT c.clean_only OR l.is_clean_claimed = 1)
  WHERE l.price > 0),
raw_counts AS (SELECT request_id, count(*) AS raw_count FROM matched GROUP BY 1),
selected AS MATERIALIZED (
  SELECT *, CAST(round(least(greatest(
      0.42::DOUBLE * CASE WHEN t_year IS NULL THEN 0.65::DOUBLE ELSE least(greatest(1 - abs(CAST(year AS DOUBLE) - CAST(t_year AS DOUBLE)) / 6.0::DOUBLE, 0), 1) END
    + 0.34::DOUBLE * CASE WHEN t_km IS NULL THEN 0.65::DOUBLE ELSE least(greatest(1 - abs(CAST(mileage_km AS DOUBLE) - CAST(t_km AS DOUBLE)) / km_scale, 0), 1) END
    + 0.14::DOUBLE * CAST(model_score AS DOUBLE) + 0.10::DOUBLE * 0.65::DOUBLE, 0.05::DOUBLE), 1.0::DOUBLE) * 1000000) AS BIGINT) AS w
  FROM matched WHERE (t_year IS NULL OR year = t_year) AND (t_km IS NULL OR mileage_km BETWEEN km_low AND km_high)),
bounds AS (
  SELECT request_id, count(*) AS selected_count, quantile_cont(price, 0.02) AS p02, quantile_cont(price, 0.25) AS p25,
         quantile_cont(price, 0.75) AS p75, quantile_cont(price, 0.98) AS p98
  FROM selected GROUP BY 1),
used AS MATERIALIZED (
  SELECT s.* FROM selected s JOIN bounds b USING (request_id)
  WHERE b.selected_count < 12 OR b.p75 - b.p25 <= 0
     OR s.price BETWEEN greatest(b.p25 - 1.5 * (b.p75 - b.p25), b.p02) AND least(b.p75 + 1.5 * (b.p75 - b.p25), b.p98)),
running AS (
  SELECT request_id, price, sum(w) OVER (PARTITION BY request_id ORDER BY price) AS cum, sum(w) OVER (PARTITION BY request_id) AS total FROM used),
weighted AS (
  SELECT request_id, min(price) FILTER (cum >= 0.25 * total) AS weighted_q1, min(price) FILTER (cum >= 0.5 * total) AS weighted_median,
         min(price) FILTER (cum >= 0.75 * total) AS weighted_q3 FROM running GROUP BY 1),
summary AS (
  SELECT request_id, count(*) AS n, CAST(min(price) AS DOUBLE) AS minimum, CAST(max(price) AS DOUBLE) AS maximum, avg(price) AS mean,
         quantile_cont(price, 0.25) AS q1, median(price) AS median, quantile_cont(price, 0.75) AS q3,
         CAST(sum(CAST(price AS HUGEINT) * w) AS DOUBLE) / CAST(sum(w) AS DOUBLE) AS weighted_mean,
         CAST(trunc(median(year)) AS INTEGER) AS median_year, CAST(trunc(median(mileage_km)) AS BIGINT) AS median_mileage_km
  FROM used GROUP BY 1)"""


@query("valuation_answers", "D6", "D5", "J12", "F8", "A19", "C24", "C25", "T5", "T6", sql=f"""{PAIRS_SQL}
SELECT r.request_id, CASE WHEN coalesce(n, 0) = 0 THEN 'empty' WHEN n >= 8 THEN 'ok' ELSE 'low_sample' END AS status,
  CAST(weighted_median AS DOUBLE) AS estimated_market_value, CAST(weighted_q1 AS DOUBLE) AS recommended_low_price,
  CAST(weighted_q3 AS DOUBLE) AS recommended_high_price, round(median, 4) AS median_price, coalesce(n, 0) AS listing_count,
  CASE WHEN n >= 50 THEN 'Yuksek' WHEN n >= 20 THEN 'Orta' WHEN n >= 8 THEN 'Dusuk' WHEN n > 0 THEN 'Yetersiz' END AS confidence,
  CASE WHEN (asking_price - weighted_median) / weighted_median::DOUBLE * 100 <= -8 THEN 'Piyasa altı'
       WHEN (asking_price - weighted_median) / weighted_median::DOUBLE * 100 >= 8 THEN 'Piyasa üstü'
       WHEN asking_price IS NOT NULL AND weighted_median IS NOT NULL THEN 'Piyasa içinde' END AS price_assessment,
  round((asking_price - weighted_median) / weighted_median::DOUBLE * 100, 4) AS asking_price_delta_percent,
  coalesce(raw_count, 0) AS matched_listing_count, coalesce(selected_count, 0) AS selected_listing_count,
  coalesce(selected_count, 0) - coalesce(n, 0) AS outlier_count,
  CASE WHEN r.year IS NULL AND r.mileage_km IS NULL THEN 'all_matching' ELSE 'context_window' END AS selection_mode,
  r.clean_only, r.km_low AS window_low_km, r.km_high AS window_high_km, median_year, median_mileage_km,
  CAST(NULL AS DOUBLE) AS condition_adjustment_percent
FROM ctx r LEFT JOIN raw_counts USING (request_id) LEFT JOIN bounds USING (request_id)
     LEFT JOIN weighted USING (request_id) LEFT JOIN summary USING (request_id)""")
def valuation_answers(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(valuation.value_requests(valuation.prepare(requests(spark, sf), listings(spark, sf, LISTING_COLS))))


@query("valuation_price_summary", "A3", "A4", "W2", "C34", sql=f"""{PAIRS_SQL}
SELECT request_id, n AS listing_count, minimum, round(q1, 4) AS q1, round(median, 4) AS median, round(q3, 4) AS q3, maximum,
       round(mean, 4) AS mean, CAST(weighted_q1 AS DOUBLE) AS weighted_q1, CAST(weighted_median AS DOUBLE) AS weighted_median,
       CAST(weighted_q3 AS DOUBLE) AS weighted_q3, round(weighted_mean, 4) AS weighted_mean
FROM summary JOIN weighted USING (request_id)""")
def valuation_price_summary(spark: SparkSession, sf: str) -> DataFrame:
    run = valuation.prepare(requests(spark, sf), listings(spark, sf, LISTING_COLS))
    stats = valuation.used_summary(run.used).drop("median_year", "median_mileage_km").withColumnRenamed("count", "listing_count")
    return rounded(run.requests.select("request_id", "context_id").join(stats, "context_id").drop("context_id"))


BUCKETS_SQL = f"""{PAIRS_SQL},
spans AS (SELECT request_id, CAST(min(mileage_km) AS DOUBLE) AS lo, CAST(max(mileage_km) AS DOUBLE) AS hi,
                 least(8, greatest(3, CAST(ceil(sqrt(count(*))) AS INTEGER))) AS k FROM used GROUP BY 1),
edges AS (SELECT request_id, lo, hi, k, i, lo + (hi - lo) / k * i AS lower_edge,
                 CASE WHEN i = k - 1 THEN hi ELSE lo + (hi - lo) / k * (i + 1) END AS upper_edge
          FROM spans, range(8) r(i) WHERE i < k AND (lo < hi OR i = 0))
SELECT u.request_id, CAST(i AS INTEGER) AS bucket,
       CAST(round_even(CASE WHEN lo = hi THEN lo ELSE lower_edge END, 0) AS BIGINT) AS lower_mileage_km,
       CAST(round_even(CASE WHEN lo = hi THEN hi ELSE upper_edge END, 0) AS BIGINT) AS upper_mileage_km,
       round(median(price), 4) AS median_price, round(avg(price), 4) AS average_price, count(*) AS listing_count
FROM used u JOIN edges e ON u.request_id = e.request_id
 AND (lo = hi OR (u.mileage_km >= lower_edge AND (u.mileage_km < upper_edge OR (i = k - 1 AND u.mileage_km <= upper_edge))))
GROUP BY 1, 2, 3, 4"""


@query("valuation_mileage_buckets", "A18", sql=BUCKETS_SQL)
def valuation_mileage_buckets(spark: SparkSession, sf: str) -> DataFrame:
    run = valuation.prepare(requests(spark, sf), listings(spark, sf, LISTING_COLS))
    points = valuation.mileage_buckets(run.used)
    return rounded(run.requests.select("request_id", "context_id").join(points, "context_id").drop("context_id"))


CONTEXT_TREND_SQL = f"""{PAIRS_SQL}, days AS (
  SELECT request_id, listing_day, median(price) AS m, avg(price) AS a, count(*) AS n FROM used GROUP BY 1, 2)
SELECT request_id, strftime(listing_day, '%Y-%m-%d') AS date, round(m, 4) AS median_price, round(a, 4) AS average_price, n AS listing_count
FROM days WHERE request_id IN (SELECT request_id FROM days GROUP BY 1 HAVING count(*) >= 2)"""


@query("valuation_trend", "D6", sql=CONTEXT_TREND_SQL)
def valuation_trend(spark: SparkSession, sf: str) -> DataFrame:
    run = valuation.prepare(requests(spark, sf), listings(spark, sf, [*LISTING_COLS, "listing_day"]), extra=("listing_day",))
    points = valuation.context_trend(run.used)
    owned = run.requests.select("request_id", "context_id").join(points, "context_id").drop("context_id")
    return rounded(owned.withColumn("date", text_date("date")))


# A fixed discount per request stands in for the learned one, so that what it scales can be compared.
FACTOR_SQL = "(1 - 0.25::DOUBLE * (CAST(request_id AS BIGINT) % 4))"


def fixed_factors(requests_: DataFrame) -> DataFrame:
    return requests_.select("request_id", (1 - F.lit(0.25) * (F.col("request_id").cast("bigint") % 4)).alias("factor"))


def _whole(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.floor(c) for c in ("median_price", "average_price")})


@query("scaled_buckets", "D6", "K5", sql=f"""WITH b AS ({BUCKETS_SQL})
SELECT request_id, bucket, lower_mileage_km, upper_mileage_km, CAST(floor(median_price * {FACTOR_SQL}) AS BIGINT) AS median_price, CAST(floor(average_price * {FACTOR_SQL}) AS BIGINT) AS average_price, listing_count FROM b""")
def scaled_buckets(spark: SparkSession, sf: str) -> DataFrame:
    run = valuation.prepare(requests(spark, sf), listings(spark, sf, LISTING_COLS))
    points = valuation.mileage_buckets(run.used).withColumns({c: F.round(c, 4) for c in ("median_price", "average_price")})
    return _whole(valuation.scale_points(points, run.requests, fixed_factors(run.requests), ["median_price", "average_price"]))


@query("scaled_trend", "D6", "K5", sql=f"""WITH b AS ({CONTEXT_TREND_SQL})
SELECT request_id, date, CAST(floor(median_price * {FACTOR_SQL}) AS BIGINT) AS median_price, CAST(floor(average_price * {FACTOR_SQL}) AS BIGINT) AS average_price, listing_count FROM b""")
def scaled_trend(spark: SparkSession, sf: str) -> DataFrame:
    run = valuation.prepare(requests(spark, sf), listings(spark, sf, [*LISTING_COLS, "listing_day"]), extra=("listing_day",))
    points = valuation.context_trend(run.used).withColumns({c: F.round(c, 4) for c in ("median_price", "average_price")})
    scaled = valuation.scale_points(points, run.requests, fixed_factors(run.requests), ["median_price", "average_price"])
    return _whole(scaled.withColumn("date", text_date("date")))


POINTS_SQL = f"""{PAIRS_SQL},
ranked AS (SELECT request_id, price, row_number() OVER (PARTITION BY request_id ORDER BY price) AS rank FROM used)
SELECT r.request_id, CAST(price AS DOUBLE) AS price,
       CAST((rank - 1) % least(8, greatest(3, CAST(ceil(sqrt(n)) AS INTEGER))) + 1 AS INTEGER) AS lane,
       price BETWEEN weighted_q1 AND weighted_q3 AS is_recommended
FROM ranked r JOIN summary USING (request_id) JOIN weighted USING (request_id)"""


def _price_points(spark: SparkSession, sf: str) -> tuple[valuation.Valuation, DataFrame]:
    """The prepared requests and the points of every context."""
    run = valuation.prepare(requests(spark, sf), listings(spark, sf, ["id", *LISTING_COLS]), extra=("id",))
    summary = valuation.used_summary(run.used).withColumnRenamed("count", "used_count")
    return run, valuation.price_points(run, summary).select("context_id", F.col("price").cast("double").alias("price"), "lane", "is_recommended")


@query("valuation_price_points", "K5", "F19", sql=POINTS_SQL)
def valuation_price_points(spark: SparkSession, sf: str) -> DataFrame:
    run, points = _price_points(spark, sf)
    # equal prices may swap places, which changes neither the lanes nor the marks of a price
    return run.requests.select("request_id", "context_id").join(points, "context_id").drop("context_id")


@query("scaled_price_points", "K5", "D6", sql=f"""WITH b AS ({POINTS_SQL})
SELECT request_id, CAST(floor(price * {FACTOR_SQL}) AS BIGINT) AS price, lane, is_recommended FROM b""")
def scaled_price_points(spark: SparkSession, sf: str) -> DataFrame:
    # points belong to contexts; every request of one takes them with its own factor, whose marks do not change
    run, points = _price_points(spark, sf)
    return valuation.scale_points(points, run.requests, fixed_factors(run.requests), ["price"]).withColumn("price", F.floor("price"))


SCORE_SQL = """CAST(round(least(greatest(
    0.42::DOUBLE * least(greatest(1 - abs(year - 1998)::DOUBLE / 6.0::DOUBLE, 0), 1)
  + 0.34::DOUBLE * least(greatest(1 - abs(mileage_km - 120000)::DOUBLE / 90000.0::DOUBLE, 0), 1)
  + 0.14::DOUBLE * CASE WHEN contains(lower(concat(model, ' ', title)), 'ring') THEN 1.0::DOUBLE ELSE 0.65::DOUBLE END
  + 0.10::DOUBLE * {fresh}, 0.05::DOUBLE), 1.0::DOUBLE), 6) AS DOUBLE)"""
FRESH_SQL = "least(greatest(1 - date_diff('day', listing_day, (SELECT max(listing_day) FROM listings))::DOUBLE / 45.0::DOUBLE, 0.35), 1.0)"


@query("similarity_in_sql", "P1", "C20", "C23", sql=f"""WITH {LISTINGS_SQL}
SELECT id, {SCORE_SQL.format(fresh='0.65::DOUBLE')} AS similarity_score FROM listings""")
def similarity_in_sql(spark: SparkSession, sf: str) -> DataFrame:
    """The scores of ``similarity_scores``, asked for in SQL."""
    register_functions(spark)
    rows = listings(spark, sf, ["id", "year", "mileage_km", "model", "title"])
    return spark.sql("""SELECT id, round(listing_similarity(
        listing_distance_score(year, 1998, 6), listing_distance_score(mileage_km, 120000, listing_mileage_scale(120000)),
        CASE WHEN contains(lower(concat(model, ' ', title)), 'ring') THEN 1.0 ELSE 0.65 END, 0.65), 6) AS similarity_score FROM {rows}""", rows=rows)


@query("similarity_scores", "C20", "C22", "C23", "K4", "T4", sql=f"""WITH {LISTINGS_SQL}
SELECT id, {SCORE_SQL.format(fresh='0.65::DOUBLE')} AS similarity_score FROM listings""")
def similarity_scores(spark: SparkSession, sf: str) -> DataFrame:
    rows = listings(spark, sf, ["id", "title", "model", "year", "mileage_km", "price"])
    scored = valuation.score_listings(rows, year=1998, mileage=120_000, model="Ring ")
    return rounded(scored.select("id", "similarity_score").orderBy(F.desc("similarity_score"), "id"), 6)


@query("similarity_with_freshness", "C21", "W3", sql=f"""WITH {LISTINGS_SQL}
SELECT id, {SCORE_SQL.format(fresh=FRESH_SQL)} AS similarity_score FROM listings""")
def similarity_with_freshness(spark: SparkSession, sf: str) -> DataFrame:
    rows = listings(spark, sf, ["id", "title", "model", "year", "mileage_km", "price", "listing_date"])
    scored = valuation.score_listings(rows, year=1998, mileage=120_000, model="ring", freshness=True, run_date="2026-07-01")
    return rounded(scored.select("id", "similarity_score"), 6)


@query("market_analysis", "D5", sql=f"""WITH {LISTINGS_SQL}, l AS (
  SELECT *, CAST(round({SCORE_SQL.format(fresh='0.65::DOUBLE')} * 1000000) AS BIGINT) AS w FROM listings),
s AS (SELECT * FROM l WHERE year = 1998 AND mileage_km BETWEEN 84000 AND 156000),
b AS (SELECT count(*) AS selected_count, quantile_cont(price, 0.02) AS p02, quantile_cont(price, 0.25) AS p25,
             quantile_cont(price, 0.75) AS p75, quantile_cont(price, 0.98) AS p98 FROM s),
u AS (SELECT s.* FROM s, b WHERE price BETWEEN greatest(p25 - 1.5 * (p75 - p25), p02) AND least(p75 + 1.5 * (p75 - p25), p98)),
c AS (SELECT price, sum(w) OVER (ORDER BY price) AS cum, sum(w) OVER () AS total FROM u),
wq AS (SELECT min(price) FILTER (cum >= 0.5 * total) AS weighted_median FROM c)
SELECT (SELECT count(*) FROM l) AS raw_count, (SELECT selected_count FROM b) AS selected_count, count(*) AS count,
       round(median(price), 4) AS median, CAST((SELECT weighted_median FROM wq) AS DOUBLE) AS weighted_median, 'ok' AS status,
       'Yuksek' AS confidence, round((4000000 - (SELECT weighted_median FROM wq)) / (SELECT weighted_median FROM wq)::DOUBLE * 100, 4) AS price_delta_pct
FROM u""")
def market_analysis(spark: SparkSession, sf: str) -> DataFrame:
    rows = listings(spark, sf, ["title", "model", "year", "mileage_km", "price"])
    result = valuation.analyze(rows, year=1998, mileage=120_000, model="ring", asking_price=4_000_000)
    keep = ["raw_count", "selected_count", "count", "median", "weighted_median", "status", "confidence", "price_delta_pct"]
    return rounded(result.select(*keep))


@query("weighted_quantiles_by_brand", "A4", sql=f"""WITH {LISTINGS_SQL}, c AS (
  SELECT brand, price, sum(mileage_km) OVER (PARTITION BY brand ORDER BY price) AS cum, sum(mileage_km) OVER (PARTITION BY brand) AS total
  FROM listings)
SELECT brand, CAST(min(price) FILTER (cum >= 0.1 * total) AS DOUBLE) AS w10, CAST(min(price) FILTER (cum >= 0.5 * total) AS DOUBLE) AS w50,
       CAST(min(price) FILTER (cum >= 0.9 * total) AS DOUBLE) AS w90 FROM c GROUP BY 1""")
def weighted_quantiles_by_brand(spark: SparkSession, sf: str) -> DataFrame:
    rows = listings(spark, sf, ["brand", "mileage_km", "price"])
    stats = price_statistics(
        rows, ["brand"], quantiles={}, weight=F.col("mileage_km").cast("bigint"), weighted={"w10": 0.1, "w50": 0.5, "w90": 0.9}
    )
    return stats.select("brand", "w10", "w50", "w90")


@query("request_validation", "F14", sql=f"""WITH {REQUESTS_SQL}
SELECT request_id, CASE WHEN year > 1999 THEN 'year' WHEN mileage_km > 400000 THEN 'mileage_km' WHEN asking_price < 1 THEN 'asking_price'
       WHEN changed_parts > 2 THEN NULL END AS problem FROM (SELECT * REPLACE (year AS year) FROM requests)""")
def request_validation(spark: SparkSession, sf: str) -> DataFrame:
    # shifted so that the real limits cut inside the data: 1999 -> 2100 and 400 000 -> 2 000 000
    rows = requests(spark, sf).withColumns({"year": F.col("year") + 101, "mileage_km": F.col("mileage_km") * 5})
    for c in ("body_type", "fuel_type", "transmission"):
        rows = rows.withColumn(c, F.lit(None).cast("string"))
    return rows.select("request_id", request_problem().alias("problem"))


@query("filter_validation", "F14", sql="""SELECT CAST(p_partkey AS VARCHAR) AS filter_id,
  CASE WHEN p_size > 40 THEN 'year_max' WHEN p_partkey * 1000 > 2000000 THEN 'mileage_max' WHEN 2090 > 2060 + p_size THEN 'year_order' END AS problem
FROM part""")
def filter_validation(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "part").select(
        F.col("p_partkey").cast("string").alias("filter_id"), F.lit(2090).alias("year_min"),
        (F.lit(2060) + F.col("p_size")).alias("year_max"), (F.col("p_partkey") * 1000).alias("mileage_max"),
    )
    return rows.select("filter_id", filter_problem().alias("problem"))
