"""Page parsing, merging, status and streaming queries."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from pricelens.functions import text as tx
from pricelens.functions.dates import ingest_date
from pricelens.operators.merge import compact_table, fold_by_key, merge_into_table, read_merged
from pricelens.plans import ingest, status
from pricelens.plans.clean_build import CleanRules, decide_rows
from pricelens.session import materialize, work_dir
from pricelens.sources import pages as pg
from pricelens.sources.catalog import brand_map
from pricelens.sources.warehouse import LISTINGS_SQL, listings, table
from pricelens.streaming import jobs
from pricelens.suite.registry import query, rounded, text_date

WITH = f"WITH {LISTINGS_SQL}"
RUN_DATE = "2001-12-31"
MONTH_NAMES = ("Ocak", "Şubat", "Mart", "Nisan", "Mayıs", "Haziran", "Temmuz", "Ağustos", "Eylül", "Ekim", "Kasım", "Aralık")


def result_pages(spark: SparkSession, sf: str, dated: bool = False) -> DataFrame:
    """One result page per listing: a header row, the listing row, and a row without a title. ``dated``: listed on 1 January of its year."""
    cols = ["id", "source_listing_id", "title", "brand", "series", "model", "year", "mileage_km", "city", "price", "listing_url"]
    # narrow rows are dealt out before the pages are written from them; each table here is one small file
    rows = listings(spark, sf, cols).repartition("id")
    cell = lambda kind, body: F.concat(F.lit(f'<td class="{kind}">'), body, F.lit("</td>"))
    html = F.concat(
        F.lit('<html><body><table><tr class="header"><td>Model</td></tr><tr class="searchResultsItem odd" data-id="'), "source_listing_id", F.lit('">'),
        cell("searchResultsLargeThumbnail", F.concat(F.lit('<a href="#"><img data-src="https://img.test/'), "source_listing_id", F.lit('.jpg" src="x"/></a>'))),
        cell("searchResultsTagAttributeValue", F.concat(F.lit(" "), "brand", F.lit("\n"))), cell("searchResultsTagAttributeValue", F.col("series")),
        cell("searchResultsTagAttributeValue", F.concat(F.lit("<i>"), "model", F.lit("</i>"))),
        cell("searchResultsTitleValue", F.concat(F.lit('<a class="classifiedTitle" href="/x/'), "source_listing_id", F.lit('">'), "title", F.lit(" &amp; <b>extra</b></a><a class=\"classifiedTitle\">no</a>"))),
        cell("searchResultsAttributeValue", F.when(F.col("mileage_km") > 250_000, "").otherwise(F.col("year").cast("string"))),
        cell("searchResultsAttributeValue", F.concat(F.format_number("mileage_km", 0), F.lit(" km"))), cell("searchResultsAttributeValue", F.lit("Mavi")),
        cell("searchResultsPriceValue", F.concat(F.lit('<div class="classified-price-container"><span>'), F.format_number("price", 0), F.lit(" TL</span><span>0</span></div>"))),
        cell("searchResultsDateValue", F.concat(F.lit("<span>1 Ocak</span><br/><span>"), F.col("year").cast("string"), F.lit("</span>")) if dated else F.lit("<span>12 Mayıs</span><br/><span>2001</span>")), cell("searchResultsLocationValue", F.concat("city", F.lit("<br/>/ Merkez"))),
        F.lit('</tr><tr class="searchResultsItem" data-id="77"><td class="searchResultsTitleValue"><a>ad</a></td></tr></table></body></html>'),
    )
    return rows.select(F.col("id").alias("page_id"), html.alias("html"))


@query("parsed_pages", "S10", "C15", sql=f"""{WITH}
SELECT id AS page_key, source_listing_id, concat(title, ' & extra') AS title, brand, series, model, CAST(NULL AS VARCHAR) AS engine,
  CASE WHEN mileage_km > 250000 THEN NULL ELSE CAST(year AS INTEGER) END AS year, mileage_km, 'Mavi' AS color, city, 'Merkez' AS district, price, '12 Mayıs 2001' AS listing_date,
  concat('https://pages.test/x/', source_listing_id) AS listing_url, concat('https://img.test/', source_listing_id, '.jpg') AS image_url FROM listings""")
def parsed_pages(spark: SparkSession, sf: str) -> DataFrame:
    rows = pg.parse_results(result_pages(spark, sf), "market", base_url="https://pages.test/")
    return rows.drop("position", "source", "currency")


_PAGE_COLUMNS = {"page_key": "VARCHAR", "position": "INTEGER", **{c: "VARCHAR" for c in ("source", "source_listing_id", "title", "brand", "series", "model", "engine")}, "year": "BIGINT", "mileage_km": "BIGINT",
                 "color": "VARCHAR", "city": "VARCHAR", "district": "VARCHAR", "price": "BIGINT", "currency": "VARCHAR", "listing_date": "VARCHAR", "listing_url": "VARCHAR", "image_url": "VARCHAR"}


@query("web_page_rows", "S10", sql=f"SELECT {', '.join(f'CAST(page_id AS {t}) AS {c}' for c, t in _PAGE_COLUMNS.items())} FROM pages WHERE contains(html, 'searchResultsItem')")
def web_page_rows(spark: SparkSession, sf: str) -> DataFrame:
    # general web pages hold no result rows, so this must come out empty rather than fail
    return pg.parse_results(table(spark, sf, "pages"), "web")


MARKED_SPARK = """concat(html, case when url like '%/fr/%' then '<p>BU İLAN yayında değildir</p> İlan No' when url like '%/de/%' then '<div id="classifiedDetail">'
  when url like '%page=1%' then 'Olağan dışı erişim' when url like '%page=2%' then '<body class="individual-login-body">' else '' end,
  '<h1>', translate(format_number(length(html), 0), ',', '.'), ' İlan bulundu</h1>')"""
MARKED_SQL = """concat(html, CASE WHEN url LIKE '%/fr/%' THEN '<p>BU İLAN yayında değildir</p> İlan No' WHEN url LIKE '%/de/%' THEN '<div id="classifiedDetail">'
  WHEN url LIKE '%page=1%' THEN 'Olağan dışı erişim' WHEN url LIKE '%page=2%' THEN '<body class="individual-login-body">' ELSE '' END,
  '<h1>', replace(format('{:,}', length(html)), ',', '.'), ' İlan bulundu</h1>')"""
# 'BU İLAN' folds to an i with a combining dot, so the removed marker in plain letters does not match it.
CLASS_SQL = """CASE WHEN contains(lower(h), 'olağan dışı erişim') THEN 'access_challenge' WHEN contains(lower(h), 'individual-login-body') THEN 'login_page'
  WHEN contains(h, 'bu ilan yayında') THEN 'removed_marker' WHEN contains(lower(h), 'classifieddetail') OR contains(h, 'İlan No') THEN 'active_marker' ELSE 'unrecognized_page' END"""


def _marked(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", "url", F.expr(MARKED_SPARK).alias("html"))


@query("page_status", "C30", sql=f"""WITH p AS (SELECT page_id, {MARKED_SQL} AS h FROM pages), c AS (SELECT page_id, {CLASS_SQL} AS status_reason FROM p)
SELECT page_id, status_reason, CASE status_reason WHEN 'removed_marker' THEN 'removed' WHEN 'active_marker' THEN 'active' ELSE 'unknown' END AS status FROM c""")
def page_status(spark: SparkSession, sf: str) -> DataFrame:
    return pg.classify_pages(_marked(spark, sf)).select("page_id", "status", "status_reason")


@query("page_status_totals", "A25", sql=f"""WITH p AS (SELECT {MARKED_SQL} AS h FROM pages), c AS (SELECT {CLASS_SQL} AS r FROM p)
SELECT CASE r WHEN 'removed_marker' THEN 'removed' WHEN 'active_marker' THEN 'active' ELSE 'unknown' END AS status, count(*) AS checked FROM c GROUP BY 1""")
def page_status_totals(spark: SparkSession, sf: str) -> DataFrame:
    return status.status_totals(pg.classify_pages(_marked(spark, sf)))


@query("page_total_counts", "C29", sql="SELECT page_id, CAST(length(html) AS BIGINT) AS total FROM pages")
def page_total_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _marked(spark, sf).select("page_id", tx.total_count_on_page(F.col("html")).alias("total"))


@query("shift_repair", "F17", "F16", "F15", sql=f"""{WITH}
SELECT id, 'Brand#7' AS brand, 'ECONOMY' AS series,
  CASE WHEN brand = 'Brand#7' AND series = 'ECONOMY' THEN model WHEN brand = 'Brand#7' THEN series ELSE brand END AS model,
  CASE WHEN brand = 'Brand#7' AND series = 'ECONOMY' THEN transmission WHEN brand = 'Brand#7' THEN model ELSE series END AS engine,
  'NATION_3' AS city, CASE WHEN city <> 'NATION_3' THEN city ELSE 'Merkez' END AS district,
  'Boyasız' AS paint_status, 'Değişensiz' AS changed_part_status, 'clean_claimed' AS damage_status, 1 AS is_clean_claimed, 'clean_24h' AS scrape_segment FROM listings""")
def shift_repair(spark: SparkSession, sf: str) -> DataFrame:
    rows = listings(spark, sf, ["id", "brand", "series", "model", "transmission", "city"]).withColumnRenamed("transmission", "engine")
    rows = rows.withColumn("district", F.lit(None).cast("string"))
    fixed = ingest.repair_shift(rows, ingest.PageFilters(brand="Brand#7", series="ECONOMY", city="NATION_3", district="Merkez"))
    return ingest.label_segment(fixed, ingest.CLEAN_CLAIMED)


@query("brand_page_repair", "F17", "F16", sql=f"""{WITH}
SELECT id, 'ring' AS brand, 'red gear' AS series, CASE WHEN brand <> 'Brand#7' THEN series ELSE model END AS model,
  CASE WHEN brand <> 'Brand#7' THEN model ELSE transmission END AS engine FROM listings""")
def brand_page_repair(spark: SparkSession, sf: str) -> DataFrame:
    rows = listings(spark, sf, ["id", "brand", "series", "model", "transmission"]).withColumnRenamed("transmission", "engine")
    return ingest.apply_query_defaults(ingest.repair_shift(rows, ingest.PageFilters(brand="BRAND 7")), " ring  red gear ")


def _with_turkish_date(rows: DataFrame) -> DataFrame:
    day = F.col("listing_day")
    name = F.element_at(F.array(*[F.lit(m) for m in MONTH_NAMES]), F.month(day))
    written = F.concat_ws(" ", F.dayofmonth(day).cast("string"), name, F.year(day).cast("string"))
    text = F.when(F.col("mileage_km") == 10_000, "Bugün 10:00").when(F.col("mileage_km") == 20_000, "Dün").when(F.col("mileage_km") == 30_000, "yeni").otherwise(written)
    return rows.withColumn("listing_date", text)


_DATED_SQL = f"""{WITH}, d AS (SELECT *, CASE mileage_km WHEN 10000 THEN DATE '{RUN_DATE}' WHEN 20000 THEN DATE '{RUN_DATE}' - 1 WHEN 30000 THEN NULL ELSE listing_day END AS day FROM listings)"""


@query("ingest_dates", "C17", "T19", sql=f"{_DATED_SQL} SELECT id, strftime(day, '%Y-%m-%d') AS day FROM d")
def ingest_dates(spark: SparkSession, sf: str) -> DataFrame:
    rows = _with_turkish_date(listings(spark, sf, ["id", "mileage_km", "listing_day"]))
    return rows.select("id", text_date(ingest_date(F.col("listing_date"), RUN_DATE)).alias("day"))


@query("batch_counters", "F12", "I3", "A23", sql=f"""{_DATED_SQL} SELECT count(*) AS parsed, count(*) FILTER (day IS NULL OR day >= DATE '2000-06-01') AS recent,
  count(*) FILTER (day < DATE '2000-06-01') AS old, count(*) FILTER (day IS NULL) AS unknown_date FROM d""")
def batch_counters(spark: SparkSession, sf: str) -> DataFrame:
    rows = _with_turkish_date(listings(spark, sf, ["id", "mileage_km", "listing_day"]))
    return ingest.batch_counters(ingest.with_recency(rows, "2000-06-01", RUN_DATE))


def _arrivals(spark: SparkSession, sf: str) -> DataFrame:
    rows = listings(spark, sf, ["id", "source", "source_listing_id", "title", "brand", "price", "is_clean_claimed", "scraped_at", "mileage_km", "transmission"])
    return rows.select(
        F.col("id").alias("arrival"), "id", "source", F.when(F.col("mileage_km") > 20_000, F.col("source_listing_id")).alias("source_listing_id"), "title", "brand",
        "price", F.when(F.col("transmission") == "A", F.col("title")).alias("paint_status"), "is_clean_claimed", "scraped_at",
    )


UPSERT_SQL = f"""{WITH}, a AS (SELECT id AS arrival, id, source, CASE WHEN mileage_km > 20000 THEN source_listing_id END AS source_listing_id, title, brand, price,
  CASE WHEN transmission = 'A' THEN title END AS paint_status, is_clean_claimed, scraped_at, (scraped_at, id) AS o FROM listings)
SELECT arg_max(arrival, o) AS arrival, arg_min(id, o) AS id, source, source_listing_id, arg_max(title, o) AS title, arg_max(brand, o) AS brand, arg_max(price, o) AS price,
  arg_max(paint_status, o) FILTER (paint_status IS NOT NULL) AS paint_status, max(is_clean_claimed) AS is_clean_claimed,
  strftime(max(scraped_at), '%Y-%m-%d') AS scraped_at FROM a WHERE source_listing_id IS NOT NULL GROUP BY source, source_listing_id
UNION ALL SELECT arrival, id, source, source_listing_id, title, brand, price, paint_status, is_clean_claimed, strftime(scraped_at, '%Y-%m-%d') FROM a WHERE source_listing_id IS NULL"""
ORDER = ["scraped_at", "arrival"]


@query("listing_upsert", "S4", "T10", sql=UPSERT_SQL)
def listing_upsert(spark: SparkSession, sf: str) -> DataFrame:
    return fold_by_key(_arrivals(spark, sf), ORDER).withColumn("scraped_at", text_date("scraped_at"))


@query("merged_table", "S4", "I4", sql=UPSERT_SQL)
def merged_table(spark: SparkSession, sf: str) -> DataFrame:
    # three batches, the second one delivered twice; the first two are compacted before the last arrives
    path = f"{work_dir(spark)}/raw-{uuid.uuid4().hex}"
    rows = _arrivals(spark, sf)
    day = F.col("scraped_at")
    merge_into_table(spark, path, rows.where(day < "1996-01-01"), ORDER, batch_id=0)
    for _ in range(2):
        merge_into_table(spark, path, rows.where((day >= "1996-01-01") & (day < "1998-01-01")), ORDER, batch_id=1)
    compact_table(spark, path, ORDER)
    merge_into_table(spark, path, rows.where(day >= "1998-01-01"), ORDER, batch_id=2)
    return read_merged(spark, path, ORDER).withColumn("scraped_at", text_date("scraped_at"))


@query("recheck_queue", "F11", "K6", sql=f"""{WITH}, q AS (SELECT id, source_listing_id, title, CASE WHEN mileage_km = 50000 THEN '  ' ELSE listing_url END AS listing_url,
  CASE WHEN price < 200000 THEN NULL ELSE strftime(scraped_at, '%Y-%m-%d') END AS status_checked_at, scraped_at, CASE WHEN is_clean_claimed = 1 THEN 0 END AS is_active FROM listings)
SELECT id, source_listing_id, title, listing_url, status_checked_at FROM q WHERE trim(listing_url) <> '' AND coalesce(is_active, 1) = 1
ORDER BY status_checked_at IS NOT NULL, status_checked_at, scraped_at, id LIMIT 100""")
def recheck_queue(spark: SparkSession, sf: str) -> DataFrame:
    rows = listings(spark, sf, ["id", "source_listing_id", "title", "listing_url", "mileage_km", "price", "scraped_at", "is_clean_claimed"]).withColumns({
        "listing_url": F.when(F.col("mileage_km") == 50_000, "  ").otherwise(F.col("listing_url")),
        "status_checked_at": F.when(F.col("price") >= 200_000, text_date("scraped_at")),
        "is_active": F.when(F.col("is_clean_claimed") == 1, 0),
    })
    return status.recheck_queue(rows)


EVENT_STATUS = {"error": "removed", "purchase": "active"}
EVENTS_SQL = "WITH e AS MATERIALIZED (SELECT user_id AS id, CASE event_type WHEN 'error' THEN 'removed' WHEN 'purchase' THEN 'active' ELSE 'unknown' END AS status, ts, event_type FROM events)"
STATUS_SQL = f"""{EVENTS_SQL}, l AS (SELECT id, max(ts) FILTER (status = 'active') AS la, max(ts) FILTER (status = 'removed') AS lr, max(ts) AS seen, arg_max(event_type, ts) AS status_reason FROM e GROUP BY 1),
f AS (SELECT e.id, min(ts) AS removed_at FROM e JOIN l USING (id) WHERE e.status = 'removed' AND (la IS NULL OR ts > la) GROUP BY 1)
SELECT l.id, CASE WHEN removed_at IS NOT NULL THEN 0 WHEN la IS NOT NULL OR lr IS NOT NULL THEN 1 END AS is_active, strftime(seen, '%Y-%m-%d %H:%M:%S') AS status_checked_at,
  strftime(removed_at, '%Y-%m-%d %H:%M:%S') AS removed_at, status_reason FROM l LEFT JOIN f USING (id)"""


def _events(df: DataFrame) -> DataFrame:
    kind = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in EVENT_STATUS.items()], F.lit("unknown"))
    return df.select(F.col("user_id").alias("id"), kind.alias("status"), F.col("ts").cast("timestamp").alias("checked_at"), F.col("event_type").alias("status_reason"))


def _show_status(df: DataFrame) -> DataFrame:
    shown = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return df.select("id", "is_active", shown("status_checked_at"), shown("removed_at"), "status_reason")


@query("listing_status", "I5", sql=STATUS_SQL)
def listing_status(spark: SparkSession, sf: str) -> DataFrame:
    return _show_status(status.fold_events(_events(table(spark, sf, "events"))))


def _in_steps(spark: SparkSession, sf: str, job: Callable[[DataFrame, str], StreamingQuery], by_time: bool) -> str:
    """Run a job over three deliveries of the events, started anew after each; the folder it works in.

    By time the deliveries follow each other, but every tenth event comes one delivery too late and each delivery
    is one micro-batch; else they are mixed, so most events of the later ones are late.
    """
    base = f"{work_dir(spark)}/stream-{uuid.uuid4().hex}"
    events = table(spark, sf, "events")
    if by_time:
        first, last = events.agg(F.min(F.unix_timestamp("ts")), F.max(F.unix_timestamp("ts"))).first()
        # a delivery ends with a day
        part = F.greatest(F.floor((F.unix_timestamp(F.date_trunc("day", "ts")) - F.lit(first)) * 3 / F.lit(last - first + 1)), F.lit(0))
        part = F.least(F.lit(2), part + F.when(F.col("event_id") % 10 == 0, 1).otherwise(0))
    else:
        part = F.col("event_id") % 3
    for k in range(3):
        events.where(part == k).repartition(2).write.mode("append").parquet(f"{base}/arrivals")
        job(jobs.read_arrivals(spark, f"{base}/arrivals", events.schema, files_per_trigger=2 if by_time else 1), base).awaitTermination()
    return base


@query("status_stream", "I5", "I2", sql=STATUS_SQL)
def status_stream(spark: SparkSession, sf: str) -> DataFrame:
    job = lambda rows, base: jobs.fold_status(_events(rows), f"{base}/states", jobs.checkpoint_for(base, "status", kinds=EVENT_STATUS))
    return _show_status(jobs.read_states(spark, f"{_in_steps(spark, sf, job, by_time=False)}/states"))


@query("merge_stream", "I1", "I4", sql="""SELECT source_listing_id, arg_max(event_id, ts) AS event_id, round(arg_max(value, ts), 4) AS value
FROM (SELECT *, CAST(user_id AS VARCHAR) AS source_listing_id FROM events) GROUP BY 1""")
def merge_stream(spark: SparkSession, sf: str) -> DataFrame:
    def job(rows: DataFrame, base: str) -> StreamingQuery:
        keyed = rows.select(F.lit("events").alias("source"), F.col("user_id").cast("string").alias("source_listing_id"), "event_id", "value", "ts")
        return jobs.merge_arrivals(keyed, f"{base}/raw", ["ts", "event_id"], jobs.checkpoint_for(base, "merge", days=30))

    base = _in_steps(spark, sf, job, by_time=False)
    return rounded(read_merged(spark, f"{base}/raw", ["ts", "event_id"]).select("source_listing_id", "event_id", "value"))


# Events with their delivery, and the watermark that a delivery meets: a day before the newest event of those before it.
DELIVERED_SQL = """WITH span AS (SELECT CAST(floor(epoch(min(ts))) AS BIGINT) AS first, CAST(floor(epoch(max(ts))) AS BIGINT) AS last FROM events),
e AS MATERIALIZED (SELECT e.*, CAST(least(2, greatest(0, floor((CAST(epoch(date_trunc('day', ts)) AS BIGINT) - first) * 3 / (last - first + 1))) + CASE WHEN event_id % 10 = 0 THEN 1 ELSE 0 END) AS INTEGER) AS delivery FROM events e, span),
newest AS (SELECT delivery, date_trunc('milliseconds', max(ts)) AS ts FROM e GROUP BY 1),
met AS MATERIALIZED (SELECT d.delivery, (SELECT max(n.ts) FROM newest n WHERE n.delivery < d.delivery) - INTERVAL 1 DAY AS watermark FROM newest d)"""


@query("repeat_filter_stream", "I4", sql=f"{DELIVERED_SQL} SELECT event_id, user_id FROM e JOIN met USING (delivery) WHERE watermark IS NULL OR ts > watermark")
def repeat_filter_stream(spark: SparkSession, sf: str) -> DataFrame:
    # every event is delivered twice; one copy of each remains, none of an event that comes behind the watermark
    def job(rows: DataFrame, base: str) -> StreamingQuery:
        doubled = rows.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
        return jobs.append_to(jobs.without_repeats(doubled, ["event_id"], "ts", "1 day"), f"{base}/once", f"{base}/once-checkpoint")

    return spark.read.parquet(f"{_in_steps(spark, sf, job, by_time=True)}/once").select("event_id", "user_id")


@query("daily_window_stream", "I6", "I3", sql=f"""{DELIVERED_SQL} SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, CAST(round(sum(value) * 100) AS BIGINT) AS total_cents, min(value) AS minimum, max(value) AS maximum, count(*) AS count
FROM e JOIN met USING (delivery) WHERE watermark IS NULL OR date_trunc('day', ts) + INTERVAL 1 DAY > watermark GROUP BY 1, 2""")
def daily_window_stream(spark: SparkSession, sf: str) -> DataFrame:
    # events of a day that the watermark has passed come too late and are not counted
    def job(rows: DataFrame, base: str) -> StreamingQuery:
        stats = jobs.window_statistics(rows.withColumn("ts", F.col("ts").cast("timestamp")), "ts", ["event_type"], "value", delay="1 day")
        return jobs.upsert_windows(stats, f"{base}/windows", ["event_type"], f"{base}/windows-checkpoint")

    rows = jobs.read_windows(spark, f"{_in_steps(spark, sf, job, by_time=True)}/windows", ["event_type"])
    # the mean is shown as a whole total, so that both engines print the same number
    total = F.round(F.col("mean") * F.col("count") * 100).cast("bigint")
    return rows.select(text_date("window_start").alias("day"), "event_type", total.alias("total_cents"), "minimum", "maximum", "count")


_FETCHED_SQL = f"""p AS MATERIALIZED (SELECT page_id, {MARKED_SQL} AS h FROM pages), c AS MATERIALIZED (SELECT page_id, {CLASS_SQL} AS status_reason FROM p),
f AS (SELECT concat('https://listings.test/', page_id, '/', n) AS url, status_reason,
  CASE status_reason WHEN 'removed_marker' THEN 'removed' WHEN 'active_marker' THEN 'active' ELSE 'unknown' END AS status,
  TIMESTAMP '2001-01-01' + to_days(CAST((page_id + n) % 7 AS INTEGER)) AS fetched_at FROM c, (VALUES (1), (2), (3)) t(n))"""


@query("status_refresh", "D11", "C30", sql=f"""{WITH}, {_FETCHED_SQL}
SELECT id, CASE status WHEN 'removed' THEN 0 WHEN 'active' THEN 1 END AS is_active, strftime(fetched_at, '%Y-%m-%d %H:%M:%S') AS status_checked_at,
  CASE status WHEN 'removed' THEN strftime(fetched_at, '%Y-%m-%d %H:%M:%S') END AS removed_at, status_reason FROM listings LEFT JOIN f ON listing_url = url""")
def status_refresh(spark: SparkSession, sf: str) -> DataFrame:
    """Saved pages, each fetched for up to three listings of an order, put onto the stored listings."""
    fetched = pg.classify_pages(_marked(spark, sf)).withColumn("n", F.explode(F.array(*[F.lit(n) for n in (1, 2, 3)])))
    fetched = fetched.select(
        F.concat(F.lit("https://listings.test/"), "page_id", F.lit("/"), "n").alias("url"), "status", "status_reason",
        F.date_add(F.lit("2001-01-01").cast("date"), ((F.col("page_id") + F.col("n")) % 7).cast("int")).cast("timestamp").alias("fetched_at"),
    )
    stored = listings(spark, sf, ["id", "listing_url"]).withColumns({
        "is_active": F.lit(None).cast("int"), "status_reason": F.lit(None).cast("string"), **{c: F.lit(None).cast("timestamp") for c in ("status_checked_at", "removed_at")},
    })
    states = materialize(status.fold_events(materialize(status.status_events(stored, fetched), "status-events")), "status-states")
    return _show_status(status.apply_status(stored, states))


@query("ingest_pages", "D12", "F12", "A23", sql=f"""{WITH}
SELECT count(*) AS parsed, count(*) FILTER (year >= 1998) AS recent, count(*) FILTER (year < 1998) AS old, 0 AS unknown_date,
  count(DISTINCT source_listing_id) FILTER (year >= 1998) AS added, 0 AS upserted, count(DISTINCT source_listing_id) FILTER (year >= 1998) AS stored FROM listings""")
def ingest_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Result pages to the raw table in one job: parse, repair, label, keep recent rows, number, merge; with its counters."""
    pages = result_pages(spark, sf, dated=True)
    rows = pg.parse_results(pages, "market", base_url="https://pages.test/")
    path = f"{work_dir(spark)}/raw-{uuid.uuid4().hex}"
    return ingest.ingest_rows(rows, path, ingest.PageFilters(), ingest.GENERAL, cutoff="1998-01-01", run_date=RUN_DATE, captured_at="2001-12-31 06:00:00").counters


@query("recleaned_listings", "I7", "D12", sql=f"""{WITH}, t AS (SELECT DISTINCT ON (source_listing_id) source_listing_id, brand, price, mileage_km <= 250000 AS dated, year FROM listings WHERE year >= 1998 ORDER BY source_listing_id, id)
SELECT count(DISTINCT source_listing_id) AS decided FROM t""")
def recleaned_listings(spark: SparkSession, sf: str) -> DataFrame:
    """The clean build over the raw table right after its pages were taken in; every stored row is decided."""
    rows = pg.parse_results(result_pages(spark, sf, dated=True), "market", base_url="https://pages.test/")
    path = f"{work_dir(spark)}/raw-{uuid.uuid4().hex}"
    ingest.ingest_rows(rows, path, ingest.PageFilters(), ingest.GENERAL, cutoff="1998-01-01", run_date=RUN_DATE, captured_at="2001-12-31 06:00:00")
    stored = read_merged(spark, path, ingest.MERGE_ORDER)
    return decide_rows(stored, brand_map(table(spark, sf, "part").select("p_brand").distinct()), CleanRules(), ["id"]).agg(F.count("*").alias("decided"))
