"""Market questions and valuation on the small published cases."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from pricelens.operators.filters import ListingFilters
from pricelens.plans import condition, market, snapshots as snap, valuation
from pricelens.schemas import REQUEST, SNAPSHOT, conform
from pricelens.sources import listings as src

RUN_DATE = "2026-07-10"


@pytest.fixture(scope="module")
def clean(spark):
    rows = [
        (1, "Test Sedan", "Test", "A", "1.0", 2020, 80000, "Sedan", 900000, "1 Temmuz 2026", dt.datetime(2026, 7, 1, 12), 1),
        (2, "Test Sedan", "Test", "A", "1.0", 2021, 65000, "Sedan", 1000000, "2 Temmuz 2026", dt.datetime(2026, 7, 2, 12), 0),
    ]
    return spark.createDataFrame(rows, "id bigint, title string, brand string, series string, model string, year int, mileage_km int, body_type string, "
                                       "price bigint, listing_date string, scraped_at timestamp, is_clean_claimed int")


def request(spark, **fields):
    row = {"request_id": "r", "brand": "Test", "series": "A", "model": "1.0", **fields}
    return conform(spark.createDataFrame([tuple(row.get(f.name) for f in REQUEST)], REQUEST), REQUEST)


def test_overview_and_missing_history(spark, clean):
    empty = spark.createDataFrame([], SNAPSHOT)
    (row,) = snap.overview_with_changes(market.overview(clean), market.table_facts(clean), empty).collect()
    assert row.listing_count == 2 and row.median_price == 950000.0 and row.change_30d is None
    assert row.last_updated_at == dt.datetime(2026, 7, 2, 12)
    assert snap.movers(empty).count() == 0
    trend = market.daily_trend(clean, RUN_DATE)
    assert market.trend_summary(trend).first().available
    assert [r.median_price for r in trend.orderBy("date").collect()] == [900000.0, 1000000.0]


def test_valuation_reports_a_low_sample(spark, clean):
    run = valuation.prepare(request(spark, year=2020, mileage_km=80000), clean)
    row = valuation.value_requests(run).first()
    assert (row.status, row.listing_count, row.matched_listing_count) == ("low_sample", 1, 2)
    only_clean = valuation.value_requests(valuation.prepare(request(spark, clean_only=True), clean)).first()
    assert (only_clean.status, only_clean.listing_count, only_clean.clean_only) == ("low_sample", 1, True)


def test_valuation_without_match_is_empty(spark, clean):
    row = valuation.value_requests(valuation.prepare(request(spark, brand="Nobody"), clean)).first()
    assert row.status == "empty" and row.estimated_market_value is None and row.matched_listing_count == 0


def test_condition_factor_scales_the_answer(spark, clean):
    run = valuation.prepare(request(spark), clean)
    factors = spark.createDataFrame([("r", 0.93, -7.0)], "request_id string, factor double, percent double")
    plain, scaled = valuation.value_requests(run).first(), valuation.value_requests(run, factors).first()
    assert scaled.estimated_market_value == pytest.approx(plain.estimated_market_value * 0.93)
    assert scaled.condition_adjustment_percent == -7.0


def test_raw_table_is_used_when_clean_is_empty(spark, clean):
    raw = spark.createDataFrame([(1, "Ham ilan", "Test", "A", "1.0", 2020, 80000, 900000)], "id bigint, title string, brand string, series string, model string, year int, mileage_km int, price bigint")
    assert src.load_listings(src.choose_table(clean.limit(0), raw)).count() == 1
    assert src.choose_table(clean, raw) is clean
    with pytest.raises(src.ListingsUnavailable):
        src.choose_table(None, None)


def test_snapshot_is_idempotent(spark, clean, tmp_path):
    path = str(tmp_path / "snapshots")
    for _ in range(2):
        snap.save_snapshot(snap.daily_snapshot(clean, "2026-07-23"), path)
    snap.save_snapshot(snap.daily_snapshot(clean, "2026-07-24"), path)
    stored = snap.read_snapshots(spark, path)
    assert sorted((str(r.snapshot_date), r.dimension_key, r.listing_count) for r in stored.collect()) == [("2026-07-23", "market:all", 2), ("2026-07-24", "market:all", 2)]


def test_snapshot_changes_use_the_last_earlier_day(spark):
    days = {"2026-01-01": 100.0, "2026-03-01": 200.0, "2026-03-31": 300.0}
    rows = [(dt.date.fromisoformat(d), "market", "all", "market:all", None, p, p, p, p, 1) for d, p in days.items()]
    row = snap.snapshot_changes(spark.createDataFrame(rows, SNAPSHOT)).first()
    assert (row.change_30d, row.change_90d, row.change_yoy) == (50.0, None, None)
    single = snap.snapshot_changes(spark.createDataFrame(rows[:1], SNAPSHOT)).first()
    assert single.change_30d is None


def test_scope_never_answers_a_narrow_filter():
    assert ListingFilters().snapshot_scope() == ("market", "all")
    assert ListingFilters(brand="Test").snapshot_scope() == ("brand", "Test")
    assert ListingFilters(brand="Test", year_min=2020).snapshot_scope() is None


def test_relationship_points(spark):
    rows = list(zip([2020] * 3 + [2021] * 3, [20_000, 25_000, 22_000, 80_000, 90_000, 95_000], [900_000, 920_000, 910_000, 1_000_000, 1_020_000, 980_000], [0] * 6))
    df = spark.createDataFrame(rows, "year int, mileage_km int, price bigint, is_clean_claimed int")
    assert [r.label for r in market.year_points(df).orderBy("position").collect()] == ["2020", "2021"]
    first = market.mileage_points(df).orderBy("position").first()
    assert (first.label, first.listing_count) == ("0-25 bin km", 3)
    summary = market.relationship_summary(df).first()
    assert summary.year_available and not summary.clean_year_available and summary.listing_count == 6


def context_frame(spark):
    years, kms = [2020] * 6 + [2019, 2024], [80_000, 85_000, 90_000, 95_000, 75_000, 70_000, 80_000, 80_000]
    rows = [(900_000 + i * 10_000, y, k, "1.0", "Test") for i, (y, k) in enumerate(zip(years, kms))]
    return spark.createDataFrame(rows, "price bigint, year int, mileage_km int, model string, title string")


def test_analysis_keeps_every_listing_in_the_window(spark):
    frame = context_frame(spark)
    assert valuation.analyze(frame, model="1.0").first().selected_count == 8
    targeted = valuation.analyze(frame, model="1.0", year=2020, mileage=80_000).first()
    assert (targeted.selected_count, targeted.raw_count, targeted.status) == (6, 8, "low_sample")


def test_analysis_does_not_reach_for_distant_mileage(spark):
    far = spark.createDataFrame([(900_000, 2020, 250_000, "1.0", "T"), (920_000, 2021, 270_000, "1.0", "T")], "price bigint, year int, mileage_km int, model string, title string")
    row = valuation.analyze(far, model="1.0", year=2020, mileage=80_000).first()
    assert (row.status, row.selected_count, row["count"]) == ("empty", 0, 0)


def test_condition_inputs_fill_year_and_mileage_from_medians(spark):
    asked = request(spark, changed_parts=2)
    medians = spark.createDataFrame([("r", 2021, 70_000)], "request_id string, median_year int, median_mileage_km bigint")
    row = condition.condition_inputs(asked, medians).first()
    assert (row.yil, row.kilometre, row.degisen_sayisi, row.boyali_sayisi) == (2021.0, 70000.0, 2.0, 0.0)
    assert condition.condition_inputs(asked).count() == 0


def test_condition_factor_is_a_capped_ratio(spark):
    rows = [("a", 1_000_000.0, 930_000.0, 1.0, 0.0), ("b", 1_000_000.0, 400_000.0, 3.0, 0.0), ("c", 1_000_000.0, 1_200_000.0, 0.0, 0.0), ("d", 1_000_000.0, 1_100_000.0, 1.0, 0.0)]
    prices = spark.createDataFrame(rows, "request_id string, reference double, vehicle double, degisen_sayisi double, boyali_sayisi double")
    got = {r.request_id: (round(r.factor, 4), round(r.percent, 4), r.capped) for r in condition.factors_from_prices(prices).collect()}
    assert got == {"a": (0.93, -7.0, False), "b": (0.65, -35.0, True), "c": (1.0, 0.0, False), "d": (1.0, 0.0, True)}


def test_training_frame_drops_the_impossible_row(spark):
    rows = [("A", "B", "C", 2015, 100_000 + i, 0, 1, 500_000 + i) for i in range(10)] + [("A", "B", "C", 2015, 90_000_000, 0, 1, 500_000)]
    raw = spark.createDataFrame(rows, "marka string, seri string, model string, yil int, kilometre int, degisen_sayisi int, boyali_sayisi int, fiyat bigint")
    assert condition.training_frame(raw).count() == 10
    assert condition.funnel(raw).first().removed_hard_limits == 1
    assert condition.training_frame(raw).columns == [*condition.FEATURES, condition.TARGET]
    with pytest.raises(ValueError, match="fiyat"):
        condition.core_rows(raw.drop("fiyat"))


def test_valuation_of_places_and_missing_values(spark):
    """Every kind of request against a plain count: rows without year or mileage are in no window, contexts are numbers."""
    rows = [(n, ("A", "b")[n % 2], ("x", None)[n % 3 == 0], ("m", "k")[n % 5 == 0], None if n % 7 == 0 else 2000 + n % 3, None if n % 11 == 0 else 13_000 * (n % 9), 1000 + n, n % 2) for n in range(120)]
    rows = rows + rows[:30]
    frame = spark.createDataFrame(rows, "id long, brand string, series string, model string, year int, mileage_km int, price long, is_clean_claimed int")
    asked = [("1", "a", None, None, None, None, False), ("2", "B ", "X", None, 2001, 40_000, False), ("3", None, None, None, None, None, True), ("4", None, None, None, 2002, None, False),
             ("5", "a", None, "m", None, 52_000, True), ("6", "a", None, None, None, None, False), ("7", None, None, None, None, 65_000, False)]
    requests = conform(spark.createDataFrame([tuple(dict(zip(("request_id", "brand", "series", "model", "year", "mileage_km", "clean_only"), a)).get(f.name) for f in REQUEST) for a in asked], REQUEST), REQUEST)
    run = valuation.prepare(requests, frame)
    got = {r.request_id: (r.matched_listing_count, r.selected_listing_count) for r in valuation.value_requests(run).collect()}
    want = {}
    for name, brand, series, model, year, km, clean_only in asked:
        same = lambda asked_for, value: not (asked_for or "").strip() or (value or "").lower() == asked_for.strip().lower()
        hits = [r for r in rows if same(brand, r[1]) and same(series, r[2]) and same(model, r[3]) and (not clean_only or r[7] == 1)]
        wide = max(int((km or 0) * 0.3), 25_000)
        inside = [r for r in hits if (year is None or r[4] == year) and (km is None or (r[5] is not None and max(0, km - wide) <= r[5] <= km + wide))]
        want[name] = (len(hits), len(inside))
    assert got == want and dict(run.pairs.dtypes)["context_id"] == "bigint"
    assert run.contexts.count() == 6


def test_many_price_bounds_are_not_sent(spark, monkeypatch):
    """Contexts beyond the bound: used rows are written, by a shuffle of the pairs, but for the heavy context; answers stay."""
    rows = [(n, ("A", "b")[n % 2], "x", "m", 2000 + n % 3, 13_000 * (n % 9), 1000 + 37 * (n * n % 101) + 90_000 * (n % 50 == 0), n % 2) for n in range(400)]
    frame = spark.createDataFrame(rows, "id long, brand string, series string, model string, year int, mileage_km int, price long, is_clean_claimed int")
    asked = [("1", "a", None, 40_000), ("2", None, None, None), ("3", None, 2001, None), ("4", "b", None, 65_000), ("5", "c", None, None)]
    requests = conform(spark.createDataFrame([tuple(dict(zip(("request_id", "brand", "year", "mileage_km"), a)).get(f.name) for f in REQUEST) for a in asked], REQUEST), REQUEST)

    def answers(run):
        own = run.requests.select("request_id", "context_id")
        buckets = own.join(valuation.mileage_buckets(run.used), "context_id").drop("context_id").orderBy("request_id", "bucket").collect()
        return [*valuation.value_requests(run).orderBy("request_id").collect(), *buckets]

    few = answers(valuation.prepare(requests, frame))
    # at most 768,000 bounds raised the driver by some 340 MB
    assert valuation.BROADCAST_BOUNDS <= 100_000
    monkeypatch.setattr(valuation, "BROADCAST_BOUNDS", 1)
    monkeypatch.setattr(valuation, "HEAVY_ROWS", 390)
    monkeypatch.setattr(valuation, "HEAVY_SHARE", 100)
    many = valuation.prepare(requests, frame)
    assert all("valuation-used" in f for f in many.used.inputFiles()) and not many.used.isEmpty()
    assert few == answers(many) and len(few) > 10 and any(r.outlier_count for r in few if "outlier_count" in r)


def test_training_partitions_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(condition, "TASK_ROWS", 100)
    rows = condition.in_tasks(spark.range(1000).coalesce(1))
    assert rows.rdd.getNumPartitions() == 10 and rows.count() == 1000
    assert condition.in_tasks(spark.range(90).coalesce(1)).rdd.getNumPartitions() == 1


def test_scored_listings_are_written_once_for_dates(spark, clean):
    scored = valuation.score_listings(clean, year=2020, freshness=True, run_date=RUN_DATE)
    assert any("scored-listings" in f for f in scored.inputFiles()) and scored.count() == 2
