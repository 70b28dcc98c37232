"""Order statistics against numpy, including one key that holds most rows."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from pricelens.operators.bands import adaptive_bucket, adaptive_bucket_count, default_price_bands, parse_price_bands
from pricelens.operators.quantiles import price_statistics
from pricelens.operators.ranking import ordered_rank


def weighted(values, weights, q):
    order = np.argsort(values, kind="stable")
    cum = np.cumsum(np.array(weights)[order])
    return float(np.array(values)[order][np.argmax(cum >= q * cum[-1])])


@pytest.mark.parametrize("integers", [True, False])
def test_quantiles_match_numpy(spark, integers):
    rng = np.random.default_rng(7)
    rows = []
    for key, size in (("hot", 3000), ("b", 11), ("c", 1), (None, 40)):
        values = rng.integers(1, 2_000_000, size) if integers else rng.random(size) * 1e6
        rows += [(key, int(v) if integers else float(v), int(w)) for v, w in zip(values, rng.integers(1, 9, size))]
    df = spark.createDataFrame(rows, f"k string, price {'bigint' if integers else 'double'}, w bigint")
    out = price_statistics(df, ["k"], quantiles={"q02": 0.02, "q25": 0.25, "q50": 0.5, "q98": 0.98}, weight=F.col("w"), weighted={"w25": 0.25, "w75": 0.75})
    got = {r.k: r for r in out.collect()}
    assert set(got) == {"hot", "b", "c", None}
    for key, row in got.items():
        prices = [p for k, p, _ in rows if k == key]
        weights = [w for k, _, w in rows if k == key]
        assert row["count"] == len(prices) and row.minimum == min(prices) and row.maximum == max(prices)
        assert row.mean == pytest.approx(np.mean(prices))
        for name, q in (("q02", 0.02), ("q25", 0.25), ("q50", 0.5), ("q98", 0.98)):
            assert row[name] == pytest.approx(np.quantile(prices, q))
        assert row.w25 == weighted(prices, weights, 0.25) and row.w75 == weighted(prices, weights, 0.75)
        assert row.weighted_mean == pytest.approx(np.average(prices, weights=weights))


def test_no_rows_gives_one_empty_row_without_keys(spark):
    empty = spark.createDataFrame([], "price bigint")
    (row,) = price_statistics(empty, []).collect()
    assert row["count"] == 0 and row.median is None


def test_segments_overlap(spark):
    df = spark.createDataFrame([(1, 1), (2, 0), (3, 1)], "price bigint, c int")
    out = price_statistics(df, [], segments={"all": F.lit(True), "clean": F.col("c") == 1})
    assert {r.segment: (r["count"], r.median) for r in out.collect()} == {"all": (3, 2.0), "clean": (2, 2.0)}


def test_rank_is_a_permutation_in_value_order(spark):
    rng = np.random.default_rng(3)
    rows = [(int(k), int(v), f"id{i}") for i, (k, v) in enumerate(zip(rng.integers(0, 2, 400), rng.integers(1, 30, 400)))]
    out = ordered_rank(spark.createDataFrame(rows, "k int, v bigint, id string"), ["k"], "v", "id").collect()
    for key in (0, 1):
        ranked = sorted((r for r in out if r.k == key), key=lambda r: r["rank"])
        assert [r["rank"] for r in ranked] == list(range(1, len(ranked) + 1))
        assert [r.v for r in ranked] == sorted(r.v for r in ranked)


def test_adaptive_buckets_cover_all_rows(spark):
    df = spark.createDataFrame([(v,) for v in (60_000, 70_000, 80_000, 90_000)], "v bigint")
    index, lower, upper = adaptive_bucket(F.col("v"), F.lit(60_000), F.lit(90_000), adaptive_bucket_count(F.lit(4)))
    got = [tuple(r) for r in df.select(index, lower, upper).collect()]
    assert got == [(0, 60_000.0, 70_000.0), (1, 70_000.0, 80_000.0), (2, 80_000.0, 90_000.0), (2, 80_000.0, 90_000.0)]


def test_price_bands():
    bands = default_price_bands()
    assert len(bands) == 37 and bands[0] == (0, 100_000, "0-100000") and bands[-1] == (15_000_001, None, "15000001+")
    assert parse_price_bands("0-300, 500+") == [(0, 300, "0-300"), (500, None, "500+")]
    with pytest.raises(ValueError):
        parse_price_bands("cheap")
