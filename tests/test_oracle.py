"""A sample of registered queries against DuckDB; tools/check_oracle.py covers all of them."""

from __future__ import annotations

from pathlib import Path

import pytest

duckdb = pytest.importorskip("duckdb")

import __spark_entry__ as entry  # noqa: E402
from tools.check_oracle import cell, connect  # noqa: E402

SF = "/root/testdata/sf0.001"
SAMPLE = (
    "filtered_listing_scan", "overview_filtered", "table_by_brand", "price_by_mileage_band", "newest_listings", "selector_counts", "price_band_counts",
    "similarity_scores", "weighted_quantiles_by_brand", "newest_by_listing_key", "document_keys", "market_snapshots", "catalog_coverage",
    "parsed_pages", "page_status", "listing_upsert", "listing_status", "training_frame",
)


@pytest.mark.skipif(not Path(SF).exists(), reason="benchmark tables are not here")
@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_oracle(spark, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(cell(r[c]) for c in columns) for r in df.collect()), key=repr)
    result = connect(SF).execute(entry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    assert sorted(names) == columns
    assert got == sorted((tuple(cell(r[i]) for i in order) for r in result.fetchall()), key=repr)


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
