"""Headline queries, timed: prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS the local cores.
Every query is materialized in full through the no-op sink. One untimed query warms the session;
the median of BENCH_RUNS (default 1) runs counts.
"""

from __future__ import annotations

import json
import os
import statistics
import time
from pathlib import Path

from pricelens.session import build_session
from pricelens.suite import load

HEADLINE = (
    "overview_all", "overview_filtered", "table_by_brand", "price_by_year", "price_by_mileage_band", "daily_trend",
    "price_quartiles_by_model", "newest_listings", "selector_counts", "market_snapshots", "movers_up", "catalog_coverage",
    "listing_upsert", "newest_by_listing_key", "model_price_outliers", "similarity_scores", "market_analysis",
    "valuation_answers", "row_decisions", "clean_listings", "parsed_pages", "page_status", "listing_status", "training_frame",
    "valuation_trend", "merged_table", "status_stream", "daily_window_stream",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    only = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n]
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "20g", "spark.sql.shuffle.partitions": cpus},
    )
    spark.sparkContext.setLogLevel("ERROR")
    registry = load().QUERIES
    registry["table_by_brand"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in only or HEADLINE:
        spent = []
        for _ in range(runs):
            start = time.perf_counter()
            registry[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            spent.append(time.perf_counter() - start)
        times[name] = round(statistics.median(spent), 3)
    print(json.dumps({
        "metric": "total seconds of headline queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": Path(sf_dir).name,
    }))


if __name__ == "__main__":
    main()
