"""Scores as SQL functions, for queries written in SQL.

The bodies are SQL text that the optimizer inlines, so a call costs what the column expression costs.
``scoring`` holds the same rules as columns; tests hold both against each other.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from pricelens.functions import scoring as s

#: name: (parameters, type of the result, body)
FUNCTIONS: dict[str, tuple[str, str, str]] = {
    "distance_score": (
        "value DOUBLE, target DOUBLE, scale DOUBLE", "DOUBLE",
        f"CASE WHEN target IS NULL THEN {s.NO_TARGET}D WHEN value IS NULL THEN {s.NO_VALUE}D ELSE least(greatest(1 - abs(value - target) / scale, 0D), 1D) END",
    ),
    "mileage_scale": ("target DOUBLE", "DOUBLE", "greatest(coalesce(nullif(target, 0D), 100000D) * 0.75D, 80000D)"),
    "freshness_score": (
        "age_days DOUBLE, any_dates BOOLEAN", "DOUBLE",
        f"CASE WHEN NOT any_dates THEN {s.NO_TARGET}D WHEN age_days IS NULL THEN {s.NO_VALUE}D ELSE least(greatest(1 - age_days / 45D, 0.35D), 1D) END",
    ),
    "similarity": (
        "year DOUBLE, mileage DOUBLE, model DOUBLE, freshness DOUBLE", "DOUBLE",
        f"least(greatest({s.YEAR_WEIGHT}D * year + {s.MILEAGE_WEIGHT}D * mileage + {s.MODEL_WEIGHT}D * model + {s.FRESHNESS_WEIGHT}D * freshness, 0.05D), 1D)",
    ),
    "percent_change": ("new DOUBLE, old DOUBLE", "DOUBLE", "CASE WHEN old <> 0 THEN (new - old) / old * 100 END"),
    "price_delta": ("asking DOUBLE, market DOUBLE", "DOUBLE", "CASE WHEN market > 0 THEN (asking - market) / market * 100 END"),
    "sample_status": ("n BIGINT", "STRING", f"CASE WHEN n IS NULL OR n = 0 THEN 'empty' WHEN n >= {s.MIN_SAMPLE} THEN 'ok' ELSE 'low_sample' END"),
}


def register_functions(spark: SparkSession) -> list[str]:
    """Define the functions for this session as ``listing_<name>``; defining them again changes nothing."""
    for name, (parameters, result, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION listing_{name}({parameters}) RETURNS {result} RETURN {body}")
    return [f"listing_{name}" for name in FUNCTIONS]
