"""Training data for the condition model."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from pricelens.schemas import TRAINING


def read_training_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with header; columns are matched by name, and numbers that do not parse become null."""
    text = spark.read.option("header", True).csv(path)
    present = [f.name for f in TRAINING if f.name in text.columns]
    return text.select(*present)


def write_metrics(spark: SparkSession, report: dict, folder: str) -> None:
    """One JSON record with the run's counts, metrics and importances."""
    spark.createDataFrame([(json.dumps(report, ensure_ascii=False),)], "value string").write.mode("overwrite").text(folder)
