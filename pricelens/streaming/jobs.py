"""Incremental jobs on Structured Streaming.

Each job runs with ``availableNow`` so that the same definition serves a scheduled catch-up and
an always-on query (leave the trigger out).
"""

from __future__ import annotations

import hashlib
import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from pricelens.operators.merge import compact_table, merge_into_table
from pricelens.plans.status import compact_events, fold_events
from pricelens.session import materialize


def checkpoint_for(base: str, name: str, **context: object) -> str:
    """Checkpoint folder of a job and its settings: other settings start from the beginning."""
    text = json.dumps(context, sort_keys=True, default=str)
    return f"{base}/{name}-{hashlib.sha256(text.encode()).hexdigest()[:16]}"


def read_arrivals(spark: SparkSession, folder: str, schema, pattern: str = "*.parquet", files_per_trigger: int = 8) -> DataFrame:
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    return reader.option("pathGlobFilter", pattern).parquet(folder)


def merge_arrivals(arrivals: DataFrame, table_path: str, order: list[str], checkpoint: str, compact_every: int = 16) -> StreamingQuery:
    """Store every micro-batch in the raw table, merged on read; a replayed batch changes nothing. Batches are compacted now and then."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        merge_into_table(batch.sparkSession, table_path, batch, order, batch_id)
        if batch_id % compact_every == compact_every - 1:
            compact_table(batch.sparkSession, table_path, order)

    return arrivals.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def without_repeats(arrivals: DataFrame, keys: list[str], event_time: str, delay: str) -> DataFrame:
    """Drop repeat deliveries of one key that arrive within the delay of each other."""
    return arrivals.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(keys)


def append_to(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def window_statistics(arrivals: DataFrame, event_time: str, keys: list[str], value: str, width: str = "1 day", delay: str = "1 day") -> DataFrame:
    """Mean, range and count per time window and key, with state dropped behind the watermark."""
    grouped = arrivals.withWatermark(event_time, delay).groupBy(F.window(event_time, width), *keys)
    return grouped.agg(F.avg(value).alias("mean"), F.min(value).alias("minimum"), F.max(value).alias("maximum"), F.count("*").alias("count"))


def upsert_windows(stats: DataFrame, table_path: str, keys: list[str], checkpoint: str) -> StreamingQuery:
    """Keep the newest figures of every window in a table: one folder per batch, newest wins on read."""

    def write(batch: DataFrame, batch_id: int) -> None:
        flat = batch.select(F.col("window.start").alias("window_start"), *[c for c in batch.columns if c != "window"])
        flat.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{table_path}/batch={batch_id}")

    return stats.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_windows(spark: SparkSession, table_path: str, keys: list[str]) -> DataFrame:
    rows = spark.read.parquet(table_path).drop("batch")
    values = [c for c in rows.columns if c not in ("window_start", "batch_id", *keys)]
    newest = rows.groupBy("window_start", *keys).agg(F.max(F.struct("batch_id", *values)).alias("v"))
    return newest.select("window_start", *keys, *[F.col(f"v.{c}").alias(c) for c in values])


def fold_status(events: DataFrame, table_path: str, checkpoint: str) -> StreamingQuery:
    """Keep the events that decide every listing's status: each micro-batch is compacted with those stored.

    The table alternates between folders named by batch, so a failed write never damages what it started
    from, and a replayed batch changes nothing.
    """

    def fold(batch: DataFrame, batch_id: int) -> None:
        previous = _stored_events(batch.sparkSession, table_path, before=batch_id)
        both = batch if previous is None else batch.unionByName(previous)
        compact_events(materialize(both, "status-batch")).write.mode("overwrite").parquet(f"{table_path}/batch={batch_id}")

    return events.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _stored_events(spark: SparkSession, table_path: str, before: int | None = None) -> DataFrame | None:
    """Events of the newest complete batch, or of the newest one before a given batch."""
    try:
        rows = spark.read.parquet(table_path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    if before is not None:
        rows = rows.where(F.col("batch") < before)
    newest = rows.agg(F.max("batch")).scalar()
    return rows.where(F.col("batch") == newest).drop("batch")


def read_states(spark: SparkSession, table_path: str) -> DataFrame | None:
    """Status of every listing seen so far."""
    events = _stored_events(spark, table_path)
    return None if events is None else fold_events(events)
