"""Keyed merge of arriving listings into the raw table, merged on read.

A batch is written once, as it came, to a folder of its own number; nothing stored is rewritten, so a batch of n rows
costs n rows of writing however large the table is. Reading folds all batches by key. ``compact_table``
replaces many batches by one base that keeps only what decides something, so that reading it folds to the same
rows. A folder counts once its write has succeeded, and a batch number that is stored already is not written
again: a replayed batch changes nothing.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

KEYS = ("source", "source_listing_id")
# A null in a newer row does not erase these.
STICKY = ("paint_status", "changed_part_status", "damage_status")
FLAG = "is_clean_claimed"
#: Number of the batch a stored row came with.
BATCH = "merge_batch"
#: Of stored rows, which are mostly ids and texts.
CODEC = "zstd"


def fold_by_key(rows: DataFrame, order: Sequence[str], keys: Sequence[str] = KEYS, first: Sequence[str] = ()) -> DataFrame:
    """One row per key: newest values win, sticky columns keep their last non-null, the flag never falls back.

    The row id is that of the earliest arrival; columns named in ``first`` precede the order for it.
    Rows without a listing id never conflict and pass through. Everything is a grouping with
    map-side combine, so a key with very many arrivals is reduced before the shuffle.
    """
    order_struct = F.struct(*order)
    complete = F.lit(True)
    for key in keys:
        complete = complete & F.col(key).isNotNull()
    special = [c for c in (*STICKY, FLAG) if c in rows.columns]
    first_id = ["id"] if "id" in rows.columns and "id" not in order else []
    plain = [c for c in rows.columns if c not in (*keys, *special, *first_id, *order)]
    aggregates: list[Column] = [F.max(F.struct(order_struct.alias("__o"), *plain)).alias("__latest")]
    for name in special:
        if name == FLAG:
            aggregates.append(F.max(F.coalesce(F.col(FLAG), F.lit(0))).alias(FLAG))
        else:
            present = F.col(name).isNotNull()
            aggregates.append(F.max(F.when(present, F.struct(order_struct.alias("__o"), F.col(name).alias("v")))).alias(name))
    aggregates += [F.min(F.struct(*first, order_struct.alias("__o"), F.col(c).alias("v"))).alias(c) for c in first_id]
    folded = rows.where(complete).groupBy(*keys).agg(*aggregates)
    out = []
    for name in rows.columns:
        if name in keys or name == FLAG:
            out.append(F.col(name))
        elif name in special or name in first_id:
            out.append(F.col(f"{name}.v").alias(name))
        elif name in order:
            out.append(F.col(f"__latest.__o.{name}").alias(name))
        else:
            out.append(F.col(f"__latest.{name}").alias(name))
    return folded.select(*out).unionByName(rows.where(~complete))


def deciding_rows(rows: DataFrame, order: Sequence[str], keys: Sequence[str] = KEYS, first: Sequence[str] = (BATCH,)) -> DataFrame:
    """Rows that fold to the same as ``rows``, at most a few for each key and one where a row decides all.

    The newest row carries the key's flag. An older row that gave a sticky value or the row id is left with that, its order
    and ``first``; an id stays on the earliest row only. So only the newest row is grouped whole.
    """
    complete = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    sticky = [c for c in STICKY if c in rows.columns]
    with_id = "id" in rows.columns and "id" not in order
    special = [*sticky, *[FLAG] * (FLAG in rows.columns), *["id"] * with_id]
    newest = F.struct(*order).alias("o")
    # where the newest rows are equal in order, the greatest wins, as in the fold
    values = [c for c in rows.columns if c not in (*keys, *special, *order)]
    picks = [F.max(F.struct(newest, *values)).alias("latest")]
    picks += [F.max(F.when(F.col(c).isNotNull(), F.struct(newest, F.col(c).alias("v"), *first))).alias(f"last_{n}") for n, c in enumerate(sticky)]
    picks += [F.max(F.coalesce(F.col(FLAG), F.lit(0))).alias("flag")] * (FLAG in rows.columns)
    picks += [F.min(F.struct(*first, newest, F.col("id").alias("v"))).alias("earliest")] * with_id
    grouped = rows.where(complete).groupBy(*keys).agg(*picks)
    kinds = {f.name: f.dataType for f in rows.schema.fields}

    def place(of: str) -> Column:
        return F.struct(*[F.col(f"{of}.{c}") for c in first], F.col(f"{of}.o"))

    def row(of: str, given: dict[str, Column]) -> Column:
        given = {k: F.col(k) for k in keys} | {c: F.col(f"{of}.o.{c}") for c in order} | {c: F.col(f"{of}.{c}") for c in first} | given
        if with_id:
            given["id"] = F.when(place(of).eqNullSafe(place("earliest")), F.col("earliest.v"))
        return F.struct(*[given.get(c, F.lit(None)).cast(kinds[c]).alias(c) for c in rows.columns])

    whole = {c: F.col(f"latest.{c}") for c in values} | ({FLAG: F.col("flag")} if FLAG in rows.columns else {})
    older, met = [], place("latest").eqNullSafe(place("earliest")) if with_id else F.lit(True)
    for n, c in enumerate(sticky):
        last = f"last_{n}"
        own = F.col(f"{last}.o").eqNullSafe(F.col("latest.o"))
        whole[c] = F.when(own, F.col(f"{last}.v"))
        older.append(F.when(F.col(last).isNotNull() & ~own, row(last, {c: F.col(f"{last}.v")})))
        if with_id:
            met = met | (F.col(last).isNotNull() & ~own & place(last).eqNullSafe(place("earliest")))
    if with_id:
        older.append(F.when(~met, row("earliest", {})))
    stored = F.array_compact(F.array(row("latest", whole), *older))
    return grouped.select(F.inline(stored)).unionByName(rows.where(~complete))


def _numbers(spark: SparkSession, path: str, kind: str) -> list[int]:
    """Numbers of the folders of a kind whose write has succeeded; one entry per batch since the last compaction."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    folder = hadoop(f"{path}/{kind}")
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return []
    names = [s.getPath().getName() for s in files.listStatus(folder)]
    return sorted(int(n.rpartition("=")[2]) for n in names if "=" in n and files.exists(hadoop(f"{path}/{kind}/{n}/_SUCCESS")))


def _stored(spark: SparkSession, path: str) -> tuple[DataFrame | None, int, list[int]]:
    """All rows of a table with their batch number, the last batch in its base (-1: none), and the batches after it."""
    base = max(_numbers(spark, path, "base"), default=-1)
    later = [n for n in _numbers(spark, path, "batches") if n > base]
    folders = [f"{path}/base/upto={base}"] * (base >= 0) + [f"{path}/batches/batch={n}" for n in later]
    if not folders:
        return None, base, later
    return spark.read.option("mergeSchema", True).parquet(*folders), base, later


def read_merged(spark: SparkSession, path: str, order: Sequence[str]) -> DataFrame | None:
    """The table folded by key: one row for each, rows without a listing id as they are; None before the first batch."""
    rows, _, _ = _stored(spark, path)
    return None if rows is None else fold_by_key(rows, order, first=(BATCH,)).drop(BATCH)


def merge_into_table(spark: SparkSession, path: str, batch: DataFrame, order: Sequence[str], batch_id: int = 0) -> DataFrame:
    """Store a batch under its number and count: one row (upserted, added, stored).

    Numbers rise: one at or below the base, or stored after it, is a replay and nothing is written. ``order`` says at reading which of two rows is
    newer. Counting reads the key columns of the table, once.
    """
    stored, base, later = _stored(spark, path)
    replayed = batch_id <= base or batch_id in later
    target = f"{path}/batches/batch={batch_id}"
    if not replayed:
        batch.withColumn(BATCH, F.lit(batch_id).cast("bigint")).write.mode("overwrite").parquet(target, compression=CODEC)
        batch = spark.read.parquet(target).drop(BATCH)
    keyed = lambda df, new: df.select(*KEYS, F.lit(new).alias("new"))
    rows = keyed(batch, True) if stored is None else keyed(batch, True).unionByName(keyed(stored, False))
    complete = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in KEYS])
    groups = rows.groupBy(*KEYS, "new").agg(F.count("*").alias("n")).groupBy(*KEYS, complete.alias("complete")).agg(
        F.sum(F.when(F.col("new"), F.col("n"))).alias("arrived"), F.sum(F.when(~F.col("new"), F.col("n"))).alias("held"),
    )
    fresh = F.when(F.col("complete"), (F.col("held").isNull()).cast("long")).otherwise(F.coalesce("arrived", F.lit(0)))
    size = F.when(F.col("complete"), F.lit(1)).otherwise(F.coalesce("held", F.lit(0)) + (F.lit(0) if replayed else F.coalesce("arrived", F.lit(0))))
    return groups.agg(
        F.coalesce(F.sum("arrived"), F.lit(0)).alias("upserted"),
        F.coalesce(F.lit(0).cast("long") if replayed else F.sum(fresh), F.lit(0)).alias("added"),
        F.coalesce(F.sum(size), F.lit(0)).alias("stored"),
    )


def compact_table(spark: SparkSession, path: str, order: Sequence[str]) -> int:
    """Put base and batches into a new base; the number of batches that went into it. What it replaces is then deleted.

    Run it between batches, not beside readers that started before. A failure leaves the table as it was.
    """
    rows, base, later = _stored(spark, path)
    if not later:
        return 0
    deciding_rows(rows, order).write.mode("overwrite").parquet(f"{path}/base/upto={later[-1]}", compression=CODEC)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    for folder in [f"{path}/base/upto={base}"] * (base >= 0) + [f"{path}/batches/batch={n}" for n in later]:
        hadoop(folder).getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop(folder), True)
    return len(later)
