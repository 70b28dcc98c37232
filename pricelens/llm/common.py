"""Shared helpers: table access, Arrow batches, hashing columns."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from pricelens.llm.sieve import free_prefix, quoted, sieved
from pricelens.session import discard, materialize, work_dir

__all__ = ["BATCH_BYTES", "BATCH_ROWS", "crc_of_id", "discard", "first_by_hash", "free_prefix", "keep_only", "map_batches", "materialize", "partitions", "pieces", "quoted", "table", "text_list", "work_dir"]

#: Rows and bytes in one Arrow batch that an operator's function works on: whole texts may be long, so batches stay small.
BATCH_ROWS = 2048
BATCH_BYTES = 8 << 20
#: Bytes of one Arrow batch that Spark hands to a worker.
SENT_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    """Shuffle partitions of the session: the unit by which hot groups are split."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def pieces(batches: Iterator[pa.RecordBatch], rows: int, size: int) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in batches of at most ``rows`` rows and ``size`` bytes; one row may be larger."""
    for batch in batches:
        left = [batch.slice(a, rows) for a in range(0, batch.num_rows, rows)][::-1]
        while left:
            piece = left.pop()
            if piece.num_rows > 1 and piece.nbytes > size:
                half = piece.num_rows // 2
                left += [piece.slice(half), piece.slice(0, half)]
            else:
                yield piece


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]], schema: str | StructType, rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> DataFrame:
    """``mapInArrow`` over batches of at most ``rows`` rows and about ``size`` bytes.

    The session's bound on the bytes of an Arrow batch is set to SENT_BYTES, the same for every plan: it only bounds memory.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(SENT_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        yield from fn(pieces(batches, rows, size))
        give_back()

    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Return a worker's freed memory to the system: workers live on from task to task, beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def text_list(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """A column's texts; null counts as empty."""
    return [t or "" for t in batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False).tolist()]


def crc_of_id(column: str | Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo: the fold of a row. A null id falls into fold 0."""
    ident = F.col(column) if isinstance(column, str) else column
    return F.coalesce(F.crc32(ident.cast("string").cast("binary")) % modulus, F.lit(0))


def first_by_hash(df: DataFrame, hashed: Column, wanted: int, rows: int) -> DataFrame:
    """``wanted`` of about ``rows`` rows, in the order of a hash.

    Hashes far beyond the wanted ones are left out first, so that what tasks send for the final order has the
    size of the sample, whatever their number. Repeated hashes are expected to be no more than half.
    """
    place = F.pmod(hashed, F.lit(1 << 40))
    near = df.withColumn("hash_place", place)
    if rows > 2 * wanted:
        near = near.filter(F.col("hash_place") < (1 << 40) * 2 * wanted // rows)
    return near.orderBy("hash_place", *df.columns[:1]).limit(wanted).drop("hash_place")


def keep_only(docs: DataFrame, key: Column, verdicts: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``verdicts`` (doc_id, key, kept: one row per row of docs) keeps, all columns.

    Rows whose id surely has no rejected or repeated key stay where they are; only the others get their key and are shuffled, to an
    anti join with the rejected keys. Of rows equal in doc_id and key one stays. ``verdicts`` is read before this returns, never after.
    """
    mark = free_prefix(docs, "verdict")
    ident, value, own, maybe = f"{mark}id", f"{mark}key", f"{mark}own", f"{mark}maybe"
    per = materialize(verdicts.groupBy("doc_id", "key").agg(F.max("kept").alias("any"), F.count("*").alias("rows")), "verdicts")
    named = per.select(F.col("doc_id").alias(ident), F.col("key").alias(value), "any", "rows")
    lost = named.filter(~F.col("any")).select(ident, value)
    doubled = named.filter(F.col("any") & (F.col("rows") > 1)).select(ident, value)
    marked = sieved(docs.withColumn(own, F.col("doc_id").cast("long")), own, lost.unionByName(doubled).select(F.col(ident).alias(own)), name=maybe)
    sure = marked.filter(~F.col(maybe)).select(quoted(docs.columns))
    keyed = marked.filter(maybe).drop(maybe).withColumn(own, key)
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(ident)) & (F.col(own) == F.col(value))
    left = keyed.join(lost, same, "left_anti")
    if doubled.isEmpty():
        return sure.union(left.select(quoted(docs.columns)))
    once = left.join(doubled, same, "left_semi").dropDuplicates(["doc_id", own])
    return sure.union(left.join(doubled, same, "left_anti").unionByName(once).select(quoted(docs.columns)))
