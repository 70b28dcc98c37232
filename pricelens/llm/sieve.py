"""Bitmaps of values, sent to every task: what surely is none of them need not be shuffled. Only work is saved; an exact step follows."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F

#: Bits of a bitmap of all fingerprints or shingles (8 MB), and of one of fewer texts, sets or ids (2 MB). The driver gathers each of them.
SIEVE_BITS = 1 << 26
FEW_BITS = 1 << 24


def quoted(names: Iterable[str]) -> list[str]:
    """Column names as Spark reads them back, dots and backticks included."""
    return [f"`{n.replace('`', '``')}`" for n in names]


def free_prefix(df: DataFrame, start: str) -> str:
    """A prefix that no column name of ``df`` has, letter case aside."""
    names = [c.lower() for c in df.columns]
    while any(n.startswith(start.lower()) for n in names):
        start += "_"
    return start


def sieve_of(suspects: DataFrame, size: int = SIEVE_BITS) -> DataFrame:
    """``size`` bits as rows (bucket, words): bit fp mod size is set for every suspect. Never above 8 MB by default."""
    slot = F.pmod("fp", F.lit(size))
    words = suspects.groupBy(F.shiftright(slot, 15).alias("bucket"), F.shiftright(slot, 6).bitwiseAND(511).alias("word")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(fp, 64L) as int))")).alias("bits")
    )
    by_word = words.groupBy("bucket").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("m"))
    return by_word.select("bucket", F.transform(F.sequence(F.lit(0), F.lit(511)), lambda w: F.coalesce(F.col("m")[w.cast("long")], F.lit(0).cast("long"))).alias("words"))


def sieved(rows: DataFrame, value: str, wanted: DataFrame, size: int = FEW_BITS, name: str = "maybe") -> DataFrame:
    """``rows`` with ``name``: false only where column ``value`` is not one of ``wanted``'s, by a bitmap of ``size`` bits. It only saves shuffling."""
    mark = free_prefix(rows, "sieve")
    bucket, words = f"{mark}bucket", f"{mark}words"
    slot = F.pmod(F.xxhash64(value), F.lit(size))
    bits = sieve_of(wanted.select(F.xxhash64(value).alias("fp")), size).select(F.col("bucket").alias(bucket), F.col("words").alias(words))
    found = rows.withColumn(bucket, F.shiftright(slot, 15)).join(F.broadcast(bits), bucket, "left")
    word = F.coalesce(F.col(words)[F.shiftright(slot, 6).bitwiseAND(511).cast("int")], F.lit(0).cast("long"))
    bit = F.call_function("shiftrightunsigned", word, F.pmod(F.xxhash64(value), F.lit(64)).cast("int")).bitwiseAND(F.lit(1).cast("long"))
    return found.select(*quoted(rows.columns), (bit == 1).alias(name))
