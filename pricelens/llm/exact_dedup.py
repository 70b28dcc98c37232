"""Operator 4: exact duplicates by exchange of Golomb-coded fingerprints.

1. Each sender (rows dealt by doc_id) sorts the distinct fingerprints of its texts and sends every owner, a
   range of fingerprints, the Golomb-Rice code of their differences, with a bitmap of those it holds more than
   once. A fingerprint is as short as the number of rows allows, so a row costs about two bytes.
2. An owner decodes its messages, finds the fingerprints held more than once and answers each sender
   with a bitmap in the sender's order.
3. Rows without a set bit are unique. Of the suspects alone the normalised texts are shuffled, grouped by
   their bytes (equal texts of one task as one row), and the groups are told to the suspects.

The scan for suspect texts is thinned by a bitmap of fixed size over fingerprints; it only saves shuffling, the
comparison of bytes decides. Hot groups shrink in step 1 to one code per sender, in step 3 to one row per task;
the last join has one row per group on one side and leaves its hot keys to the adaptive skew join.

Null counts as empty; empty texts are equal to each other. Rows may share a doc_id: exactly one row of a
group is kept, among rows with the smallest doc_id any one. Null ids sort last.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pricelens.llm.common import discard, keep_only, map_batches, materialize, partitions
from pricelens.llm.sieve import SIEVE_BITS, sieve_of

#: Bits beyond log2(rows): a unique row becomes a suspect by chance once in 2^12.
SPARE_BITS = 12
#: Rows that one sender or owner handles, about.
ROWS_PER_PART = 1 << 18


def normalized(text: str | Column = "text") -> Column:
    """Null as empty, every run of white space as one space."""
    return F.regexp_replace(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def golomb_encode(values: np.ndarray, shift: int) -> bytes:
    """Rice code of the differences of ascending ``values``: quotients in unary, then ``shift`` low bits each."""
    gaps = np.diff(values, prepend=values.dtype.type(0)).astype(np.uint64)
    quotient = (gaps >> np.uint64(shift)).astype(np.int64)
    unary = np.zeros(int(quotient.sum()) + len(quotient), np.uint8)
    unary[np.cumsum(quotient + 1) - 1] = 1
    low = (gaps[:, None] >> np.arange(shift, dtype=np.uint64) & np.uint64(1)).astype(np.uint8)
    return np.packbits(np.concatenate([unary, low.ravel()])).tobytes()


def golomb_decode(data: bytes, count: int, shift: int) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(data, np.uint8))
    ends = np.flatnonzero(bits)[:count] if count else np.zeros(0, np.int64)
    quotient = np.diff(ends, prepend=-1) - 1
    at = int(ends[-1]) + 1 if count else 0
    low = bits[at : at + count * shift].reshape(count, shift).astype(np.uint64)
    gaps = (quotient.astype(np.uint64) << np.uint64(shift)) + (low << np.arange(shift, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    return np.cumsum(gaps, dtype=np.uint64)


def _rice_shift(span: int, count: int) -> int:
    """Low bits for ``count`` values spread over ``span``."""
    return max(0, (span // max(1, count)).bit_length() - 1)


def mark_suspects(prints: DataFrame, rows: int) -> DataFrame:
    """Rows of ``prints`` (row, fp: 64 bits) with ``suspect``: whether another row may have the same fingerprint."""
    spark = prints.sparkSession
    parts = max(partitions(spark), -(-rows // ROWS_PER_PART))
    bits = min(62, max(1, rows).bit_length() + SPARE_BITS)
    span = -(-(1 << bits) // parts)  # fingerprints of one owner
    dealt = prints.select("row", F.shiftrightunsigned("fp", 64 - bits).alias("short"), F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int").alias("sender"))
    dealt = materialize(dealt.repartition(parts, "sender").sortWithinPartitions("sender", "short"), "dedup-fingerprints")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sender, columns in _by_key(batches, "sender", ("short",)):
            values, counts = np.unique(columns["short"].astype(np.uint64), return_counts=True)
            owner = (values // np.uint64(span)).astype(np.int64)
            bounds = np.flatnonzero(np.diff(owner, prepend=-1, append=-1))
            out = []
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                shift = _rice_shift(span, b - a)
                base = np.uint64(int(owner[a]) * span)
                out.append((int(owner[a]), int(sender), b - a, shift, golomb_encode(values[a:b] - base, shift), np.packbits(counts[a:b] > 1).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["owner", "sender", "n", "shift", "code", "repeated"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for owner, columns in _by_key(batches, "owner", ("sender", "n", "shift", "code", "repeated")):
            lists = [golomb_decode(c, int(n), int(s)) for c, n, s in zip(columns["code"], columns["n"], columns["shift"], strict=True)]
            multiple = [np.unpackbits(np.frombuffer(r, np.uint8))[: len(v)].astype(bool) for r, v in zip(columns["repeated"], lists, strict=True)]
            values, counts = np.unique(np.concatenate(lists), return_counts=True)
            twice = counts > 1
            replies = [np.packbits(twice[np.searchsorted(values, v)] | m).tobytes() for v, m in zip(lists, multiple, strict=True)]
            yield pa.RecordBatch.from_arrays([
                pa.array([owner] * len(lists), pa.int32()), pa.array(columns["sender"], pa.int32()), pa.array(columns["n"], pa.int64()), pa.array(columns["shift"], pa.int32()),
                pa.array(columns["code"], pa.binary()), pa.array(replies, pa.binary()),
            ], names=["owner", "sender", "n", "shift", "code", "bitmap"])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per sender: replies (owner, bitmap), then its rows in order of fingerprint."""
        for sender, columns in _by_key(batches, "sender", ("owner", "n", "shift", "code", "bitmap", "row", "short")):
            is_reply = np.array([c is not None for c in columns["code"]])
            flagged = [np.zeros(0, np.uint64)]
            for k in np.flatnonzero(is_reply):
                values = golomb_decode(columns["code"][k], int(columns["n"][k]), int(columns["shift"][k])) + np.uint64(int(columns["owner"][k]) * span)
                flagged.append(values[np.unpackbits(np.frombuffer(columns["bitmap"][k], np.uint8))[: len(values)].astype(bool)])
            rows_, short = columns["row"][~is_reply].astype(np.int64), columns["short"][~is_reply].astype(np.int64).astype(np.uint64)
            yield pa.RecordBatch.from_pydict({"row": pa.array(rows_), "suspect": pa.array(np.isin(short, np.concatenate(flagged)))})

    messages = map_batches(dealt, send, "owner int, sender int, n long, shift int, code binary, repeated binary", rows=100_000)
    replies = map_batches(messages.repartition(parts, "owner").sortWithinPartitions("owner"), answer, "owner int, sender int, n long, shift int, code binary, bitmap binary", rows=1_000)
    both = replies.unionByName(dealt, allowMissingColumns=True).repartition(parts, "sender").sortWithinPartitions("sender")
    return map_batches(both, apply, "row long, suspect boolean", rows=100_000)


def _by_key(batches: Iterator[pa.RecordBatch], key: str, names: tuple[str, ...]) -> Iterator[tuple[int, dict[str, np.ndarray]]]:
    """Columns of each run of equal ``key``; a sender or an owner has about ROWS_PER_PART rows."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        keys = batch.column(key).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if held and held[0].column(key)[0].as_py() != keys[a]:
                yield _joined(held, key, names)
                held = []
            if b > a:
                held.append(batch.slice(a, b - a))
    if held:
        yield _joined(held, key, names)


def _joined(held: list[pa.RecordBatch], key: str, names: tuple[str, ...]) -> tuple[int, dict[str, np.ndarray]]:
    whole = pa.Table.from_batches(held)
    return whole.column(key)[0].as_py(), {n: whole.column(n).to_numpy(zero_copy_only=False) if pa.types.is_integer(whole.schema.field(n).type) and not whole.column(n).null_count else np.array(whole.column(n).to_pylist(), object) for n in names}


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalized().alias("t")).withColumn("fp", F.xxhash64("t"))
    prints = plain.select("doc_id", "fp", F.sha2("t", 256).alias("text_sha256"))
    prints = materialize(prints.withColumn("row", F.monotonically_increasing_id()), "dedup-rows")
    found = mark_suspects(prints, prints.count())
    marked = materialize(prints.join(found, "row"), "dedup-marked")
    discard(prints, found)
    unique = marked.filter(~F.col("suspect")).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    suspects = marked.filter("suspect").select("row", "doc_id", "text_sha256", "fp")

    slot = F.pmod("fp", F.lit(SIEVE_BITS))
    word = F.col("words")[F.shiftright(slot, 6).bitwiseAND(511).cast("int")]
    passed = plain.withColumn("bucket", F.shiftright(slot, 15)).join(F.broadcast(sieve_of(suspects)), "bucket")
    passed = passed.filter(F.expr("1L") == F.call_function("shiftrightunsigned", word, F.pmod("fp", F.lit(64)).cast("int")).bitwiseAND(F.lit(1).cast("long")))
    verified = passed.groupBy("fp", "t").agg(F.count("*").alias("group_size")).select(F.sha2("t", 256).alias("text_sha256"), "group_size")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("first")
    chosen = suspects.groupBy("text_sha256").agg(first)
    groups = materialize(verified.join(chosen, "text_sha256").select("text_sha256", "group_size", "first.doc_id", "first.row"), "dedup-groups")
    groups = groups.select("text_sha256", "group_size", F.col("doc_id").alias("keep_id"), F.col("row").alias("keep_row"))
    shared = suspects.join(groups, "text_sha256").select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256")
    return unique.unionByName(shared)


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, all columns."""
    verdicts = exact_duplicates(docs).select("doc_id", F.col("text_sha256").alias("key"), "kept")
    left = keep_only(docs, F.sha2(normalized(), 256), verdicts)
    discard(verdicts)
    return left
