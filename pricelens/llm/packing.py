"""Operator 2: packing documents into fixed windows by non-negative least squares.

Every full window of a long document is a sequence of its own; what is left of each document, at most one
piece shorter than the window, goes into a histogram of lengths in steps of ``UNIT`` ids. All combinations
of at most ``DEPTH`` lengths that fill the window are enumerated, and repeat counts x >= 0 are solved so
that A x comes near the histogram (A: how often a combination uses a length). Rounded counts say how many
documents of each length go where. Documents that no rounded combination takes are packed greedily: laid
end to end and cut at window borders; the very last, incomplete window is divided into sequences of a
power of two, which need no padding.

The plan has the size of the histogram, never that of the data; the documents are ranked within their length
by salted windows and find their place by rank. A null or empty text is its end id alone. Rows that share a
doc_id, or have none, are separate documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from pricelens.llm.common import map_batches, materialize, partitions, text_list
from pricelens.llm.hf_ids import tokenizer_of

UNIT = 8
DEPTH = 3
#: Solver steps at most, and the gain (in squared documents) at which it stops.
MAX_STEPS, LEAST_GAIN = 6_000, 0.5


def combinations(total: int, depth: int) -> np.ndarray:
    """Non-increasing tuples of at most ``depth`` positive lengths that sum to ``total``, zero-filled."""
    found = np.array([[total]])
    table = [np.pad(found, ((0, 0), (0, depth - 1)))]
    for d in range(2, depth + 1):
        longer = []
        for head in range(-(-total // d), total - d + 2):
            rest = combinations(total - head, d - 1)
            rest = rest[(rest[:, d - 2] > 0) & (rest[:, 0] <= head)]
            longer.append(np.column_stack([np.full(len(rest), head), rest]))
        table.append(np.pad(np.concatenate(longer), ((0, 0), (0, depth - d))) if longer else np.zeros((0, depth), int))
    return np.concatenate(table)


def solve_counts(histogram: np.ndarray, combos: np.ndarray) -> np.ndarray:
    """min ||A x - histogram||, x >= 0, by steepest coordinate descent: each step moves the count with the greatest gain."""
    rest = histogram.astype(float).copy()
    rest[0] = 0.0
    norm = np.zeros(len(combos))
    for i in range(combos.shape[1]):
        used = combos[:, i] > 0
        norm += used * (combos == combos[:, [i]]).sum(axis=1)
    x = np.zeros(len(combos))
    least = max(LEAST_GAIN, 1e-9 * float((rest**2).sum()))
    for _ in range(MAX_STEPS):
        pull = rest[combos].sum(axis=1)
        step = np.maximum(pull / norm, -x)
        gain = step * (2 * pull - step * norm)
        k = int(gain.argmax())
        if gain[k] < least:
            break
        x[k] += step[k]
        np.subtract.at(rest, combos[k], step[k])
        rest[0] = 0.0
    return x


@dataclass(frozen=True)
class Plan:
    """Slots by length: documents ranked first .. first + count - 1 of ``bin`` go to sequences from ``base`` on, ``times`` in each."""

    bin: np.ndarray
    first: np.ndarray
    count: np.ndarray
    base: np.ndarray
    times: np.ndarray
    sequences: int
    used: np.ndarray


def make_plan(histogram: np.ndarray, depth: int = DEPTH) -> Plan:
    """``histogram[b]``: documents of b units; its last bin is the window."""
    combos = combinations(len(histogram) - 1, depth)
    combos = combos[(histogram[combos] > 0).all(axis=1, where=combos > 0)]
    x = solve_counts(histogram, combos) if len(combos) else np.zeros(0)
    left, used, base, rows = histogram.copy(), np.zeros_like(histogram), 0, []
    for k in np.argsort(-x, kind="stable"):
        bins, times = np.unique(combos[k][combos[k] > 0], return_counts=True)
        n = int(min(round(x[k]), (left[bins] // times).min()))
        if n <= 0:
            continue
        for b, t in zip(bins.tolist(), times.tolist(), strict=True):
            rows.append((b, int(used[b]), n * t, base, t))
            used[b] += n * t
            left[b] -= n * t
        base += n
    columns = np.array(sorted(rows), np.int64).reshape(-1, 5).T
    return Plan(*columns, base, used)


def _tail_bounds(total: int, window: int) -> list[int]:
    """Borders after the full windows: what is left, as sequences of a power of two, the largest first."""
    at = total // window * window
    bounds = [at]
    while at < total:
        at += 1 << ((total - at).bit_length() - 1)
        bounds.append(at)
    return bounds


def tokenize(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """row (unique), doc_id, n (ids with the end id), ids (little-endian 16 or 32 bits), width."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = tokenizer_of(path)
        width = 2 if max(tokenizer.vocab_size, end_id + 1) <= 1 << 16 else 4
        end = np.array([end_id], f"<u{width}").tobytes()
        for batch in batches:
            ids = [i.astype(f"<u{width}").tobytes() + end for i in tokenizer.encode(text_list(batch))]
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "n": pa.array([len(i) // width for i in ids], pa.int64()),
                "ids": pa.array(ids, pa.binary()), "width": pa.array([width] * len(ids), pa.int32()),
            })

    tokens = map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, n long, ids binary, width int")
    return materialize(tokens.withColumn("row", F.monotonically_increasing_id()), "packing-ids")


def _running(df: DataFrame, column: str, name: str, order: str = "row") -> DataFrame:
    """Sum of ``column`` over all rows before each row, by salts: no window holds more than one salt's rows."""
    n = partitions(df.sparkSession)
    salted = df.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(n)))
    inner = Window.partitionBy("salt").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    totals = salted.groupBy("salt").agg(F.sum(column).alias("total"))
    before = totals.withColumn("base", F.coalesce(F.sum("total").over(Window.orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("salt", "base")
    # one row per salt
    return salted.join(F.broadcast(before), "salt").withColumn(name, F.col("base") + F.coalesce(F.sum(column).over(inner), F.lit(0))).drop("salt", "base")


def place_rests(rests: DataFrame, plan: Plan) -> DataFrame:
    """Adds ``sequence`` and ``slot`` by the plan, null where it takes no more documents of that length. rests: row, bin, ..."""
    n = partitions(rests.sparkSession)
    salted = rests.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(n)))
    sizes = salted.groupBy("bin", "salt").agg(F.count("*").alias("rows"))
    before = Window.partitionBy("bin").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("bin", "salt", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("base"))
    ranked = salted.withColumn("within", F.row_number().over(Window.partitionBy("bin", "salt").orderBy("row")) - 1)
    ranked = ranked.join(bases, ["bin", "salt"]).withColumn("rank", F.col("base") + F.col("within")).drop("salt", "base", "within")
    wide = 1 << 40
    keys = plan.bin * wide + plan.first

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank = batch.column("rank").to_numpy()
            key = batch.column("bin").to_numpy() * wide + rank
            at = np.searchsorted(keys, key, side="right") - 1
            safe = np.maximum(at, 0)
            if len(keys):
                inside = (at >= 0) & (plan.bin[safe] == batch.column("bin").to_numpy()) & (rank < plan.first[safe] + plan.count[safe])
                nth = rank - plan.first[safe]
                sequence, slot = plan.base[safe] + nth // plan.times[safe], nth % plan.times[safe]
            else:
                inside, sequence, slot = np.zeros(len(rank), bool), rank, rank
            yield pa.RecordBatch.from_arrays([
                *(batch.column(c) for c in ("row", "start", "length", "bin")),
                pa.array(sequence, pa.int64(), mask=~inside), pa.array(slot, pa.int64(), mask=~inside),
            ], names=["row", "start", "length", "bin", "sequence", "slot"])

    return map_batches(ranked.select("row", "start", "length", "bin", "rank"), run, "row long, start long, length long, bin long, sequence long, slot long", rows=10_000)


def pack(docs: DataFrame, path: str, *, end_id: int, window: int = 4096, unit: int = UNIT, depth: int = DEPTH) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    if window % unit:
        raise ValueError("the window must be a multiple of the unit")
    tokens = tokenize(docs, path, end_id)
    lengths = tokens.select("row", "n")

    full = lengths.withColumn("windows", F.floor(F.col("n") / window)).filter("windows > 0")
    full = _running(full, "windows", "before").select("row", "before", F.explode(F.sequence(F.lit(0), F.col("windows") - 1)).alias("k"))
    full = full.select("row", (F.col("k") * window).alias("start"), F.lit(window).cast("long").alias("length"), (F.col("before") + F.col("k")).alias("sequence"), F.lit(0).cast("long").alias("offset"), F.lit(0).alias("kind"))

    rests = lengths.withColumn("length", F.col("n") % window).filter("length > 0").select("row", (F.col("n") - F.col("length")).alias("start"), "length", F.ceil(F.col("length") / unit).cast("long").alias("bin"))
    counted = {r["length"]: r["rows"] for r in rests.groupBy("length").agg(F.count("*").alias("rows")).collect()}  # a row per length below the window
    histogram = np.zeros(window // unit + 1, np.int64)
    for length, rows in counted.items():
        histogram[-(-length // unit)] += rows
    plan = make_plan(histogram, depth)
    placed = materialize(place_rests(rests, plan), "packing-places")

    inner = Window.partitionBy("sequence").orderBy(F.desc("bin"), "slot").rowsBetween(Window.unboundedPreceding, -1)  # at most ``depth`` rows
    combined = placed.filter("sequence is not null").select("row", "start", "length", "sequence", F.coalesce(F.sum("length").over(inner), F.lit(0)).alias("offset"), F.lit(1).alias("kind"))

    loose = placed.filter("sequence is null").select("row", "start", "length")
    total = loose.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    bounds = np.array(_tail_bounds(total, window), np.int64)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row, start, length, at in zip(*(batch.column(c).to_pylist() for c in ("row", "start", "length", "at")), strict=True):
                while length:
                    if at < bounds[0]:
                        number, low, high = at // window, at // window * window, (at // window + 1) * window
                    else:
                        k = int(np.searchsorted(bounds, at, side="right")) - 1
                        number, low, high = int(bounds[0]) // window + k, int(bounds[k]), int(bounds[k + 1])
                    take = min(length, high - at)
                    out.append((row, start, take, number, at - low, 2))
                    start, length, at = start + take, length - take, at + take
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 6, [*[pa.int64()] * 5, pa.int32()], strict=True)], names=["row", "start", "length", "sequence", "offset", "kind"])

    greedy = map_batches(_running(loose, "length", "at").select("row", "start", "length", "at"), cut, "row long, start long, length long, sequence long, offset long, kind int", rows=10_000)

    # kinds get ids 0, 1, 2 modulo 3: full windows, combinations, greedy rest
    pieces = full.unionByName(combined).unionByName(greedy).select("row", F.struct("start", "length", (F.col("sequence") * 3 + F.col("kind")).alias("sequence_id"), "offset").alias("piece"))
    by_row = pieces.groupBy("row").agg(F.sort_array(F.collect_list("piece")).alias("pieces"))  # the pieces of one document

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, n, width, ids, found in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n", "width", "ids", "pieces")), strict=True):
                data = np.frombuffer(ids, f"<u{width}").astype("<u4")
                for p in found:
                    part = data[p["start"] : p["start"] + p["length"]]
                    out.append((doc_id, p["start"], p["length"], zlib.crc32(part.tobytes()), n, p["sequence_id"], p["offset"]))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)] if out else [pa.array([], pa.int64())] * 7, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    joined = tokens.join(by_row, "row").select("doc_id", "n", "width", "ids", "pieces")
    return map_batches(joined, digest, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
