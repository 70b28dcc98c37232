"""Operator 7: SimHash near-duplicates by bit-sliced comparison.

A fingerprint holds the majority of each bit over the XXH64 of a text's word shingles. Distinct fingerprints
meet in buckets: if at most two of 64 bits differ, at least two of the four 16-bit quarters are equal, so the
six pairs of quarters are the bucket keys. A bucket of any size is dealt into tiles, and each pair of tiles is
one group. Inside a group the fingerprints are stored as bit planes, 64 lanes to a word: the difference
planes of one fingerprint against 64 others are added by carry-save counters that start so high that a
distance above the radius overflows; a block whose lanes have all overflowed is abandoned. Each group
passes on a spanning forest of its links, which loses no connection, and components join them.

Null and empty texts, and texts of white space, have fingerprint zero and are linked like any other. Rows
that share a doc_id each get a row. A component whose documents all lack an id has a null component_id.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pricelens.llm.common import discard, keep_only, map_batches, materialize, partitions, text_list
from pricelens.llm.components import connected_components

RADIUS = 2
QUARTERS = list(combinations(range(4), 2))
#: Fingerprints in one tile, about.
TILE = 1024
#: Pairs of one fingerprint and one block of 64 that are compared together.
PAIRS = 1 << 17
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)
_ONE = np.uint64(1)
# planes from all quarters in turn: those that make up the bucket key are equal anyway
_ORDER = [q * 16 + b for b in range(16) for q in range(4)]
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shingle_hashes(text: str, words: int, seed: int = 42) -> list[int]:
    """XXH64 of each run of ``words`` words, in order; of all words where there are fewer."""
    from xxhash import xxh64_intdigest

    found = text.encode("utf-8").translate(_LOWER).split()  # bytes.split: \x20 and \x09-\x0D
    if not found:
        return []
    joined = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = min(words, len(found)) - 1
    return [xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts.tolist(), ends[last:].tolist())]


def fingerprint(text: str, words: int = 3, seed: int = 42) -> int:
    """Majority bits of the shingle hashes; 0 without words."""
    return majority(shingle_hashes(text, words, seed))


def majority(hashes: list[int]) -> int:
    """The bits that are set in over half of the hashes; 0 without any."""
    if not hashes:
        return 0
    bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    majority = 2 * bits.sum(axis=0, dtype=np.int64) > len(hashes)
    return int(np.packbits(majority, bitorder="little").view("<u8")[0])


def bit_planes(values: np.ndarray) -> np.ndarray:
    """[64, blocks] words: bit l of word (b, k) is bit b of value 64 k + l."""
    blocks = -(-len(values) // 64)
    padded = np.zeros(blocks * 64, "<u8")
    padded[: len(values)] = values
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8")


def near_pairs(values: np.ndarray, ends: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs i < j < ends[i] whose values differ in at most ``radius`` bits."""
    planes = bit_planes(values)
    rows = np.flatnonzero(ends > np.arange(len(values)) + 1)
    low, high = (rows + 1) // 64, (ends[rows] - 1) // 64
    width = max(1, radius.bit_length())
    start = (1 << width) - 1 - radius
    per_row = high - low + 1
    before = np.concatenate([[0], np.cumsum(per_row)])
    for first in range(0, int(before[-1]), PAIRS):
        at = np.arange(first, min(first + PAIRS, int(before[-1])))
        which = np.searchsorted(before, at, side="right") - 1
        i, block = rows[which], low[which] + at - before[which]
        # lanes outside i + 1 .. ends[i] - 1 count as far
        head = np.clip(i + 1 - block * 64, 0, 64).astype(np.uint64)
        tail = np.clip(ends[i] - block * 64, 0, 64).astype(np.uint64)
        over = ~(_mask_below(tail) & ~_mask_below(head))
        counters = [np.full(len(at), _FULL if start >> w & 1 else 0, np.uint64) for w in range(width)]
        query = values[i]
        for step, b in enumerate(_ORDER):
            carry = planes[b][block] ^ (np.uint64(0) - (query >> np.uint64(b) & _ONE))
            for c in counters:
                carry_out = c & carry
                c ^= carry
                carry = carry_out
            over |= carry
            if step % 8 == 7:
                alive = over != _FULL
                if not alive.all():
                    i, block, query, over = i[alive], block[alive], query[alive], over[alive]
                    counters = [c[alive] for c in counters]
                    if not len(i):
                        break
        if len(i):
            lanes = np.unpackbits((~over).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            pair, lane = np.nonzero(lanes)
            yield i[pair], block[pair] * 64 + lane


def _mask_below(n: np.ndarray) -> np.ndarray:
    """Words whose lowest n bits are set."""
    return np.where(n >= 64, _FULL, (_ONE << np.minimum(n, np.uint64(63))) - _ONE)


def forest(values: np.ndarray, ends: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Values and the first value of their component, for those that are linked to an earlier one."""
    label = np.arange(len(values))
    for i, j in near_pairs(values, ends, radius):
        while True:
            a, b = label[i], label[j]
            if (a == b).all():
                break
            least = np.minimum(a, b)
            np.minimum.at(label, a, least)
            np.minimum.at(label, b, least)
            while not (label == label[label]).all():
                label = label[label]
    linked = np.flatnonzero(label != np.arange(len(values)))
    return values[linked], values[label[linked]]


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, fp (the fingerprint's 64 bits as a long) and text_hash of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, words) for t in text_list(batch)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "fp": pa.array(found), "text_hash": batch.column("text_hash")})

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text", text_hash()), run, "doc_id long, fp long, text_hash long")


def text_hash() -> Column:
    return F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("text_hash")


def links(nodes: DataFrame) -> DataFrame:
    """(a, b): a spanning set of the links between the distinct fingerprints ``fp``."""
    quarter = [F.shiftrightunsigned("fp", 16 * q).bitwiseAND(0xFFFF) for q in range(4)]
    keys = [F.struct(F.lit(n).alias("pair"), (F.shiftleft(quarter[p], 16) + quarter[q]).alias("bits")) for n, (p, q) in enumerate(QUARTERS)]
    keyed = nodes.select("fp", F.explode(F.array(*keys)).alias("key")).select("fp", "key.pair", "key.bits")
    sizes = keyed.groupBy("pair", "bits").agg(F.count("*").alias("rows")).filter("rows > 1")
    tiles = F.ceil(F.col("rows") / TILE).cast("int")
    dealt = keyed.join(sizes, ["pair", "bits"]).withColumn("tile", F.pmod(F.xxhash64("fp", "pair"), tiles).cast("int"))
    dealt = dealt.select("fp", "pair", "bits", "tile", F.explode(F.sequence(F.lit(0), tiles - 1)).alias("other"))
    dealt = dealt.select("fp", "pair", "bits", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"))
    group = ["pair", "bits", "low", "high"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for values, ends in _whole_groups(batches, group):
            a, b = forest(values, ends)
            yield pa.RecordBatch.from_pydict({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})

    ordered = dealt.repartition(partitions(nodes.sparkSession), *group).sortWithinPartitions(*group)
    return map_batches(ordered.select("fp", *group), run, "a long, b long", rows=20_000)


def _whole_groups(batches: Iterator[pa.RecordBatch], group: list[str], enough: int = 20_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Fingerprints of complete groups, with each row's end of group; a group that batches cut is put together."""
    held: list[np.ndarray] = []

    def cut(rows: np.ndarray, last: bool):
        change = np.flatnonzero((rows[1:, 1:] != rows[:-1, 1:]).any(axis=1)) + 1
        stop = len(rows) if last else int(change[-1]) if len(change) else 0
        bounds = np.append(change[change < stop], stop)
        done = rows[:stop, 0].astype(np.int64).view(np.uint64)
        return done, bounds[np.searchsorted(bounds, np.arange(stop), side="right")], rows[stop:]

    for batch in batches:
        held.append(np.column_stack([batch.column(c).to_numpy().astype(np.int64) for c in ("fp", *group)]))
        if sum(map(len, held)) >= enough:
            values, ends, rest = cut(np.concatenate(held), False)
            held = [rest]
            if len(values):
                yield values, ends
    if held and sum(map(len, held)):
        values, ends, _ = cut(np.concatenate(held), True)
        yield values, ends


def components(docs: DataFrame, words: int = 3) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, fp, text_hash), and for each fingerprint its component (a fingerprint) and component_id."""
    prints = materialize(fingerprints(docs, words), "simhash")
    nodes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    return prints, name_components(nodes, links(nodes))


def name_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(fp, component, component_id) of the nodes (fp, least)."""
    component = connected_components(edges)
    named = nodes.join(component.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    found = materialize(named.join(smallest, "component").select("fp", "component", "component_id"), "simhash-components")
    discard(component)
    return found


def near_duplicates(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, fingerprint, component_id of every row; component_id is the smallest doc_id reachable over links."""
    prints, found = components(docs, words)
    # one row per fingerprint on the right; a hot fingerprint on the left is split by the adaptive skew join
    return prints.join(found, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, words: int = 3) -> DataFrame:
    """The rows of ``docs``, all columns, with the smallest doc_id of their component; rows without an id come after those with one."""
    return keep_first(docs, *components(docs, words))


def keep_first(docs: DataFrame, prints: DataFrame, found: DataFrame, key: Column | None = None) -> DataFrame:
    """The first row of every component, from ``prints`` (doc_id, fp, text_hash of every row) and ``found`` (fp, component). ``key`` makes the text_hash."""
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    per_print = materialize(prints.groupBy("fp").agg(F.min(order).alias("first")), "simhash-firsts")
    firsts = per_print.join(found, "fp").groupBy("component").agg(F.min("first").alias("first"))
    chosen = materialize(found.join(firsts, "component").select("fp", F.col("first.doc_id").alias("first_id"), F.col("first.text_hash").alias("first_hash")), "simhash-chosen")
    verdicts = prints.join(chosen, "fp").select("doc_id", F.col("text_hash").alias("key"), (F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("text_hash") == F.col("first_hash"))).alias("kept"))
    left = keep_only(docs, text_hash() if key is None else key, verdicts)
    discard(per_print, chosen)
    return left
