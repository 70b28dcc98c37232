"""Near copies of the pipeline: texts whose sets of five-word shingles have a Jaccard similarity of at least 0.8.

The similarity join is exact. All shingles stand in one order, the more common ones last, as a sketch counts them over all texts; two sets that are
similar enough share a shingle among the first fifth of either, so these prefixes are the bucket keys. Sets of n
and m shingles that have c = ceil(4 (n + m) / 9) in common also share the first L of these within both prefixes, where L is
the prefix less the n - c (or m - c) shingles that the other may lack. The shingle sets of both texts decide. The order only saves work: any order finds the same pairs.

First, operator 7 links the SimHashes of the five-word shingles, its buckets, bit planes and forests as they are: of each
of its components all sets are held against one. Two of 64 bits are about Jaccard 0.98, so more follows.

Then every set is held against the one bucket centre that it meets most often, if in half of L buckets, which joins
groups of many copies at linear cost, and in three more rounds against one of the centres, drawn anew in each bucket, that it may be
similar to; buckets whose members are by then in one component are done. At last all pairs follow that are not yet in
one component. Their sets share a shingle among the first n - c + 1 and m - c + 1, and their maps, the parity of the shingles that fall on
each of MAP_BITS bits, differ in n + m - 2 c bits at most: the join itself leaves out all others. Only sets of more than LONG shingles, whose
maps are full, are counted over L buckets instead. Sets are compared in groups: a set travels once for each partner it is
held against as a member, a centre once for each tile of its members. Nothing is capped. A bucket of any size is dealt into tiles. Texts
without words form one group; a text of fewer than five words is one shingle. Equal sets are one node; sets and
texts are told apart by 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pricelens.llm.common import discard, give_back, map_batches, materialize, partitions, text_list
from pricelens.llm.components import connected_components
from pricelens.llm import simhash
from pricelens.llm.sieve import SIEVE_BITS, sieved
from pricelens.llm.simhash import TILE, keep_first, name_components, shingle_hashes

#: Words of a shingle; the least similarity as a fraction.
WORDS, ALIKE, OF = 5, 4, 5
#: Counters of the sketch, one byte each in the end, and those that travel together.
SLOTS, BLOCK = 1 << 22, 1 << 12
#: Rounds in which every set meets one centre, before all remaining pairs are formed: the bucket centre it meets most often, then any likely one.
STARS, DRAWS = 1, 3
#: Bits of a set's map, in columns of 64. Sets of more shingles than LONG fill it: their pairs are counted in the whole prefixes too.
MAP_BITS, LONG = 1024, 2048
MAP = [f"map{k}" for k in range(MAP_BITS // 64)]
#: Members of a centre that one task holds against it, about.
HELD = 64


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """The distinct shingles as sorted hashes."""
    return np.unique(np.array(shingle_hashes(text, words), np.uint64).view(np.int64))


def _print(found: np.ndarray) -> bytes:
    from xxhash import xxh3_128_digest

    return xxh3_128_digest(found.tobytes())


def text_key() -> Column:
    """128 bits of the text, as 32 characters."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return F.concat(*[F.lpad(F.hex(h), 16, "0") for h in (F.xxhash64(text), F.xxhash64(F.lit(5), text))]).alias("text_hash")


def slots(found: np.ndarray) -> np.ndarray:
    """Each shingle's counter."""
    return (found.view(np.uint64) & np.uint64(SLOTS - 1)).astype(np.int64)


def sketch(docs: DataFrame, words: int) -> np.ndarray:
    """How common shingles are: SLOTS counters over all rows, in eighths of a power of two. Counters are shared by chance, which costs work, no pair.

    A fixed sample would know only those in a fixed part of the texts: the buckets of the others would grow with the input.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.uint16)  # more than 65535 in one task count as so many
        for batch in batches:
            at, n = np.unique(slots(np.concatenate([shingles(t, words) for t in text_list(batch)])), return_counts=True)
            total[at] = np.minimum(total[at] + n, 65535)
        for block in np.flatnonzero(total.reshape(-1, BLOCK).any(axis=1)).tolist():
            part = total[block * BLOCK : (block + 1) * BLOCK]
            at = np.flatnonzero(part)
            yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()), "at": [at.astype(np.uint16).tobytes()], "n": [part[at].tobytes()]})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, at, n in zip(*[batch.column(c).to_pylist() for c in ("block", "at", "n")], strict=True):
                totals.setdefault(block, np.zeros(BLOCK, np.int64))[np.frombuffer(at, np.uint16)] += np.frombuffer(n, np.uint16)
        for block, total in totals.items():
            level = np.where(total > 0, np.rint(8 * np.log2(np.maximum(total, 1))) + 1, 0).astype(np.uint8)
            yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()), "level": [level.tobytes()]})

    parts = map_batches(docs.select("text"), count, "block int, at binary, n binary", rows=512)
    levels = np.zeros(SLOTS, np.uint8)
    for block, level in map_batches(parts.repartition(partitions(docs.sparkSession), "block"), add, "block int, level binary").collect():
        levels[block * BLOCK : (block + 1) * BLOCK] = np.frombuffer(level, np.uint8)
    return levels


def prefix(found: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """The first shingles in the common order, of which two similar sets share one."""
    keep = len(found) - -(-ALIKE * len(found) // OF) + 1 if len(found) else 0
    return found[np.lexsort((found, levels[slots(found)]))[:keep]]


def map_of(found: np.ndarray) -> np.ndarray:
    """The set as MAP_BITS bits, in words: whether an odd number of its shingles falls on the bit. Maps of two sets differ in no more bits than the sets in shingles."""
    odd = np.bincount((found.view(np.uint64) >> np.uint64(32)).astype(np.int64) % MAP_BITS, minlength=MAP_BITS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def prints_of(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, text_hash, fp (hash of the shingle set), sim (SimHash), n (the set's size), prefix and MAP of every row."""
    levels = sketch(docs, words)
    give_back()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = [shingle_hashes(t, words) for t in text_list(batch)]
            sets = [np.unique(np.array(h, np.uint64).view(np.int64)) for h in hashes]
            maps = np.array([map_of(s) for s in sets], np.int64).reshape(-1, len(MAP))
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "text_hash": batch.column("text_hash"), "fp": pa.array(list(map(_print, sets)), pa.binary()),
                "sim": pa.array(np.array([simhash.majority(h) for h in hashes], np.uint64).view(np.int64)), "n": pa.array(list(map(len, sets)), pa.int32()), "prefix": pa.array([prefix(s, levels) for s in sets], pa.list_(pa.int64())),
                **{name: pa.array(np.ascontiguousarray(maps[:, k])) for k, name in enumerate(MAP)},
            })

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text", text_key()), run, "doc_id long, text_hash string, fp binary, sim long, n int, prefix array<long>, " + ", ".join(f"{name} long" for name in MAP), rows=512)


def _up(a: Column, b: int) -> Column:
    return F.floor((a + (b - 1)) / F.lit(b))


def _common(n: Column, m: Column) -> Column:
    """Shingles that similar sets of n and m have in common at least."""
    return _up(ALIKE * (n + m), ALIKE + OF)


def _least_met(n: Column, m: Column) -> Column:
    """Buckets in which similar sets of n and m shingles meet at least; null where sizes rule them out."""
    spare = lambda k: _common(n, m) - _up(ALIKE * k, OF) + 1  # noqa: E731  the prefix, k - ceil(0.8 k) + 1, less k - common
    return F.when(OF * F.least(n, m) >= ALIKE * F.greatest(n, m), F.greatest(F.least(spare(n), spare(m)), F.lit(1)))


def sets_of(wanted: DataFrame, prints: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """fp and shingles of the prints ``wanted`` (fp); only their texts are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t, words) for t in text_list(batch)]
            yield pa.RecordBatch.from_pydict({"fp": pa.array(list(map(_print, sets)), pa.binary()), "held": pa.array(sets, pa.list_(pa.int64()))})

    held = sieved(prints.select("fp", "text_hash"), "fp", wanted).filter("maybe").join(wanted, "fp", "left_semi")
    texts = materialize(held.groupBy("fp").agg(F.min("text_hash").alias("text_hash")), "near-texts")
    near = sieved(docs.select("text", text_key()), "text_hash", texts).filter("maybe")
    read = near.join(texts.select("text_hash"), "text_hash", "left_semi").dropDuplicates(["text_hash"]).select("text")
    sets = materialize(map_batches(read, run, "fp binary, held array<long>", rows=512), "near-sets")
    discard(texts)
    return sets


def similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (member, centre) whose sets are similar enough, as (a, b).

    A group is a centre and up to about HELD of its members, the centre first; a task holds one centre's set.
    """
    tiles = pairs.groupBy("centre").agg(F.ceil(F.count("*") / HELD).cast("int").alias("tiles"))
    dealt = pairs.join(tiles, "centre").withColumn("tile", F.pmod(F.xxhash64("member"), "tiles").cast("int"))
    members = dealt.join(sets.withColumnRenamed("fp", "member"), "member").select("centre", "tile", F.lit(1).alias("place"), "member", "held")
    centres = tiles.join(sets.withColumnRenamed("fp", "centre"), "centre").select("centre", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"), F.lit(0).alias("place"), F.col("centre").alias("member"), "held")
    group = ["centre", "tile"]
    ordered = centres.unionByName(members).repartition(partitions(pairs.sparkSession), *group).sortWithinPartitions(*group, "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        middle, name = np.zeros(0, np.int64), None
        for batch in batches:
            held, found = batch.column("held"), []
            for k, (place, member) in enumerate(zip(batch.column("place").to_pylist(), batch.column("member").to_pylist(), strict=True)):
                own = held[k].values.to_numpy()
                if place == 0:
                    middle, name = own, member
                    continue
                shared = len(np.intersect1d(own, middle, assume_unique=True))
                if (ALIKE + OF) * shared >= ALIKE * (len(own) + len(middle)):
                    found.append((name, member))
            a, b = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    return map_batches(ordered.select("place", "member", "held"), run, "a binary, b binary")


def buckets_of(prints: DataFrame, nodes: DataFrame) -> DataFrame:
    """h, fp, n, at (the shingle's place in the common order of its set), label (at first the print itself): the prefixes of different sets that share a shingle."""
    doubled = nodes.filter("rows > 1").select("fp")
    marked = sieved(prints.select("fp", "n", "prefix"), "fp", doubled)
    again = marked.filter("maybe").drop("maybe")
    each = marked.filter("not maybe").drop("maybe").unionByName(again.join(doubled, "fp", "left_anti")).unionByName(again.join(doubled, "fp", "left_semi").dropDuplicates(["fp"]))
    shared = materialize(each.select(F.explode("prefix").alias("h")).groupBy("h").agg(F.count("*").alias("rows")).filter("rows > 1").select("h"), "near-shared")
    keyed = sieved(each.select("fp", "n", F.posexplode("prefix").alias("at", "h")), "h", shared, SIEVE_BITS).filter("maybe")
    bucket = materialize(keyed.join(shared, "h", "left_semi").select("h", "fp", "n", "at", F.col("fp").alias("label")), "near-buckets")
    discard(shared)
    return bucket


def alike_by_simhash(nodes: DataFrame) -> DataFrame:
    """(member, centre): every set (fp, sim) with the least set of its component by operator 7, if that is another one."""
    component = connected_components(simhash.links(nodes.select(F.col("sim").alias("fp")).distinct()))
    named = nodes.join(component.withColumnRenamed("node", "sim"), "sim", "left").select("fp", F.coalesce("component", "sim").alias("group"))
    centres = named.groupBy("group").agg(F.min("fp").alias("centre"), F.count("*").alias("sets")).filter("sets > 1").select("group", "centre")
    pairs = materialize(named.join(centres, "group").filter(F.col("fp") != F.col("centre")).select(F.col("fp").alias("member"), "centre"), "near-pairs")
    discard(component)
    return pairs


def links(docs: DataFrame, prints: DataFrame, nodes: DataFrame, bucket: DataFrame, words: int) -> DataFrame:
    """(a, b): similar pairs whose components are those of all similar pairs. ``bucket``, what ``buckets_of`` wrote, is deleted on the way."""
    edges = docs.sparkSession.createDataFrame([], "a binary, b binary")

    def verified(pairs: DataFrame) -> DataFrame | None:
        if pairs.isEmpty():
            discard(pairs)
            return None
        sets = sets_of(pairs.select(F.explode(F.array("member", "centre")).alias("fp")).distinct(), prints, docs, words)
        found = materialize(edges.unionByName(similar(pairs, sets)), "near-edges")
        discard(pairs, sets, edges)
        return found

    for star in range(-1, STARS + DRAWS):
        pairs = alike_by_simhash(nodes) if star < 0 else materialize(most_met(bucket, star) if star < STARS else drawn(bucket, nodes, star), "near-pairs")
        found = verified(pairs)
        if found is not None:
            edges = found
            bucket = undecided(bucket, edges)
    met = meetings(bucket, nodes)
    often = met.groupBy("centre", "member").agg(F.count("*").alias("times"), F.min("least").alias("least")).filter("times >= least")
    pairs = materialize(often.select("centre", "member"), "near-pairs")
    discard(bucket)
    found = verified(pairs)
    return edges if found is None else found


def centres_of(bucket: DataFrame, turn: Column) -> DataFrame:
    """The set of each bucket whose turn is first."""
    first = F.min(F.struct(turn.alias("turn"), "fp", "n", "at", "label")).alias("c")
    return bucket.groupBy("h").agg(first).select("h", "c.*")


def most_met(bucket: DataFrame, star: int) -> DataFrame:
    """(member, centre): every set with the bucket centre that it meets most often, if in half of ``least`` buckets; one order of the centres for all buckets."""
    met = bucket.alias("x").join(centres_of(bucket, F.xxhash64("fp", F.lit(star))).alias("y"), "h").filter(F.col("x.label") != F.col("y.label"))
    often = met.groupBy(F.col("x.fp").alias("member"), F.col("y.fp").alias("centre")).agg(F.count("*").alias("times"), F.min(_least_met(F.col("x.n"), F.col("y.n"))).alias("least")).filter("2 * times >= least")
    return often.groupBy("member").agg(F.max(F.struct("times", "centre")).alias("best")).select("member", F.col("best.centre").alias("centre"))


def drawn(bucket: DataFrame, nodes: DataFrame, star: int) -> DataFrame:
    """(member, centre): every set with one of those bucket centres that sizes, places and maps allow; another order of the centres in each bucket."""
    x, y = bucket.alias("x"), centres_of(bucket, F.xxhash64("fp", "h", F.lit(star))).alias("y")
    met = x.join(y, "h").filter((F.col("x.label") != F.col("y.label")) & _within(F.lit(1)))
    met = met.select(F.col("x.fp").alias("member"), F.col("x.n").alias("n"), F.col("y.fp").alias("centre"), F.col("y.n").alias("m")).distinct()
    own = nodes.select("fp", *MAP)
    x, y = met.join(own.withColumnRenamed("fp", "member"), "member").alias("x"), own.withColumnRenamed("fp", "centre").alias("y")
    likely = x.join(y, "centre").filter(_apart() <= F.col("n") + F.col("m") - 2 * _common(F.col("n"), F.col("m")))
    best = F.min(F.struct(F.xxhash64("centre", F.lit(star)).alias("turn"), "centre")).alias("best")
    return likely.groupBy("member").agg(best).select("member", F.col("best.centre").alias("centre"))


def _within(least: Column) -> Column:
    """Sizes of x and y that similar sets may have, and a shingle among those of which they share ``least``."""
    n, m = F.col("x.n"), F.col("y.n")
    common = _common(n, m)
    return (OF * F.least(n, m) >= ALIKE * F.greatest(n, m)) & (F.col("x.at") < n - common + least) & (F.col("y.at") < m - common + least)


def _apart() -> Column:
    """Bits in which the maps of x and y differ."""
    return reduce(add, [F.bit_count(F.col(f"x.{name}").bitwiseXOR(F.col(f"y.{name}"))) for name in MAP])


def meetings(bucket: DataFrame, nodes: DataFrame) -> DataFrame:
    """(centre, member, least): pairs of sets of different label, once for each bucket where they meet; similar ones meet in ``least`` or more.

    Sets with c shingles in common share one among the first n - c + 1 and m - c + 1. Pairs whose maps differ in more bits
    than similar sets can differ in shingles, n + m - 2 c, are no rows of the join, so groups of texts that share
    passages do not make rows with the square of their size.
    """
    tiles = F.ceil(F.col("rows") / TILE).cast("int")
    rows = bucket.groupBy("h").agg(F.count("*").alias("rows"))
    dealt = bucket.join(rows, "h").join(nodes.select("fp", *MAP), "fp").withColumn("tile", F.pmod(F.xxhash64("fp", "h"), tiles).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), tiles - 1))).drop("rows")
    x, y = dealt.alias("x"), dealt.alias("y")
    n, m = F.col("x.n"), F.col("y.n")
    least = F.when(F.greatest(n, m) > LONG, _least_met(n, m)).otherwise(F.lit(1))
    same = (F.col("x.h") == F.col("y.h")) & (F.col("x.tile") == F.col("y.other")) & (F.col("x.other") == F.col("y.tile"))
    met = x.join(y, same & (F.col("x.fp") < F.col("y.fp")) & (F.col("x.label") != F.col("y.label")) & _within(least) & (_apart() <= n + m - 2 * _common(n, m)))
    return met.select(F.col("x.fp").alias("centre"), F.col("y.fp").alias("member"), least.alias("least"))


def undecided(bucket: DataFrame, edges: DataFrame) -> DataFrame:
    """``bucket`` under the components of ``edges``: those whose members are not yet in one."""
    component = connected_components(edges).withColumnRenamed("node", "fp")
    labelled = materialize(bucket.drop("label").join(component, "fp", "left").select("h", "fp", "n", "at", F.coalesce("component", "fp").alias("label")), "near-labelled")
    mixed = labelled.groupBy("h").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("h")
    left = materialize(labelled.join(mixed, "h", "left_semi"), "near-buckets")
    discard(bucket, labelled, component)
    return left


def drop_similar(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """The rows of ``docs``, all columns, with the smallest doc_id of their component; rows without an id come after those with one."""
    give_back()  # what training has left in the driver
    whole = materialize(prints_of(docs, words), "near-prints")
    nodes = materialize(whole.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows"), F.min("sim").alias("sim"), *[F.min(name).alias(name) for name in MAP]), "near-nodes")
    bucket = buckets_of(whole, nodes)
    prints = materialize(whole.select("doc_id", "fp", "text_hash"), "near-rows")
    discard(whole)
    edges = links(docs, prints, nodes, bucket, words)
    found = name_components(nodes.select("fp", "least"), edges)
    discard(nodes, edges)
    left = keep_first(docs, prints, found, text_key())
    discard(prints, found)
    return left
