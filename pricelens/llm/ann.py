"""Operator 10: approximate nearest neighbours by balanced posting lists.

Centroids come from a balanced k-means over a bounded sample of distinct vectors and are searched through an
in-memory neighbour graph. Every vector goes to the list of its nearest centroid and, where it lies near a
border, to further lists whose centroid is hardly farther.
A query reads every list whose centroid is at most a given ratio farther than its nearest one, however many
these are; the graph answers where they are few, else the query meets all centroids. A list of any size is
dealt into parts and the parts to slots. Queries are dealt into blocks; a query travels to each slot once, with the
numbers of its lists there, and a slot's vectors stream past the block, which keeps the ten best per query only. A
query that finds fewer than k others in its lists, although there are more, reads all lists.

Distances are Euclidean in double precision on the original vectors. Vectors that are null, zero, hold null or
non-finite components, or are not of the most frequent length take no part. Repeated vec_ids count as one
candidate, at their smallest distance; a query never meets its own id. Ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from pricelens.llm.common import map_batches, materialize, partitions

#: Vectors in a list, about; lists at most; vectors of the training sample for each list.
LIST_ROWS, MAX_LISTS, SAMPLE_PER_LIST = 256, 4096, 32
#: Lists a vector may lie in, and how much farther than the nearest a further centroid may be.
REPLICAS, BORDER = 4, 1.3
#: Lists up to which the graph's search decides, and the ratio to its nearest centroid up to which a query reads.
PROBES, REACH = 48, 1.35
#: Rows of a list in one slot and vectors compared at once; queries in one block; list members of one slot, about.
PART_ROWS, BLOCK_ROWS, SLOT_ROWS = 4096, 16_384, 16_384
DEGREE, BEAM, ROUNDS = 16, 24, 12


def _square(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of ``a`` to all rows of ``b``."""
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T), 0)


def balanced_centroids(sample: np.ndarray, lists: int, seed: int = 7) -> np.ndarray:
    """k-means in which a full cluster looks farther away; deterministic for a given sample."""
    rng = np.random.default_rng(seed)
    centroids = sample[np.sort(rng.choice(len(sample), lists, replace=False))].copy()
    penalty = np.zeros(lists)
    fair = len(sample) / lists
    for _ in range(ROUNDS):
        owner = np.concatenate([(_square(sample[a : a + 2048], centroids) + penalty).argmin(axis=1) for a in range(0, len(sample), 2048)])
        size = np.bincount(owner, minlength=lists)
        spread = np.median(((sample - centroids[owner]) ** 2).sum(axis=1))
        penalty += 0.1 * spread * np.clip(size / fair - 1, -1, 1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, owner, sample)
        centroids = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], centroids)
    return centroids


@dataclass
class CentroidGraph:
    """Each centroid's nearest others and a few far ones; searched best-first for a whole batch."""

    centroids: np.ndarray
    edges: np.ndarray
    entries: np.ndarray

    @classmethod
    def build(cls, centroids: np.ndarray, seed: int = 11) -> CentroidGraph:
        n = len(centroids)
        rng = np.random.default_rng(seed)
        near = np.concatenate([np.argsort(_square(centroids[a : a + 1024], centroids), axis=1, kind="stable")[:, 1 : DEGREE + 1] for a in range(0, n, 1024)])
        far = rng.integers(0, n, (n, 4))
        entries = np.unique(rng.integers(0, n, 16))
        return cls(centroids, np.concatenate([near, far], axis=1), entries)

    def search(self, points: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
        """(centroids, squared distances) of up to ``wanted`` near centroids per point, nearest first; -1 where fewer."""
        n, beam = len(points), max(BEAM, wanted)
        ids = np.full((n, beam), -1)
        dist = np.full((n, beam), np.inf)
        done = np.zeros((n, beam), bool)
        seen = np.zeros((n, len(self.centroids)), bool)
        new = np.broadcast_to(self.entries, (n, len(self.entries)))
        rows = np.arange(n)
        while len(rows):
            fresh = ~seen[rows[:, None], new]
            # an id may stand twice in a row of candidates: the first counts
            order = np.argsort(new, axis=1, kind="stable")
            ordered = np.take_along_axis(new, order, 1)
            again = np.zeros(new.shape, bool)
            np.put_along_axis(again, order[:, 1:], ordered[:, 1:] == ordered[:, :-1], 1)
            fresh &= ~again
            seen[rows[:, None], new] = True
            far = ((points[rows][:, None, :] - self.centroids[new]) ** 2).sum(axis=2)
            all_dist = np.concatenate([dist[rows], np.where(fresh, far, np.inf)], axis=1)
            all_ids = np.concatenate([ids[rows], np.where(fresh, new, -1)], axis=1)
            all_done = np.concatenate([done[rows], ~fresh], axis=1)
            top = np.argsort(all_dist, axis=1, kind="stable")[:, :beam]
            dist[rows], ids[rows], done[rows] = (np.take_along_axis(v, top, 1) for v in (all_dist, all_ids, all_done))
            open_ = ~done[rows] & (ids[rows] >= 0)
            has = open_.any(axis=1)
            rows = rows[has]
            pick = open_[has].argmax(axis=1)
            done[rows, pick] = True
            new = self.edges[ids[rows, pick]]
        return ids[:, :wanted], dist[:, :wanted]


def replicas(graph: CentroidGraph, points: np.ndarray) -> list[np.ndarray]:
    """Lists of each vector: its nearest centroid and those hardly farther."""
    ids, dist = graph.search(points, REPLICAS)
    return [row[(row >= 0) & (far <= far[0] * BORDER**2)] for row, far in zip(ids, dist)]


def probes(graph: CentroidGraph, points: np.ndarray) -> list[np.ndarray]:
    """Every list within the ratio, nearest first; no number of lists ends it."""
    ids, dist = graph.search(points, PROBES)
    chosen = [row[(row >= 0) & (far <= far[0] * REACH**2)] for row, far in zip(ids, dist)]
    wide = [n for n, lists in enumerate(chosen) if len(lists) == PROBES < len(graph.centroids)]
    for a in range(0, len(wide), 256):
        far = _square(points[wide[a : a + 256]], graph.centroids)
        order = np.argsort(far, axis=1, kind="stable")
        for n, row, near in zip(wide[a : a + 256], order, np.take_along_axis(far, order, 1)):
            chosen[n] = row[near <= near[0] * REACH**2]
    return chosen


def usable(table: DataFrame, vector: str = "embedding") -> DataFrame:
    """(vec_id, v: array of doubles) of the vectors that take part."""
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).filter("vec_id is not null and v is not null and size(v) > 0")
    rows = rows.filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0))
    sizes = rows.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "n").first()
    return rows.filter(F.size("v") == (sizes["n"] if sizes else 0))


def _matrix(column: pa.ListArray) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def build_graph(vectors: DataFrame, rows: int) -> CentroidGraph:
    """Centroids of a sample of at most MAX_LISTS * SAMPLE_PER_LIST distinct vectors, drawn by their hash."""
    lists = int(min(max(1, rows // LIST_ROWS), MAX_LISTS))
    wanted = lists * SAMPLE_PER_LIST
    place = F.pmod(F.xxhash64("v"), F.lit(1 << 40))
    near = vectors.select("v", place.alias("h"))
    if rows > 4 * wanted:
        # places far beyond the sample are left out before the order; copies share a place
        near = near.filter(F.col("h") < (1 << 40) * 4 * wanted // rows)
    distinct = near.groupBy("h").agg(F.min("v").alias("v"))
    drawn = materialize(distinct, "ann-sample").orderBy("h").limit(wanted).select("v").toArrow()
    if not drawn.num_rows:  # all vectors are copies of a few whose places lie beyond
        drawn = vectors.select("v").limit(1).toArrow()
    sample = _matrix(drawn.column("v").combine_chunks())
    return CentroidGraph.build(balanced_centroids(sample, min(lists, len(sample))))


class Block:
    """Queries that a slot's vectors stream past, and the k nearest others that each has met; an id counts once."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, lists: list[np.ndarray], k: int):
        self.ids, self.points, self.k = ids, points, k
        self.norms = (points * points).sum(axis=1)
        self.dist, self.found = np.full((len(ids), k), np.inf), np.full((len(ids), k), -1, np.int64)
        owner = np.repeat(np.arange(len(ids)), [len(x) for x in lists])
        flat = np.concatenate(lists) if lists else np.zeros(0, np.int64)
        order = np.argsort(flat, kind="stable")
        names, starts = np.unique(flat[order], return_index=True)
        self.readers = dict(zip(names.tolist(), np.split(owner[order], starts[1:])))

    def meet(self, number: int, ids: np.ndarray, vectors: np.ndarray) -> None:
        """Offer the vectors of a list to the queries that read it; products choose, exact distances decide."""
        rows = self.readers.get(number, np.zeros(0, np.int64))
        for a in range(0, len(rows), 256):
            at = rows[a : a + 256]
            near = _square(self.points[at], vectors)
            near[self.ids[at, None] == ids[None, :]] = np.inf
            least = near.min(axis=1)
            scale = 1e-9 * (self.norms[at] + 1)
            bound = self.dist[at, -1] ** 2
            hit = np.isfinite(least) & (least <= bound + scale + 1e-9 * np.where(np.isfinite(bound), bound, 0))
            if not hit.any():
                continue
            at, near, scale = at[hit], near[hit], scale[hit]
            last = min(self.k, len(ids) - 1)
            chosen = np.argpartition(near, last, axis=1)[:, : last + 1]
            edge = np.take_along_axis(near, chosen, 1).max(axis=1)
            limit = np.minimum(edge + scale, np.finfo(float).max)
            # more at the edge than were chosen: ties, which ids settle
            tied = (near <= limit[:, None]).sum(axis=1) > last + 1
            if not tied.all():
                plain = ~tied
                exact = np.sqrt(((vectors[chosen[plain]] - self.points[at[plain], None, :]) ** 2).sum(axis=2))
                exact[~np.isfinite(np.take_along_axis(near, chosen, 1)[plain])] = np.inf
                self._keep(at[plain], exact, ids[chosen[plain]])
            for n in np.flatnonzero(tied):
                close = np.flatnonzero(near[n] <= limit[n])
                exact = np.sqrt(((vectors[close] - self.points[at[n]]) ** 2).sum(axis=1))
                self._keep(at[n : n + 1], exact[None, :], ids[close][None, :])

    def _keep(self, at: np.ndarray, dist: np.ndarray, ids: np.ndarray) -> None:
        dist, ids = np.concatenate([self.dist[at], dist], axis=1), np.concatenate([self.found[at], ids], axis=1)
        order = np.lexsort((ids, dist), axis=1)
        dist, ids = np.take_along_axis(dist, order, 1), np.take_along_axis(ids, order, 1)
        by_id = np.argsort(ids, axis=1, kind="stable")
        same = np.take_along_axis(ids, by_id, 1)
        again = np.zeros(ids.shape, bool)
        np.put_along_axis(again, by_id[:, 1:], same[:, 1:] == same[:, :-1], 1)
        dist = np.where(again, np.inf, dist)
        order = np.argsort(dist, axis=1, kind="stable")[:, : self.k]
        self.dist[at], self.found[at] = np.take_along_axis(dist, order, 1), np.take_along_axis(ids, order, 1)

    def answers(self) -> pa.RecordBatch:
        row, place = np.nonzero(np.isfinite(self.dist))
        return pa.RecordBatch.from_arrays([pa.array(self.ids[row]), pa.array(self.found[row, place]), pa.array(self.dist[row, place])], names=["query_id", "vec_id", "score"])


def nearest(table: DataFrame, *, every: int = 100, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every row whose vec_id is divisible by ``every``."""
    spark = table.sparkSession
    vectors = materialize(usable(table), "ann-vectors")
    rows = vectors.count()
    schema = "query_id long, rank int, vec_id long, score double"
    if not rows:
        return spark.createDataFrame([], schema)
    graph = build_graph(vectors, rows)
    # single precision travels as it came
    kind = "float" if dict(table.dtypes)["embedding"] == "array<float>" else "double"
    value = pa.float32() if kind == "float" else pa.float64()

    def own_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("v")
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), column.cast(pa.list_(value)), pa.array(replicas(graph, _matrix(column)), pa.list_(pa.int64()))], names=["vec_id", "v", "lists"])

    posted = materialize(map_batches(vectors, own_lists, f"vec_id long, v array<{kind}>, lists array<long>", rows=2_000), "ann-postings")
    # a row per list: at most MAX_LISTS
    sizes = {r["list"]: r["rows"] for r in posted.select(F.explode("lists").alias("list")).groupBy("list").agg(F.count("*").alias("rows")).collect()}
    parts = np.array([max(1, -(-sizes.get(n, 0) // PART_ROWS)) for n in range(len(graph.centroids))])
    slots = max(1, min(partitions(spark), int(parts.sum()), -(-sum(sizes.values()) // SLOT_ROWS)))
    asked = vectors.filter(F.col("vec_id") % every == 0).select("vec_id", "v")
    blocks = max(1, -(-asked.count() // BLOCK_ROWS))
    part = F.pmod(F.xxhash64("vec_id"), F.element_at(F.lit(parts.tolist()), F.col("list").cast("int") + 1)).cast("long")
    members = posted.select("vec_id", "v", F.explode("lists").alias("list")).select(
        F.pmod(F.col("list") + part, F.lit(slots)).alias("slot"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"),
        "list", "vec_id", "v", F.array().cast("array<long>").alias("lists"),
    )

    def asking(everything: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        """Each query once for every slot that holds a part of a list it reads, with these lists."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                points = _matrix(batch.column("v"))
                read = [np.arange(len(parts))] * len(points) if everything else probes(graph, points)
                slot, which, lists = [], [], []
                for n, numbers in enumerate(read):
                    spread = np.minimum(parts[numbers], slots)
                    own = np.repeat(numbers, spread)
                    to = (own + np.arange(len(own)) - np.repeat(np.cumsum(spread) - spread, spread)) % slots
                    order = np.argsort(to, kind="stable")
                    names, starts = np.unique(to[order], return_index=True)
                    slot.append(names)
                    which.append(np.full(len(names), n))
                    lists += np.split(own[order], starts[1:])
                which = pa.array(np.concatenate(which))
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate(slot), pa.int64()), batch.column("vec_id").take(which), batch.column("v").cast(pa.list_(value)).take(which), pa.array(lists, pa.list_(pa.int64())),
                ], names=["slot", "vec_id", "v", "lists"])

        return run

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, last, held = None, None, []
        for slot, run in _runs(batches):
            if slot != last:
                if block is not None:
                    yield block.answers()
                block, last, held = None, slot, []
            number = run.column("list")[0].as_py()
            if number < 0:
                held.append(run)
                continue
            if block is None and held:
                queries = pa.Table.from_batches(held).combine_chunks()
                lists = [x.to_numpy(zero_copy_only=False) for x in (v.values for v in queries.column("lists"))]
                block = Block(queries.column("vec_id").to_numpy(), _matrix(queries.column("v").combine_chunks()), lists, k)
                held = []
            if block is not None:
                block.meet(number, run.column("vec_id").to_numpy(), _matrix(run.column("v")))
        if block is not None:
            yield block.answers()

    def answers(queries: DataFrame, everything: bool) -> DataFrame:
        """What the queries (vec_id, v) find in the lists they read, each id once."""
        sent = map_batches(queries, asking(everything), f"slot long, vec_id long, v array<{kind}>, lists array<long>", rows=500)
        sent = sent.select("slot", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("block"), F.lit(-1).cast("long").alias("list"), "vec_id", "v", "lists")
        both = members.unionByName(sent)
        ordered = both.repartition(partitions(spark), "slot", "block").sortWithinPartitions("slot", "block", "list")
        found = map_batches(ordered, scan, "query_id long, vec_id long, score double", rows=PART_ROWS)
        return found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))

    once = materialize(answers(asked, False), "ann-found")
    # a query on a centroid reads one list, which may hold too few others: such queries read all lists
    wanted = min(k, vectors.select("vec_id").distinct().count() - 1)
    enough = once.groupBy(F.col("query_id").alias("vec_id")).agg(F.count("*").alias("n")).filter(F.col("n") >= wanted)
    short = materialize(asked.join(enough, "vec_id", "left_anti"), "ann-short")
    if wanted and not short.isEmpty():
        rest = once.join(short.select(F.col("vec_id").alias("query_id")).distinct(), "query_id", "left_anti")
        once = rest.unionByName(answers(short, True))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return once.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], pa.RecordBatch]]:
    """((slot, block), rows of one list) in the order of the batches."""
    for batch in batches:
        keys = np.column_stack([batch.column(c).to_numpy() for c in ("slot", "block", "list")])
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if a < b:
                yield (int(keys[a, 0]), int(keys[a, 1])), batch.slice(a, b - a)
