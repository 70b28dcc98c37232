"""Operator 13: the prefix trie of conversations, rolled up by centroid decomposition.

Every turn is numbered within its conversation, conversations are rebuilt, and a prefix is known by two 64-bit
hashes of its turns, each hashed with its place, xor-ed along the conversation. Nodes are groupings of prefixes;
a node is named by its smallest member and its depth, and knows its parent's hashes.

Rollup. The weight of a node is its number of members, so the weight W of its subtree is known from the
grouping alone: the turns its members still have from there on. A component is a complete subtree. Its centroid is the
deepest node whose subtree keeps the component's size class (the power of two below W); there is only one, for two
children of that class would weigh more than their parent. Taking the centroid-to-top path out splits the
component; what hangs off weighs less than that power of two and is split in the same way, at most log2 W times.
On the path of any conversation the components are the stretches of one class, so all splits are found by one
grouping. Component totals are aggregated where they leave a path and are then added along
centroid-to-top paths, a sum from the bottom. No task holds a component: paths are cut into blocks.

Order and identity: turns by turn (null first), equal ones by a hash of role and text; null role or text counts as empty. Rows without
conv_id belong to no conversation and are left out. Repeated rows are turns of their own. An empty table has no
conversations, hence no nodes, not even a root. A negative id's base is ``c - c % 100`` with the sign of c.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from pricelens.llm.common import map_batches, materialize, partitions

#: Turns or nodes of one chain that a window holds at a time; ids of one message that ends at a node.
BLOCK = 4096
#: Conversations that share a base, and the most turns taken from it, plus one.
EVERY, MOST = 100, 6


def running(df: DataFrame, keys: list[str], place: str, columns: dict[str, Column], combine, upward: bool = True) -> DataFrame:
    """``df`` with running aggregates ``columns`` along ``place`` (1, 2, ...) for each key, itself included.

    Places are cut into blocks of BLOCK: a window inside each block, and one over the blocks' totals.
    ``combine`` is an associative aggregate (F.sum, F.bit_xor). ``upward`` False runs from the largest place down.
    """
    order = F.col(place) if upward else F.col(place).desc()
    part = df.withColumn("run_block", F.floor(F.col(place) / BLOCK).cast("long"))
    inside = W.partitionBy(*keys, "run_block").orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    named = part.select("*", *[combine(c).over(inside).alias(n) for n, c in columns.items()])
    totals = part.groupBy(*keys, "run_block").agg(*[combine(c).alias(f"run_{n}") for n, c in columns.items()])
    along = F.col("run_block") if upward else F.col("run_block").desc()
    earlier = W.partitionBy(*keys).orderBy(along).rowsBetween(W.unboundedPreceding, -1)
    start = totals.select(*keys, "run_block", *[F.coalesce(combine(f"run_{n}").over(earlier), F.lit(0)).alias(f"run_{n}") for n in columns])
    both = named.join(start, [*keys, "run_block"])
    add = (lambda a, b: a.bitwiseXOR(b)) if combine is F.bit_xor else (lambda a, b: a + b)
    return both.select(*df.columns, *[add(F.col(n), F.col(f"run_{n}")).alias(n) for n in columns])


def numbered(turns: DataFrame) -> DataFrame:
    """conv_id, place (from 1), two hashes of role and text, n_chars: the turns of every conversation in order.

    Rows are dealt by ranges of (conv_id, turn, hashes), so a conversation of any length is spread; rows are
    counted within a part, and what earlier parts hold of a conversation is added.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    conv, turn = F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn")
    slim = turns.filter("conv_id is not null").select(conv, turn, role.alias("role"), text.alias("text"))
    hashed = slim.select("conv_id", "turn", F.xxhash64("role", "text").alias("t1"), F.xxhash64(F.lit(13), F.reverse("text"), "role").alias("t2"), F.length("text").cast("long").alias("n_chars"))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("t1"), F.col("t2")]
    # equal rows are interchangeable: their number only lets ranges part them
    spread = hashed.withColumn("copy", F.monotonically_increasing_id()).repartitionByRange(partitions(turns.sparkSession), *order, F.col("copy")).sortWithinPartitions(*order)
    dealt = materialize(spread.select("conv_id", "t1", "t2", "n_chars", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row")), "trie-turns")
    held = dealt.groupBy("conv_id", "part").agg(F.count("*").alias("held"), F.min("row").alias("first_row"))
    before = F.coalesce(F.sum("held").over(W.partitionBy("conv_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = held.select("conv_id", "part", "first_row", before.alias("before"))
    return dealt.join(offsets, ["conv_id", "part"]).select("conv_id", (F.col("row") - F.col("first_row") + F.col("before") + 1).alias("place"), "t1", "t2", "n_chars")


def rebuilt(turns: DataFrame) -> DataFrame:
    """conv_id, depth (0: the root, one row each), n_chars and the hashes e1, e2 of each turn of every rebuilt conversation."""
    turns = materialize(turns, "trie-places")
    share = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(MOST)).alias("share")
    own = turns.groupBy("conv_id").agg(F.max("place").alias("turns")).select("conv_id", "turns", share, (F.col("conv_id") - F.col("conv_id") % EVERY).alias("base"))
    heads = turns.filter(F.col("place") < MOST).select(F.col("conv_id").alias("base"), "place", "t1", "t2", "n_chars")
    sizes = heads.groupBy("base").agg(F.max("place").alias("base_turns"))
    own = materialize(own.join(sizes, "base", "left").withColumn("taken", F.least("share", F.coalesce("base_turns", F.lit(0)))), "trie-conversations")
    taken = own.select("conv_id", "base", "taken").join(heads, "base").filter("place <= taken").select("conv_id", F.col("place").alias("depth"), "t1", "t2", "n_chars")
    kept = turns.join(own.select("conv_id", "share", "taken"), "conv_id").filter("place > share").select("conv_id", (F.col("place") - F.col("share") + F.col("taken")).alias("depth"), "t1", "t2", "n_chars")
    turn = taken.unionByName(kept).select("conv_id", "depth", "n_chars", F.xxhash64("depth", "t1", "t2").alias("e1"), F.xxhash64("t2", "depth", "t1").alias("e2"))
    root = own.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("n_chars"), F.lit(0).cast("long").alias("e1"), F.lit(0).cast("long").alias("e2"))
    return turn.unionByName(root)


def prefixes(turns: DataFrame) -> DataFrame:
    """``rebuilt`` turns with the hashes k1, k2 of the prefix that each ends and of the one before (p1, p2), and the turns left."""
    turns = materialize(rebuilt(turns), "trie-rebuilt")
    length = turns.groupBy("conv_id").agg(F.max("depth").alias("length"))
    keyed = running(turns, ["conv_id"], "depth", {"k1": F.col("e1"), "k2": F.col("e2")}, F.bit_xor).join(length, "conv_id")
    return keyed.select(
        "conv_id", "depth", "n_chars", "k1", "k2", F.col("k1").bitwiseXOR(F.col("e1")).alias("p1"), F.col("k2").bitwiseXOR(F.col("e2")).alias("p2"),
        (F.col("length") - F.col("depth")).alias("below"),
    )


KEY = ["depth", "k1", "k2"]


def trie_nodes(prefix: DataFrame) -> DataFrame:
    """One row per node: its key, owner (smallest member), n_convs, weight of the subtree and its size class, parent's key."""
    nodes = prefix.groupBy(*KEY).agg(
        F.count("*").alias("n_convs"), F.min("conv_id").alias("owner"), F.sum(F.col("below") + 1).alias("weight"), F.min("n_chars").alias("n_chars"), F.min("p1").alias("p1"), F.min("p2").alias("p2"),
    )
    children = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("n_children"))
    size_class = F.length(F.bin("weight")).alias("class")
    return nodes.join(children, KEY, "left").select(*KEY, "n_convs", "owner", "n_chars", "p1", "p2", size_class, F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"))


def stretches(prefix: DataFrame, nodes: DataFrame) -> DataFrame:
    """Per conversation and size class: the component whose centroid-to-top path it follows (top's key), and where it leaves it."""
    classed = prefix.filter("depth > 0").select("conv_id", *KEY).join(nodes.filter("depth > 0").select(*KEY, "class"), KEY)
    top = F.min(F.struct("depth", "k1", "k2")).alias("top")
    return classed.groupBy("conv_id", "class").agg(top, F.max("depth").alias("exit"))


def rollup(nodes: DataFrame, along: DataFrame, values: dict[str, Column]) -> DataFrame:
    """owner, depth and the sums of ``values`` over every node's subtree, the root aside."""
    held = nodes.filter("depth > 0").select("owner", "class", "depth", *[c.alias(n) for n, c in values.items()])
    at = materialize(held.join(along.select(F.col("conv_id").alias("owner"), "class", "top"), ["owner", "class"]), "trie-components")
    mine = at.select("top", "depth", *values)
    # what a conversation owns below the exit of each of its components, added there
    owned = held.groupBy("owner", "class").agg(*[F.sum(n).alias(n) for n in values])
    chain = along.select(F.col("conv_id").alias("owner"), "class", "top", "exit").join(owned.select("owner").distinct(), "owner", "left_semi").join(owned, ["owner", "class"], "left")
    deeper = W.partitionBy("owner").orderBy("class").rowsBetween(W.unboundedPreceding, -1)
    sums = chain.select("top", F.col("exit").alias("depth"), *[F.sum(F.coalesce(n, F.lit(0))).over(deeper).alias(n) for n in values]).filter(F.col(next(iter(values))).isNotNull())
    totals = materialize(mine.unionByName(sums).groupBy("top", "depth").agg(*[F.sum(n).alias(n) for n in values]), "trie-totals")
    summed = running(totals, ["top"], "depth", {f"sum_{n}": F.col(n) for n in values}, F.sum, upward=False)
    found = summed.select("top", "depth", *[F.col(f"sum_{n}").alias(n) for n in values])
    return at.select("top", "owner", "depth").join(found, ["top", "depth"]).select("owner", "depth", *values)


def ends(prefix: DataFrame) -> DataFrame:
    """Key and ends_sha256 of the nodes at which conversations end.

    Ids come in messages of at most BLOCK of them, a range of ids each; one task reads a node's messages in order.
    """
    chunk = F.floor(F.col("conv_id") / BLOCK).alias("chunk")
    last = prefix.filter("below = 0").groupBy(*KEY, chunk).agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string"))).alias("ids"))
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest = None, hashlib.sha256()
        done: list[tuple] = []
        for batch in batches:
            for d, a, b, ids in zip(*(batch.column(c).to_pylist() for c in (*KEY, "ids")), strict=True):
                if key == (d, a, b):
                    digest.update(f",{ids}".encode())
                    continue
                if key:
                    done.append((*key, digest.hexdigest()))
                key, digest = (d, a, b), hashlib.sha256(ids.encode())
            yield _rows(done)
            done = []
        if key:
            yield _rows([(*key, digest.hexdigest())])

    ordered = last.repartition(partitions(prefix.sparkSession), *KEY).sortWithinPartitions(*KEY, "chunk").select(*KEY, "ids")
    return map_batches(ordered, run, "depth long, k1 long, k2 long, ends_sha256 string")


def _rows(done: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*done, strict=True)) if done else [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.string())], names=[*KEY, "ends_sha256"])


def prefix_trie(turns: DataFrame) -> DataFrame:
    """One row per node of the trie of all rebuilt conversations of ``turns`` (conv_id, turn, role, text)."""
    prefix = materialize(prefixes(numbered(turns)), "trie-prefixes")
    nodes = materialize(trie_nodes(prefix), "trie-nodes")
    values = {"n_leaves": (F.col("n_children") == 0).cast("long"), "saved_tokens": (F.col("n_convs") - 1) * F.col("n_chars")}
    sums = rollup(nodes, stretches(prefix, nodes), values)
    names = ["owner", "depth", "parent_conv_id", "n_convs", "n_children", "k1", "k2"]
    # the root is a component by itself: one row, made of sums over all nodes
    top = nodes.agg(F.min("owner").alias("owner"), F.max("n_convs").alias("n_convs"), F.count_if(F.col("depth") == 1).alias("n_children"), *[F.sum(c).alias(n) for n, c in values.items()]).filter("owner is not null")
    first_owner = top.select("owner").first()
    nobody = F.lit(None).cast("long")
    zero = F.lit(0).cast("long")
    root = top.select("owner", zero.alias("depth"), nobody.alias("parent_conv_id"), "n_convs", "n_children", zero.alias("k1"), zero.alias("k2"), *values)
    up = nodes.filter("depth > 0").select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("owner").alias("parent_conv_id"))
    deep = nodes.filter("depth > 1").join(up, ["depth", "p1", "p2"])
    first = nodes.filter("depth = 1").withColumn("parent_conv_id", F.lit(first_owner and first_owner[0]).cast("long"))
    full = deep.select(names).unionByName(first.select(names)).join(sums, ["owner", "depth"]).unionByName(root).join(ends(prefix), KEY, "left")
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    return full.select(F.col("owner").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", nothing).alias("ends_sha256"))
