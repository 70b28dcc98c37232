"""Connected components over an edge table by alternating large-star and small-star rounds.

Each round is aggregations and equi-joins on node keys; round results are written tables, so lineage stays
short and a lost executor costs at most one round; a round's table is deleted after the next. Nothing but the question whether
rounds are over reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pricelens.llm.common import discard, materialize


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node with a smaller neighbour has one link, to a node with none."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up")))
    return ends.groupBy("node").agg(F.sum("up").alias("ups"), F.count("*").alias("links")).filter("ups > 1 or (ups = 1 and links > 1)").isEmpty()


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node's larger neighbours are linked to its smallest neighbour (or itself)."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours are linked to the smallest of these."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v")))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b): the smallest node reachable. Nulls and loops are ignored."""
    current = materialize(
        edges.filter("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    while not _are_stars(current):
        following = materialize(_small_star(_large_star(current).distinct()).distinct(), "edges")
        discard(current)
        current = following
    roots = current.select(F.col("v").alias("node")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.withColumn("component", F.col("node")))
