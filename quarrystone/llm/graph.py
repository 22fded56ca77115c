"""Connected components of a table of edges, by alternating large and small stars (Kiveris et al., 2014).

Every round is grouped minima and joins; each round's edges are written to the shared folder, so lineage stays short and
lost executors cost one round.  A node with very many neighbours is only ever one side of a join that Spark can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrystone.llm.shared import discard, materialize


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))


def _least_neighbours(edges: DataFrame) -> DataFrame:
    return _both_ways(edges).groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _large_star(edges: DataFrame, least: DataFrame) -> DataFrame:
    """Larger neighbours of a node are linked to its smallest one instead."""
    return _both_ways(edges).filter("v > u").join(least, "u").select(F.col("v").alias("b"), F.col("m").alias("a")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").filter("v > m").select(F.col("v").alias("b"), F.col("m").alias("a"))
    return moved.unionByName(least.select(F.col("u").alias("b"), F.col("m").alias("a"))).distinct()


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of an edge; the component is its smallest node.  Self-edges and nulls are ignored."""
    clean = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct()
    now = materialize(clean, "edges")
    seen = None
    for _ in range(rounds if now.limit(1).count() else 0):
        least = materialize(_least_neighbours(now), "least")  # stored, so that the join can split a node with very many neighbours
        after = materialize(_small_star(_large_star(now, least)), "edges")
        discard(now, least)
        now = after
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    else:
        if seen is not None:
            raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    return now.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(roots)
