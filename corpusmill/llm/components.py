"""Connected components of a graph held in tables: each id gets the smallest id it can reach."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import forget, written


def connected(edges: DataFrame, a: str, b: str, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of `edges`.

    Alternates large-star and small-star steps until every node that is no smallest one has one edge, to the
    smallest of its component. Minima per node are pre-aggregated, and joined with the edges by sort-merge, where
    adaptive execution splits the edges of a hub; each round is written to the shared folder. The number of rounds is logarithmic.
    """
    both = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    now = written(both, "links")
    for _ in range(most_rounds):
        if all_stars(now):
            break
        large = written(large_star(now), "links-large")
        small = written(small_star(large), "links-small")
        forget(large, now)
        now = small
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    heads = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(heads)


def all_stars(edges: DataFrame) -> bool:
    """Whether each node has one edge down at most, and none if an edge ends in it."""
    one = F.lit(1).cast("long")
    ends = edges.select(F.col("u").alias("node"), one.alias("down"), (one - 1).alias("ends")).unionByName(edges.select(F.col("v").alias("node"), (one - 1).alias("down"), one.alias("ends")))
    nodes = ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("ends").alias("ends"))
    return nodes.where("down > 1 or (down = 1 and ends = 1)").isEmpty()


def large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest of the node and its neighbours."""
    around = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = written(around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "links-min")
    return around.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are linked to the smallest of them; edges point down already."""
    least = written(edges.groupBy("u").agg(F.min("v").alias("m")), "links-min")
    moved = edges.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
