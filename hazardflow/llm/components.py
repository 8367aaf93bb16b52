"""Connected components by alternating large-star and small-star steps over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from hazardflow.llm.storage import stored


def large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour larger than a node moves to the least of the node and its neighbours.

    An edge gives one edge at most, from its larger end ``u`` to a smaller node ``v``.
    """
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))


def small_star(down: DataFrame) -> DataFrame:
    """A node and all its smaller neighbours move to the least of them; edges lead from ``u`` down to ``v``."""
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.withColumnRenamed("m", "v")).distinct()


def is_star(edges: DataFrame) -> bool:
    """Whether every node has one edge down and no edge ends where another begins."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("root"))
    )
    counts = ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("root").alias("root"))
    return counts.where("down > 1 or (down = 1 and root = 1)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """``node, component``: every node that has an edge, and the least node it is connected with.

    ``edges`` has long columns ``u`` and ``v``; directions, repeats, loops and nulls do not matter. Each round is written to the
    shared folder, so a lost executor repeats a round at most. Nothing but the verdict on a round reaches the driver.
    """
    edges = stored(small_star(large_star(edges.where("u <> v").select("u", "v"))), "edges")
    while not is_star(edges):
        edges = stored(small_star(large_star(edges)), "edges")
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
