"""Connected components of a graph that may not fit on any one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import Scratch


def connected(scratch: Scratch, links: DataFrame) -> DataFrame:
    """(node, root) for every node of links(a, b); root is the smallest node it reaches.

    Each round points every node at its smallest neighbour, if that is smaller. A node smaller than
    all its neighbours, at which none of them points, points at its smallest neighbour instead,
    which points below it. So every node that has a link is in a tree of two or more, whose top is
    its smallest node. Pointers are doubled until none moves, and the tree becomes one node: at
    least half of the linked nodes go in each round, so rounds grow with the logarithm of the nodes,
    and the jumps of a round with that of the longest path. A path of rising numbers takes one round.

    Every intermediate is a table in the shared folder. Aggregates combine before they shuffle, and
    each join stands directly on two tables, so Spark can split a hot node. Links to itself,
    repeated links and an empty table are fine.
    """
    a, b = F.col("a"), F.col("b")
    edges = scratch.save(links.where(a != b).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct(), "edges0")
    ends = edges.select(a.alias("node")).union(edges.select(b.alias("node"))).distinct()
    labels, turn = scratch.save(ends.select("node", F.col("node").alias("root")), "labels0"), 0
    while not edges.isEmpty():
        both = edges.select(a.alias("u"), b.alias("v")).union(edges.select(b.alias("u"), a.alias("v")))
        least = scratch.save(both.groupBy("u").agg(F.min("v").alias("p")), f"least{turn}")
        lower = least.where("p < u")
        alone = least.where("p > u").join(lower.select(F.col("p").alias("u")).distinct(), "u", "left_anti")
        parent = _tops(scratch, scratch.save(lower.unionByName(alone), f"parent{turn}_0"), f"parent{turn}")
        moved = _follow(_follow(edges, "a", parent), "b", parent).where(a != b)
        moved = moved.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()
        edges = scratch.save(moved, f"edges{turn + 1}")
        labels = scratch.save(_follow(labels, "root", parent), f"labels{turn + 1}")
        scratch.drop(f"least{turn}", f"edges{turn}", f"labels{turn}")
        turn += 1
    return labels


def _tops(scratch: Scratch, parent: DataFrame, name: str) -> DataFrame:
    """(u, p) with p the top of u's tree: each jump doubles how far pointers reach, until none moves."""
    jump = 0
    while True:
        step = parent.select(F.col("u").alias("_u"), F.col("p").alias("_p"))
        far = parent.select("u", "p").join(step, F.col("p") == F.col("_u"), "left")
        far = scratch.save(far.select("u", F.coalesce("_p", "p").alias("p"), F.col("_p").isNotNull().alias("moved")), f"{name}_{jump + 1}")
        scratch.drop(f"{name}_{jump}")
        parent, jump = far, jump + 1
        if far.where("moved").isEmpty():
            return far.select("u", "p")


def _follow(df: DataFrame, column: str, parent: DataFrame) -> DataFrame:
    step = parent.select(F.col("u").alias("_u"), F.col("p").alias("_p"))
    found = df.join(step, F.col(column) == F.col("_u"), "left")
    return found.withColumn(column, F.coalesce("_p", column)).drop("_u", "_p")
