"""Connected components of an edge table, in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released, stored


def marked(edges: DataFrame) -> tuple:
    """How many edges there are, and the sum of their 64-bit hashes as a decimal: equal edge sets have equal marks."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b), component being the smallest node that can be reached.

    Alternating large-star and small-star: each node points its larger neighbours, then its smaller ones, at the least node that it knows.
    Each round is written to the shared folder, so lineage and recovery stay short; it ends when a round changes no edge, be it the first, which takes about as
    many rounds as the logarithm of the number of nodes. An empty table gives an empty result; loops and repeated edges don't matter.
    A node that a third of all edges share costs one row an edge in each round, and both steps aggregate by node with partial sums.
    """
    now = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    mark = marked(now)
    while mark[0]:
        # large star: for each node, its larger neighbours go to the least of it and its neighbours
        both = now.select(F.col("u").alias("n"), F.col("v").alias("o")).union(now.select(F.col("v").alias("n"), F.col("u").alias("o")))
        least = both.groupBy("n").agg(F.min("o").alias("m")).select("n", F.least("n", "m").alias("m"))
        # stored, as the small star reads it twice: one plan of both would hold it twice, and the driver keeps and redraws each plan as its stages end
        large = stored(both.where("o > n").join(least, "n").select(F.col("o").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "stars")
        # small star: for each node, its smaller neighbours and itself go to the least of them
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(lowest.select("u", F.col("m").alias("v"))).distinct()
        before, now = now, stored(small, "edges")
        released(before, large)
        before, mark = mark, marked(now)
        if before == mark:
            break
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select("node", F.col("node").alias("component")))
