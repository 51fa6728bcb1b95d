"""Connected components by alternating stars, all in joins and groupings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import discarded, saved


def connected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of ``edges``: root is the least node that links reach.

    Each round hooks the greater neighbours of every node to the least one
    (large star), then the lesser ones (small star); rounds are logarithmic in
    the longest path. A node's neighbours are never brought together: each gets
    the node's least by a join of two tables, which Spark's adaptive execution
    splits where a node is hot (it could not if one side were a grouping). All
    steps are written to the shared folder, and removed when no longer read.
    Loops and repeats do no harm; null nodes are left out; no edges give no rows.
    """
    u, v = F.col("u"), F.col("v")
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull()).where("u != v").distinct()
    now = saved(now, "stars")
    mark = _mark(now)
    while True:
        both = now.unionByName(now.select(v.alias("u"), u.alias("v")))
        least = saved(both.groupBy("u").agg(F.least(F.min("v"), u).alias("m")), "star-least")
        large = both.where("v > u").join(least, "u").select(v.alias("u"), F.col("m").alias("v")).where("u != v")
        large = saved(large, "star-large")  # repeats stay: the last step of the round drops them
        lesser = saved(large.groupBy("u").agg(F.min("v").alias("m")), "star-least")
        small = large.join(lesser, "u").where(v > F.col("m")).select(v.alias("u"), F.col("m").alias("v"))
        small = small.unionByName(lesser.select("u", F.col("m").alias("v"))).distinct()
        steps = [now, least, large, lesser]
        now = saved(small, "stars")
        before, mark = mark, _mark(now)
        for step in steps:
            discarded(step)
        if mark == before:
            break
    return now.select(u.alias("node"), v.alias("root")).unionByName(now.select(v.alias("node"), v.alias("root")).distinct())


def _mark(edges: DataFrame) -> tuple:
    """Count and sum of hashes: the same just for the same distinct edges, but for accidents of 2**-64."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
