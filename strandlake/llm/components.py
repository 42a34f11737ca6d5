"""Connected components of an edge table, by alternating large and small stars.

Each round points every node's neighbours at its least neighbour; the edge set
becomes a set of stars after few rounds. All steps are shuffled aggregations and
equi-joins, in which nodes of many edges are joined by broadcast, so that a giant
component's hub is not one task; nothing is gathered on the driver but a count and a hash sum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, spread_join


def _star(edges: DataFrame, large: bool, total: int) -> DataFrame:
    """edges (a, b) with a > b. Large: each node's larger neighbours take its least; small: its smaller ones and itself do."""
    n = F.count("*").alias("n")
    if large:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), n).select("a", F.least("a", "m").alias("m"), "n")
        out = spread_join(edges.select(F.col("b").alias("a"), F.col("a").alias("v")), least, "a", 2 * total).select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("m"), n)
        out = spread_join(edges, least, "a", total).select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def connected(edges: DataFrame) -> DataFrame:
    """edges (a, b), any order, comparable ids. Returns node, root: every node of an edge and its component's least node."""
    edges = checkpointed(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    while True:
        found = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if found == state or found[0] == 0:
            break
        state = found
        stars = checkpointed(_star(edges, True, found[0]))
        edges = checkpointed(_star(stars, False, found[0]))
    roots = edges.select(F.col("b").alias("node")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots.select("node", F.col("node").alias("root")))
