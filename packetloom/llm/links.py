"""Connected components of a graph given as edges, without collecting any of it.

Large-star and small-star rounds: every node is linked to the smallest node it knows, first its larger neighbours,
then its smaller ones, until nothing changes. A node's neighbours meet in an aggregate (a minimum), which combines
before the shuffle, and in joins on the node, which Spark can split when a node is hot. Each round is a table in the
shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.llm.common import written


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """(a, b) with a > b -> every neighbour linked to the smallest one around its centre."""
    if larger:
        around = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        around = edges
    least = around.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    linked = around.join(least, "a")
    if larger:
        out = linked.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = linked.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.where("a > b").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(a, b) pairs of longs -> (node, root) for every node but the roots; the root is the smallest node reachable."""
    edges = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), "links")
    if edges.isEmpty():
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    before = None
    for _ in range(rounds):
        edges = written(_star(_star(edges, larger=True), larger=False), "links")
        # Stars alone: no node is both a centre's leaf and a centre. Then nothing moves any more.
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % F.lit(1 << 31))).first())
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now
    raise RuntimeError("components did not settle")
