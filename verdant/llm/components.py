"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large star: every larger neighbour of a node is tied to the smallest of
    its neighbourhood.  Small star: the node and its smaller neighbours are.
    Written; ``edges``, a written table too, is discarded."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else \
        edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = written(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), "cc_least")
    tied = both.join(least, "u")
    if large:
        out = tied.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = tied.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v")))
    out = written(out.where("u != v").distinct(), "cc_large" if large else "cc_small")
    discard(edges, least)
    return out


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, root) for every node of edges(u, v); root is the component's
    smallest node.  Each round is written, so a lost executor costs a round, and
    the one before it discarded."""
    now = written(edges.select("u", "v").where("u != v").distinct(), "cc_edges")
    mark = None
    for _ in range(rounds):
        now = _star(_star(now, True), False)
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == tuple(seen):
            break
        mark = tuple(seen)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    pairs = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return pairs.unionByName(pairs.select(F.col("root").alias("node"), "root")).distinct()
