"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runledger.llm.common import written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Join the neighbours of each node (larger ones, or smaller ones and itself) to the least of all."""
    both = edges.union(edges.select("v", "u")) if large else edges
    # u is the centre; in a small star v is its smaller neighbour.
    # Apart from the rows that they are joined to, so that adaptive execution can split a centre of very many edges.
    least = written(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), "least")
    joined = both.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of edges (u, v longs, u <> v); root is the least node reachable.

    Every round is written to the shared folder. Ends when a round leaves the edges as they were,
    which takes O(log^2 n) rounds; only counts and sums of a round come to the driver.
    """
    now = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    mark = F.struct(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))
    before = now.agg(mark).first()[0]
    while True:
        now = written(_star(_star(now, True), False), "edges")
        after = now.agg(mark).first()[0]
        if after == before:
            break
        before = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
