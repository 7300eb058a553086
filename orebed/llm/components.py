"""Connected components of a graph that no single task or driver could hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orebed.llm.kernels import cut_lineage


def connected_components(edges: DataFrame) -> DataFrame:
    """Map every vertex of the edges (a long, b long) to the smallest vertex that it reaches.

    Alternates two contractions until nothing changes: each vertex links its larger
    neighbours to its smallest one, then itself and its smaller neighbours to the
    smallest of them. Both are a map-side combined minimum and a join back by key, so
    a vertex with very many neighbours is never gathered; rounds grow with
    the logarithm of the longest path. Null ends and loops are ignored.
    Returns (vertex, root) for vertices with at least one edge.
    """
    now = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = cut_lineage(now)
    before = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a")
        nxt = small.select("a", F.col("m").alias("b")).union(small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct()
        nxt = cut_lineage(nxt)
        state = nxt.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        now = nxt
        if state == before:
            break
        before = state
    return now.select(F.col("a").alias("vertex"), F.col("b").alias("root")).union(now.select(F.col("b"), F.col("b")).distinct())
