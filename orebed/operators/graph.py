"""Edge tables: filtering, degrees, expansion, levels, paths, and weighted root-cause ranking."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orebed.operators.longseries import settled


def filter_edges(edges: DataFrame, topology: DataFrame | None, max_p: float, keep_unknown: bool = True) -> DataFrame:
    """edges (cause, effect, p_value) with removal_reason: P_VALUE, NOT_IN_TOPOLOGY or null (kept); without topology all pass or none by keep_unknown."""
    weak = F.col("p_value") > max_p
    if topology is None:
        return edges.withColumn("removal_reason", F.when(weak, "P_VALUE").when(F.lit(not keep_unknown), "NO_TOPOLOGY"))
    known = topology.select("cause", "effect").distinct().withColumn("_k", F.lit(True))
    return edges.join(known, ["cause", "effect"], "left").withColumn("removal_reason", F.when(weak, "P_VALUE").when(F.col("_k").isNull(), "NOT_IN_TOPOLOGY")).drop("_k")


def degrees(edges: DataFrame) -> DataFrame:
    """(node, n_out, n_in, upstreamness): .7 of the out-degree's share of the largest and .3 of what the in-degree's share leaves."""
    both = edges.select(F.col("cause").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionAll(edges.select(F.col("effect"), F.lit(0), F.lit(1)))
    d = both.groupBy("node").agg(F.sum("o").alias("n_out"), F.sum("i").alias("n_in"))
    top = d.agg(F.max("n_out").alias("_o"), F.max("n_in").alias("_i"))
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return d.join(F.broadcast(top)).select("node", "n_out", "n_in", (0.7 * share("n_out", "_o") + 0.3 * (1 - share("n_in", "_i"))).alias("upstreamness"))  # one row


def expand(seeds: DataFrame, edges: DataFrame, hops: int, node: str = "node") -> DataFrame:
    """(node, hop): what the seeds reach within hops steps along edges, with the fewest steps."""
    seen = seeds.select(node).distinct().withColumn("hop", F.lit(0))
    front = seen
    step = edges.select(F.col("cause").alias(node), F.col("effect").alias("_to")).distinct()
    for h in range(1, hops + 1):
        front = front.join(step, node).select(F.col("_to").alias(node)).distinct().join(seen.select(node), node, "left_anti").withColumn("hop", F.lit(h))
        seen = seen.unionByName(front)
    return seen


def paths(roots: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """(root, path, length) of all simple paths of one to depth edges from the roots."""
    front = roots.select(F.col("node").alias("root"), F.array("node").alias("path"))
    step = edges.select("cause", "effect").distinct()
    out = []
    for _ in range(depth):
        last = F.element_at("path", -1)
        front = front.join(step, last == F.col("cause")).where(~F.array_contains("path", F.col("effect"))).select("root", F.concat("path", F.array("effect")).alias("path"))
        out.append(front)
    return reduce(DataFrame.unionByName, out).withColumn("length", F.size("path") - 1)


def levels(edges: DataFrame) -> DataFrame:
    """(node, level): longest distance from a node without causes, of any length; nodes on or behind a cycle get null.

    A node is placed in the round in which the last of its causes has been; each round drops the edges of the nodes placed before.
    """
    left = settled(edges.select("cause", "effect").distinct())
    nodes = left.select(F.col("cause").alias("node")).union(left.select("effect")).distinct()
    front = settled(nodes.join(left.select(F.col("effect").alias("node")), "node", "left_anti"))
    found, level = front.withColumn("level", F.lit(0)), 0
    while not front.isEmpty():
        level += 1
        done = front.withColumnRenamed("node", "cause")
        rest = settled(left.join(done, "cause", "left_anti"))
        freed = left.join(done, "cause", "left_semi").select(F.col("effect").alias("node")).distinct()
        front = settled(freed.join(rest.select(F.col("effect").alias("node")), "node", "left_anti"))
        left, found = rest, found.unionByName(front.withColumn("level", F.lit(level)))
    return nodes.join(found, "node", "left")


def weighted_rank(scores: DataFrame, by: list[str], item: str, weights: dict[str, float]) -> DataFrame:
    """scores with the clipped, weighted mean of its columns, rank (ties by item) and the margin to the next."""
    total = sum(weights.values())
    part = reduce(lambda a, b: a + b, [F.least(F.greatest(F.coalesce(F.col(c), F.lit(0.0)), F.lit(0.0)), F.lit(1.0)) * (w / total) for c, w in weights.items()])
    w = Window.partitionBy(*by).orderBy(F.desc(F.round("score", 9)), item)
    return scored_order(scores.withColumn("score", part), w)


def scored_order(scored: DataFrame, w: Window) -> DataFrame:
    return scored.withColumn("rank", F.row_number().over(w).cast("long")).withColumn("margin", F.col("score") - F.lead("score").over(w))


def weight_grid(parts: int, names: list[str]) -> list[dict[str, float]]:
    """All weights in steps of 1 / parts that add up to one."""
    if len(names) == 1:
        return [{names[0]: 1.0}] if parts else [{names[0]: 0.0}]

    def split(left: int, k: int) -> list[tuple[int, ...]]:
        return [(left,)] if k == 1 else [(i, *rest) for i in range(left + 1) for rest in split(left - i, k - 1)]

    return [dict(zip(names, (x / parts for x in c), strict=True)) for c in split(parts, len(names))]
