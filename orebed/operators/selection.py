"""Selections, interval joins and set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orebed.operators.longseries import settled


def within(points: DataFrame, spans: DataFrame, keys: list[str], at: str, start: str, end: str) -> DataFrame:
    """points joined to the spans of their keys that hold them, both ends included; null ends hold nothing."""
    return points.join(spans, keys).where((F.col(at) >= F.col(start)) & (F.col(at) <= F.col(end)))


def overlapping(spans: DataFrame, keys: list[str], id_col: str, start: str, end: str) -> DataFrame:
    """(keys, a, b): pairs of spans with the same keys of which neither ends before the other starts, the smaller id first."""
    a = spans.select(*keys, F.col(id_col).alias("a"), F.col(start).alias("_s"), F.col(end).alias("_e"))
    b = spans.select(*keys, F.col(id_col).alias("b"), F.col(start).alias("_u"), F.col(end).alias("_v"))
    return a.join(b, keys).where("a < b AND _s <= _v AND _u <= _e").select(*keys, "a", "b")


def within_budget(items: DataFrame, group: list[str], order: list[Column], cost: str, budget: float) -> DataFrame:
    """The items of each group, best first, whose costs add up to the budget at most."""
    w = Window.partitionBy(*group).orderBy(*order)
    return items.withColumn("spent", F.sum(cost).over(w.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("spent") <= budget)


def eligible_or_all(items: DataFrame, group: list[str], eligible: str, order: list[Column], n: int) -> DataFrame:
    """The first n eligible items of each group; where it has none, the first n of all."""
    some = F.max(F.col(eligible).cast("int")).over(Window.partitionBy(*group)) == 1
    kept = items.withColumn("_some", some).where(~F.col("_some") | F.col(eligible)).drop("_some")
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= n)


def margins(items: DataFrame, group: list[str], item: str, score: str) -> DataFrame:
    """Each group's best item and how far it is ahead of the next (null without one); ties go to the smaller item."""
    w = Window.partitionBy(*group).orderBy(F.desc(score), item)
    ranked = items.withColumn("rank", F.row_number().over(w)).withColumn("margin", F.col(score) - F.lead(score).over(w))
    return ranked.where("rank = 1").drop("rank")


def best_of(parts: list[DataFrame], keys: list[str], score: str) -> DataFrame:
    """The union of the parts, each key once with its largest score."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.groupBy(*keys).agg(F.max(score).alias(score))


#: Claims of up to this many entities meet by two of them, as they have few such couples.
PAIRED = 20


def linked_claims(claims: DataFrame, id_col: str, entities: str, negative: str, least: float = 0.6) -> DataFrame:
    """(a, b, similarity, relation): claims that share an entity and are alike by Jaccard similarity; polarity tells support from contradiction."""
    one = claims.select(F.col(id_col).alias("id"), F.array_distinct(entities).alias("e"), F.col(negative).alias("neg"))
    by = one.select("id", F.explode("e").alias("entity"))
    # With entities in one order, rarest first, two claims that share n of them share k of each one's first size - n + k.
    # n is at least ceil(least / (1 + least) * (size of a + size of b)), so where that is two or more, small claims meet by
    # two shared entities at once, and only the others by a single one. Each meeting is verified where it is found.
    ranked = by.join(by.groupBy("entity").agg(F.count(F.lit(1)).alias("often")), "entity").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("often", "entity"))).alias("r"))  # the entities of one claim
    ranked = ranked.select("id", F.transform("r", lambda x: x["entity"]).alias("e"), F.size("r").alias("size")).join(one.select("id", "neg"), "id")
    ranked = settled(ranked)  # four readers
    head = lambda k: F.slice("e", F.lit(1), F.least(F.col("size"), F.col("size") - F.ceil(F.lit(least) * F.col("size") - 1e-9).cast("int") + k))
    doubles = F.flatten(F.transform(head(2), lambda x, i: F.transform(F.slice(head(2), i + 2, F.size(head(2))), lambda y: F.array(x, y))))
    shared = F.ceil(least / (1 + least) * (F.col("s_a") + F.col("s_b")) - 1e-9)
    by_two = (shared >= 2) & (F.greatest("s_a", "s_b") <= PAIRED)
    lone = (F.col("size") + 1) * least / (1 + least) <= 1 + 1e-9  # may share but one entity with the smallest claims
    kinds = [(ranked.where(lone | (F.col("size") > PAIRED * least)).withColumn("key", F.explode(head(1))), ~by_two), (ranked.where((F.col("size") >= 2) & (F.col("size") <= PAIRED)).withColumn("key", F.explode(doubles)), by_two)]
    n = F.size(F.array_intersect("e_a", "e_b"))
    found = None
    for keyed, meets in kinds:
        left, right = (keyed.select(F.col("id").alias(x), F.col("size").alias(f"s_{x}"), F.col("e").alias(f"e_{x}"), F.col("neg").alias(f"neg_{x}"), "key") for x in "ab")
        alike = (F.col("s_a") >= least * F.col("s_b")) & (F.col("s_b") >= least * F.col("s_a"))
        met = left.join(right, "key").where(F.col("a") < F.col("b")).where(alike & meets).withColumn("similarity", n / (F.col("s_a") + F.col("s_b") - n)).where(F.col("similarity") >= least)
        met = met.select("a", "b", "similarity", "neg_a", "neg_b").dropDuplicates(["a", "b"])
        found = met if found is None else found.unionByName(met)
    return found.select("a", "b", "similarity", F.when(F.col("neg_a") == F.col("neg_b"), "SUPPORTS").otherwise("CONTRADICTS").alias("relation"))


def phasor(keys: list[str], value: str, index: str, cycles: float, rows: DataFrame) -> DataFrame:
    """(keys, re, im): amplitude of value at cycles per series, each series a whole number of them."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    angle = 2 * F.pi() * cycles * F.col(index) / n
    terms = rows.withColumn("_n", n).withColumn("_a", angle)
    return terms.groupBy(*keys).agg((2 / F.first("_n") * F.sum(F.col(value) * F.cos("_a"))).alias("re"), (-2 / F.first("_n") * F.sum(F.col(value) * F.sin("_a"))).alias("im"))
