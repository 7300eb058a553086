"""Approximate nearest neighbours by multiprobe p-stable hashing.

Vectors are scaled to length one and projected on Gaussian directions; a table's bucket is the
row of slots of a few projections. For a query, the chance that a neighbour at the usual
distance lies in a slot follows from the normal distribution of projected
differences, so buckets around the query's own are visited in order of estimated success
until the chances add up to a target. Slots are as wide and projections as few as keep these visits
few at the distance measured; where neighbours are hardly nearer than other vectors, buckets grow instead, and
with them the share of the table that a query meets. The tables' candidates are merged and ranked by their exact cosine.
Equal vectors are one class with its smallest ids, so copies cost nothing; a bucket with many
classes or many visitors is dealt as blocks of either. Queries whose buckets hold too few vectors are compared with all, in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush
from math import erf, exp, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orebed.llm.kernels import cut_lineage, mix

TABLES = 2
#: Least slot width in standard deviations of a projected unit vector, and least width in usual distances.
SLOT, REACH = 1.0, 2.6
#: Buckets that a query may visit in a table, on average; more projections are not taken.
VISITS = 128
#: Classes in a bucket, on average, that the number of projections aims at.
BUCKET = 512
#: Chance of finding a neighbour at the usual distance in at least one table.
SUCCESS = 0.97
#: Vectors whose distance to their k-th neighbour among all vectors is measured.
SAMPLE = 200
BLOCK_ROWS = 20_000
#: Queries that visit one block together; more are dealt over copies of it.
ASKED_ROWS = 10_000
QUERY_ROWS = 256


class Hashing:
    """Projections of each table (made anew from the seed for any dimension) and the usual neighbour distance."""

    def __init__(self, projections: int, distance: float, tables: int = TABLES, width: float = SLOT, success: float = SUCCESS, seed: int = 11) -> None:
        self.projections, self.distance, self.tables, self.width, self.seed = projections, max(distance, 1e-6), tables, width, seed
        self.share = 1 - (1 - success) ** (1 / tables)

    def projected(self, unit: np.ndarray, table: int) -> np.ndarray:
        """Projections in slot widths, shifted by the table's offsets."""
        rng = np.random.default_rng([self.seed, table, unit.shape[1]])
        directions, offsets = rng.standard_normal((unit.shape[1], self.projections)), rng.random(self.projections)
        return unit @ directions / self.width + offsets

    def keys(self, slots: np.ndarray, table: int, dim: int) -> np.ndarray:
        key = np.full(len(slots), mix(np.array([table + 1 + dim * 1024], dtype=np.uint64))[0])
        for j in range(slots.shape[1]):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + slots[:, j].astype(np.int64).view(np.uint64))
        return key.view(np.int64)

    def mean_visits(self, queries: int = 32) -> float:
        """Visits in a table, over projections drawn as those of unit vectors are."""
        rng = np.random.default_rng([self.seed, self.projections])
        at = rng.standard_normal((queries, self.projections)) / self.width + rng.random((queries, self.projections))
        return float(np.mean([len(self.probes(x)) for x in at]))

    def probes(self, at: np.ndarray) -> np.ndarray:
        """Slot rows to visit for one query's projections: likeliest first, until their chances reach the share."""
        spread = self.distance / self.width
        reach = int(np.ceil(5 * spread)) + 1
        slots = np.floor(at).astype(int)[:, None] + np.arange(-reach, reach + 1)
        edges = np.concatenate([slots, slots[:, -1:] + 1], axis=1) - at[:, None]
        below = np.array([[0.5 * (1 + erf(x / (spread * 2**0.5))) for x in row] for row in edges.tolist()])
        chance = np.diff(below, axis=1)
        order = np.argsort(-chance, axis=1, kind="stable")
        slots, costs = np.take_along_axis(slots, order, 1), -np.log(np.maximum(np.take_along_axis(chance, order, 1), 1e-300))
        costs = costs.tolist()
        # a row of choices is followed by those that take the next slot of one projection, at or behind the last one moved
        rows, got, heap = [], 0.0, [(sum(c[0] for c in costs), (0,) * len(at), 0)]
        while heap and got < self.share:
            cost, choice, last = heappop(heap)
            rows.append(choice)
            got += exp(-cost)
            for j in range(last, len(at)):
                if (n := choice[j] + 1) < len(costs[j]):
                    heappush(heap, (cost + costs[j][n] - costs[j][n - 1], (*choice[:j], n, *choice[j + 1 :]), j))
        return slots[np.arange(len(at)), np.array(rows)]


def _packed(vector: Column) -> Column:
    return F.transform(vector, lambda x: x.cast("double"))


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v array<double>): rows with an id and a vector that is finite throughout and not zero."""
    rows = vectors.select(F.col(id_col).alias("id"), _packed(F.col(vec_col)).alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return rows.where(fine).distinct()


def usual_distance(classes: DataFrame, k: int, sample: int = SAMPLE) -> float:
    """Median distance of at most sample vectors (those of smallest hash, of the longest dimension among them) to their k-th neighbour among all classes."""
    rows = [r.v for r in classes.select("v").orderBy(F.xxhash64("v"), "v").limit(sample).collect()]
    if not rows:
        return 1.0
    dim = max(map(len, rows))
    _, _, asked = next(_unit([r for r in rows if len(r) == dim]))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = np.full((len(asked), k + 1), -2.0)  # the vector itself among them
        for batch in batches:
            for d, _, unit in _unit(batch.column(0).to_pylist()):
                for at in range(0, len(unit) if d == dim else 0, BLOCK_ROWS):
                    top = np.sort(np.concatenate([top, asked @ unit[at : at + BLOCK_ROWS].T], axis=1), axis=1)[:, -k - 1 :]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(asked)), k + 1)), pa.array(top.ravel())], names=["i", "cos"])

    place = F.row_number().over(Window.partitionBy("i").orderBy(F.desc("cos")))
    kth = classes.select("v").mapInArrow(best, "i long, cos double").where("cos > -2").withColumn("n", place).where(F.col("n") <= k + 1)
    found = kth.groupBy("i").agg(F.min("cos").alias("cos"), F.max("n").alias("n")).where("n > 1").agg(F.percentile("cos", 0.5)).first()[0]
    return 1.0 if found is None else float(np.sqrt(max(2 - 2 * found, 0)))


def fit(classes: DataFrame, k: int, sample: int = SAMPLE, tables: int = TABLES, success: float = SUCCESS) -> Hashing:
    """Slot width from the usual distance; as many projections as the number of classes asks for, while visits stay few."""
    n, distance = classes.count(), usual_distance(classes, k, sample)
    width = max(SLOT, REACH * distance)
    wanted = max(1, min(12, round(log2(max(n, 1) / BUCKET + 1) / max(1.0, 2 - log2(width)))))
    index = Hashing(1, distance, tables, width, success)
    for projections in range(2, wanted + 1):
        more = Hashing(projections, distance, tables, width, success)
        if more.mean_visits() > VISITS:
            break
        index = more
    return index


def _unit(rows: list) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dimension, indices, unit vectors) of vectors by dimension."""
    sizes = np.array([len(r) for r in rows])
    for dim in np.unique(sizes):
        at = np.flatnonzero(sizes == dim)
        x = np.array([rows[i] for i in at], dtype=float)
        top = np.abs(x).max(axis=1, keepdims=True)
        x = x / top
        yield int(dim), at, x / np.linalg.norm(x, axis=1, keepdims=True)


def neighbours(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", tables: int = TABLES, success: float = SUCCESS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, <id>, score): each query's k nearest of vectors by cosine, its own id left out; ties go to smaller ids.

    queries: rows of vectors. Vectors that are null, zero, or hold null or non-finite components take no part,
    nor do null ids; only vectors of one dimension are compared. Repeated rows count once; an id with several vectors takes part with
    each. Empty tables give no rows; other columns are not read. A query that its buckets leave with too few neighbours is compared with all vectors.
    """
    w = Window.partitionBy("v").orderBy("id")
    rows = usable(vectors, id_col, vec_col)
    kind = rows.schema["id"].dataType.simpleString()
    few = rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k + 1)  # of equal vectors no query needs more
    classes = cut_lineage(few.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")))
    asked = usable(queries, id_col, vec_col)
    asked = cut_lineage(asked.withColumn("q", F.xxhash64("v")))
    index = fit(classes, k, tables=tables, success=success)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, at, unit in _unit(batch.column(0).to_pylist()):
                part = batch.take(pa.array(at))
                for t in range(index.tables):
                    keys = index.keys(np.floor(index.projected(unit, t)), t, dim)
                    yield pa.RecordBatch.from_arrays([pa.array(keys), part.column(0), part.column(1)], names=["bucket", "v", "ids"])

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, at, unit in _unit(batch.column(1).to_pylist()):
                q = batch.column(0).take(pa.array(at)).to_numpy()
                for t in range(index.tables):
                    for lo in range(0, len(at), QUERY_ROWS):
                        keys = [np.unique(index.keys(index.probes(p), t, dim)) for p in index.projected(unit[lo : lo + QUERY_ROWS], t)]
                        visitors = np.repeat(q[lo : lo + QUERY_ROWS], [len(x) for x in keys])
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(visitors)], names=["bucket", "q"])

    def rank(asked: pa.Table, held: pa.Table) -> pa.Table:
        a_rows, b_rows = [], []
        if asked.num_rows and held.num_rows:
            by_dim = {dim: (at, unit) for dim, at, unit in _unit(held.column("v").to_pylist())}
            for dim, q_at, q_unit in _unit(asked.column("v").to_pylist()):
                if dim not in by_dim:
                    continue
                at, unit = by_dim[dim]
                for lo in range(0, len(q_at), QUERY_ROWS):
                    scores = q_unit[lo : lo + QUERY_ROWS] @ unit.T
                    keep = min(k + 1, scores.shape[1])
                    least = np.partition(scores, -keep, axis=1)[:, -keep]
                    i, j = np.nonzero(scores >= least[:, None] - 1e-12)
                    a_rows.append(q_at[lo + i])
                    b_rows.append(at[j])
        a, b = (pa.array(np.concatenate(x) if x else np.zeros(0, np.int64)) for x in (a_rows, b_rows))
        left, right = asked.select(["q", "v"]).take(a), held.select(["v", "ids"]).take(b)
        columns = [left.column(0), left.column(1), right.column(0), right.column(1)]
        return pa.table([c.cast(pa.list_(c.type.value_type)) if pa.types.is_list(c.type) else c for c in columns], names=["q", "a", "b", "ids"])

    wanted = asked.select("q", "v").dropDuplicates(["v"])
    best = Window.partitionBy("q").orderBy(F.desc("score"), id_col)

    def nearest(visitors: DataFrame, stored: DataFrame) -> DataFrame:
        """(q, id, score): of the blocks that each visitor (bucket, q) meets in its buckets the nearest k + 1 ids.

        Visits of buckets that hold nothing fall out before the queries' vectors are joined to the rest.
        """
        blocks = stored.groupBy("bucket").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks"))
        groups = visitors.groupBy("bucket").agg(F.ceil(F.count("*") / ASKED_ROWS).cast("int").alias("groups"))
        deal = cut_lineage(blocks.join(groups, "bucket"))
        part = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
        each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        held = stored.join(deal, "bucket").withColumn("block", part("v", "blocks")).select("bucket", "block", each("groups").alias("group"), "v", "ids")
        asking = visitors.join(deal, "bucket").withColumn("group", part("q", "groups")).select("bucket", each("blocks").alias("block"), "group", "q").join(wanted, "q")
        keys = ("bucket", "block", "group")
        near = asking.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInArrow(rank, f"q long, a array<double>, b array<double>, ids array<{kind}>")
        dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, r: p * r), F.lit(0.0), lambda s, p: s + p)
        scored = near.select("q", "ids", (dot(F.col("a"), F.col("b")) / (F.sqrt(dot(F.col("a"), F.col("a"))) * F.sqrt(dot(F.col("b"), F.col("b"))))).alias("score"))
        scored = scored.select("q", F.explode("ids").alias(id_col), "score").distinct()
        return scored.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= k + 1).drop("_n")

    got = cut_lineage(nearest(wanted.mapInArrow(visits, "bucket long, q long"), classes.select("v", "ids").mapInArrow(hashed, f"bucket long, v array<double>, ids array<{kind}>")))
    short = wanted.join(got.groupBy("q").agg(F.count("*").alias("_n")), "q", "left").where(F.coalesce("_n", F.lit(0)) < k + 1).select("q", "v")
    short = cut_lineage(short)
    if not short.isEmpty():
        one = F.size("v").cast("long").alias("bucket")  # all vectors of a dimension
        got = got.join(short.select("q"), "q", "left_anti").unionByName(nearest(short.select(one, "q"), classes.select(one, "v", "ids")))
    mine = Window.partitionBy("query_id", "v").orderBy(F.desc("score"), id_col)
    merged = asked.select(F.col("id").alias("query_id"), "q", "v").join(got, "q").where(F.col("query_id") != F.col(id_col))
    return merged.withColumn("rank", F.row_number().over(mine)).where(F.col("rank") <= k).select("query_id", "rank", id_col, "score")
