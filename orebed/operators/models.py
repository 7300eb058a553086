"""Models that are fitted in tasks on bounded draws and score all rows: isolation forests, and behaviour models by regime and target."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orebed.operators.longseries import _types, placed, quantile_of, settled

_MASK = (1 << 64) - 1


def uniform(*parts: int) -> float:
    """A number in 0 .. 1 that the parts alone decide (splitmix64 over them)."""
    x = 0
    for p in parts:
        x = (x ^ (p & _MASK)) + 0x9E3779B97F4A7C15 & _MASK
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & _MASK
        x = (x ^ x >> 27) * 0x94D049BB133111EB & _MASK
        x ^= x >> 31
    return (x >> 11) / (1 << 53)


# Isolation forest -----------------------------------------------------------------------------------------------------


def path_left(n: np.ndarray | int) -> np.ndarray:
    """Mean depth of an unsuccessful search among n values."""
    n = np.asarray(n, dtype=float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def grown_tree(x: np.ndarray, seed: int, tree: int) -> list[tuple[int, float, int, int, float]]:
    """Nodes (column, cut, left, right, depth reached) of an isolation tree on x's rows: a random column that isn't constant and a random cut in its range, down to log2 of the rows.

    Leaves have column -1. The number of a node in the full tree decides what is random in it.
    """
    most, nodes = int(np.ceil(np.log2(max(len(x), 2)))), []

    def grow(rows: np.ndarray, depth: int, number: int) -> int:
        own = len(nodes)
        nodes.append((-1, 0.0, -1, -1, depth + float(path_left(len(rows)))))
        low, high = (rows.min(axis=0), rows.max(axis=0)) if len(rows) else (np.zeros(0), np.zeros(0))
        free = np.flatnonzero(low < high)
        if depth >= most or not len(free):
            return own
        column = int(free[int(uniform(seed, tree, number, 0) * len(free))])
        cut = float(low[column] + uniform(seed, tree, number, 1) * (high[column] - low[column]))
        goes = rows[:, column] <= cut
        left = grow(rows[goes], depth + 1, 2 * number)
        nodes[own] = (column, cut, left, grow(rows[~goes], depth + 1, 2 * number + 1), 0.0)
        return own

    grow(x, 0, 1)
    return nodes


def isolation_forest(df: DataFrame, ids: list[str], columns: list[str], trees: int = 100, sample: int = 256, contamination: float = 0.01, seed: int = 0) -> DataFrame:
    """(ids, score, alarm): isolation scores of all rows; alarms lie above the (1 - contamination) quantile of them.

    Each tree is grown in a task on the `sample` rows whose hash with the tree's number is least: rows are drawn in one pass, of which only those under a threshold
    that leaves about four times as many are ranked. What is broadcast are the trees' nodes, at most 2 * trees * sample. Missing or infinite values count as 0. Ids tell rows apart.
    """
    spark = df.sparkSession
    value = lambda c: F.when(~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) < float("inf")), F.col(c).cast("double"))
    rows = df.select(*ids, F.array(*[F.coalesce(value(c), F.lit(0.0)) for c in columns]).alias("_x"))
    n = rows.count()
    share = min(1.0, 4 * sample / max(n, 1) + 64 / max(n, 1))
    draw = lambda t: F.xxhash64(*ids, t, F.lit(seed).cast("long"))
    cut = -(1 << 63) + int(share * ((1 << 64) - 1))
    drawn = F.filter(F.sequence(F.lit(0).cast("long"), F.lit(trees - 1).cast("long")), lambda t: draw(t) <= F.lit(min(cut, (1 << 63) - 1)))
    candidates = rows.select(*ids, "_x", F.explode(drawn).alias("tree")).withColumn("_draw", draw(F.col("tree")))

    def grow(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        chosen = part.sort_values(["_draw", *ids]).head(sample)
        nodes = grown_tree(np.array(chosen["_x"].tolist(), dtype=float), seed, int(key[0]))
        return pd.DataFrame([(key[0], len(chosen), i, *node) for i, node in enumerate(nodes)], columns=["tree", "rows", "node", "column", "cut", "left", "right", "depth"])

    forest = candidates.groupBy("tree").applyInPandas(grow, "tree long, rows long, node long, column int, cut double, left long, right long, depth double")
    nodes = forest.orderBy("tree", "node").toPandas()  # 2 * trees * sample at most
    grown = [part[["column", "cut", "left", "right", "depth"]].to_numpy() for _, part in nodes.groupby("tree")]
    scale = float(path_left(int(nodes["rows"].max()))) if len(nodes) else 1.0
    shared = spark.sparkContext.broadcast(grown)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column("_x").to_pylist(), dtype=float).reshape(batch.num_rows, len(columns))
            total = np.zeros(len(x))
            for tree in shared.value:
                at = np.zeros(len(x), dtype=np.int64)
                while (inner := tree[at, 0] >= 0).any():
                    node = tree[at]
                    goes = x[np.arange(len(x)), np.maximum(node[:, 0], 0).astype(int)] <= node[:, 1]
                    at = np.where(inner, np.where(goes, node[:, 2], node[:, 3]).astype(np.int64), at)
                total += tree[at, 4]
            s = 2.0 ** -(total / max(len(shared.value), 1) / (scale or 1.0))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ids), pa.array(s)], names=[*ids, "score"])

    scored = settled(rows.mapInArrow(score, f"{_types(rows, ids)}, score double"))
    limit = quantile_of(scored.select(F.lit(0).alias("_all"), "score"), ["_all"], "score", 1 - contamination, "_limit").select("_limit")
    return scored.join(F.broadcast(limit)).select(*ids, "score", (F.col("score") > F.col("_limit")).alias("alarm"))  # one row


# Behaviour models -----------------------------------------------------------------------------------------------------

#: Rounds, learning rate, depth, bins of a column, ridge and least rows of a leaf.
ROUNDS, RATE, DEPTH, BINS, RIDGE, LEAST = 80, 0.1, 3, 64, 0.1, 20
#: Rows that a model is fitted on at most, evenly spread over the regime.
FIT_ROWS = 20_000
#: Rows under which a regime has no model of its own, and every how many-th row is held out for residual scales.
LEAST_REGIME, HELD = 30, 5
PREDICT_BLOCK = 1 << 14


def boosted(x: np.ndarray, y: np.ndarray) -> list[float]:
    """A boosted regressor on binned columns, as numbers: the mean, then for each round its splits' columns, its cuts and its leaves."""
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    binned = np.column_stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)])
    inner, model = (1 << DEPTH) - 1, [float(y.mean())]
    left = y - y.mean()
    for _ in range(ROUNDS):
        node, columns, cuts = np.zeros(len(y), dtype=np.int64), np.full(inner, -1.0), np.zeros(inner)
        for level in range(DEPTH):
            first = (1 << level) - 1
            best = np.full(1 << level, 1e-12)
            split = np.zeros((1 << level, 2), dtype=np.int64) - 1
            for j in range(x.shape[1]):
                shape = (1 << level, BINS + 1)
                at = (node - first) * (BINS + 1) + binned[:, j]
                s = np.bincount(at, left, shape[0] * shape[1]).reshape(shape).cumsum(axis=1)
                n = np.bincount(at, minlength=shape[0] * shape[1]).reshape(shape).cumsum(axis=1)
                rest_s, rest_n = s[:, -1:] - s, n[:, -1:] - n
                gain = s**2 / (n + RIDGE) + rest_s**2 / (rest_n + RIDGE) - s[:, -1:] ** 2 / (n[:, -1:] + RIDGE)
                gain[(n < LEAST) | (rest_n < LEAST)] = 0
                top = gain.argmax(axis=1)
                value = gain[np.arange(len(gain)), top]
                better = value > best + 1e-9 * np.abs(best)
                best[better] = value[better]
                split[better] = np.column_stack([np.full(better.sum(), j), top[better]])
            for k, (j, b) in enumerate(split):
                if j >= 0:
                    columns[first + k], cuts[first + k] = j, edges[j][b]
            node = _children(x, node, columns, cuts)
        leaf = node - inner
        n = np.bincount(leaf, minlength=inner + 1)
        leaves = RATE * np.bincount(leaf, left, inner + 1) / (n + RIDGE)
        left = left - leaves[leaf]
        model += [*columns.tolist(), *cuts.tolist(), *leaves.tolist()]
    return model


def _children(x: np.ndarray, node: np.ndarray, columns: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """The next level's nodes; where nothing is split all go left."""
    j = columns[node].astype(int)
    right = (j >= 0) & (x[np.arange(len(x)), np.maximum(j, 0)] > cuts[node])
    return 2 * node + 1 + right


def boosted_values(model: list[float], x: np.ndarray) -> np.ndarray:
    """What a boosted regressor expects for each row."""
    inner = (1 << DEPTH) - 1
    rounds = np.asarray(model[1:]).reshape(-1, 3 * inner + 1)
    out = np.full(len(x), model[0])
    for r in rounds:
        node = np.zeros(len(x), dtype=np.int64)
        for _ in range(DEPTH):
            node = _children(x, node, r[:inner], r[inner : 2 * inner])
        out += r[2 * inner :][node - inner]
    return out


def spread(place: str, n: str, most: int) -> F.Column:
    """Whether a place is one of `most` evenly spread ones of 0 .. n - 1."""
    j = f"ceil({place} * {most - 1}D / ({n} - 1))"
    return F.expr(f"{n} <= {most} OR floor({j} * ({n} - 1) / {most - 1}D) = {place}")


def behaviour_residuals(df: DataFrame, reference: str, regime: str, order: list[str], targets: list[str], predictors: list[str], fit_rows: int = FIT_ROWS) -> DataFrame:
    """(order, target, expected, residual, normalized) of every row and target: boosted models of normal behaviour by regime, fitted where `reference` holds.

    A target's predictors are the others. Every fifth row of a regime's reference is held out: models of the rest give its residuals, whose median and scaled deviation normalise
    (a regime's own from 8 of them on, else all regimes'); models of all reference rows give what is expected. Regimes with fewer than 30 reference rows take the
    model of all regimes. Each model is fitted by a task on at most fit_rows rows, evenly spread in order. Reference rows are sorted once for all targets; every row is
    scored where it stands, in blocks with its regime's models, so it keeps its order columns though they be null or shared. Rows without all predictors
    get nulls; a target that no reference row has gives none.
    """
    columns = list(dict.fromkeys([*targets, *predictors]))
    fine = lambda c: F.when(~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) < float("inf")), F.col(c).cast("double"))
    plain = df.select(*order, F.col(regime).cast("string").alias("_regime"), F.expr(reference).alias("_ref"), *[fine(c).alias(f"_c{i}") for i, c in enumerate(columns)])
    own = {t: [columns.index(c) for c in ([c for c in predictors if c != t] or predictors)] for t in targets}
    y = {t: F.col(f"_c{columns.index(t)}") for t in targets}
    known = {t: reduce(and_, [F.col(f"_c{i}").isNotNull() for i in own[t]]) for t in targets}
    values = [f"_c{i}" for i in range(len(columns))]

    # Reference rows in order, once for all targets: places are counts within a range partition on top of the earlier ones' counts.
    rows = plain.where("coalesce(_ref, false) AND _regime IS NOT NULL").select(*order, "_regime", *values)
    rows = settled(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()))
    for i, t in enumerate(targets):
        rows = rows.withColumn(f"_ok{i}", (y[t].isNotNull() & known[t]).cast("long"))
    flags = range(len(targets))
    ends = rows.groupBy("_regime", "_part").agg(*[F.sum(f"_ok{i}").alias(f"_o{i}") for i in flags])
    of_regime = Window.partitionBy("_regime")
    before = of_regime.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ends = settled(ends.select("_regime", "_part", *[c for i in flags for c in (F.sum(f"_o{i}").over(of_regime).alias(f"_n{i}"), F.coalesce(F.sum(f"_o{i}").over(before), F.lit(0)).alias(f"_b{i}"))]))
    earlier = Window.partitionBy("_part", "_regime").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.select("*", *[F.coalesce(F.sum(f"_ok{i}").over(earlier), F.lit(0)).alias(f"_l{i}") for i in flags]).join(ends, ["_part", "_regime"])
    for i in flags:
        held = (F.col(f"_ok{i}") == 1) & (F.col(f"_n{i}") >= 10) & ((F.col(f"_l{i}") + F.col(f"_b{i}")) % HELD == 0)
        rows = rows.withColumns({f"_p{i}": F.col(f"_l{i}") + F.col(f"_b{i}"), f"_held{i}": held}).withColumn(f"_r{i}", ((F.col(f"_ok{i}") == 1) & (F.col(f"_n{i}") >= 10) & ~F.col(f"_held{i}")).cast("long"))
    # Counts of all regimes together, and of those that are not held out: (part, before it, all) as few rows as there are partitions.
    counted = {f"{k}{i}": f"_{k}{i}" for i in flags for k in ("ok", "r")}
    rest = lambda i: F.when(F.col(f"_n{i}") >= 10, F.col(f"_o{i}") - (F.ceil((F.col(f"_b{i}") + F.col(f"_o{i}")) / HELD) - F.ceil(F.col(f"_b{i}") / HELD))).otherwise(0)
    sizes = ends.withColumns({f"_o{i}": F.coalesce(F.lead(f"_b{i}").over(of_regime.orderBy("_part")), F.col(f"_n{i}")) - F.col(f"_b{i}") for i in flags})
    sizes = sizes.groupBy("_part").agg(*[c for i in flags for c in (F.sum(f"_o{i}").alias(f"_sok{i}"), F.sum(rest(i)).alias(f"_sr{i}"))])
    everywhere = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = settled(sizes.select("_part", *[c for k in counted for c in (F.coalesce(F.sum(f"_s{k}").over(everywhere), F.lit(0)).alias(f"_before_{k}"), F.sum(f"_s{k}").over(Window.partitionBy()).alias(f"_all_{k}"))]))
    earlier = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.select("*", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_at_{k}") for k, c in counted.items()]).join(F.broadcast(sizes), "_part")

    uses = []
    for i, t in enumerate(targets):
        n_rest = f"(_n{i} - ceil(_n{i} / {HELD}))"
        places = {
            "full own": (f"_ok{i} = 1 AND _n{i} >= {LEAST_REGIME}", f"_p{i}", f"_n{i}"),
            "full all": (f"_ok{i} = 1", f"(_at_ok{i} + _before_ok{i})", f"_all_ok{i}"),
            "rest own": (f"_r{i} = 1 AND {n_rest} >= {LEAST_REGIME}", f"(_p{i} - floor(_p{i} / {HELD}) - 1)", n_rest),
            "rest all": (f"_r{i} = 1", f"(_at_r{i} + _before_r{i})", f"_all_r{i}"),
        }
        x = F.array(*[F.col(f"_c{j}") for j in own[t]])
        for kind, (where, place, n) in places.items():
            use = F.struct(F.lit(t).alias("target"), F.lit(kind).alias("_kind"), (F.col("_regime") if kind.endswith("own") else F.lit("")).alias("_scope"), F.expr(place).cast("long").alias("_place"), y[t].alias("_y"), x.alias("_x"))
            uses.append(F.when(F.expr(where) & spread(place, n, fit_rows), use))
        uses.append(F.when(F.col(f"_held{i}"), F.struct(F.lit(t).alias("target"), F.lit("held").alias("_kind"), F.col("_regime").alias("_scope"), F.lit(0).cast("long").alias("_place"), y[t].alias("_y"), x.alias("_x"))))
    drawn = settled(rows.select(F.explode(F.array_compact(F.array(*uses))).alias("_u")).select("_u.*"))

    def fit(k: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("_place")
        return pd.DataFrame({"target": [k[0]], "_kind": [k[1]], "_scope": [k[2]], "_model": [boosted(np.array(part["_x"].tolist()), part["_y"].to_numpy(float))]})

    models = settled(drawn.where("_kind != 'held'").groupBy("target", "_kind", "_scope").applyInPandas(fit, "target string, _kind string, _scope string, _model array<double>"))

    def models_of(kind: str, keys: DataFrame) -> DataFrame:
        """keys (target, _regime, ...) with the regime's own model, else that of all."""
        mine = models.where(F.col("_kind") == f"{kind} own").select("target", F.col("_scope").alias("_regime"), F.col("_model").alias("_own"))
        every = models.where(F.col("_kind") == f"{kind} all").select("target", F.col("_model").alias("_every"))
        return keys.join(mine, ["target", "_regime"], "left").join(every, "target", "left").withColumn("_model", F.coalesce("_own", "_every")).drop("_own", "_every")

    def in_blocks(rows: DataFrame, sizes: DataFrame, keys: list[str], salt: F.Column) -> tuple[DataFrame, DataFrame]:
        """rows, and sizes (keys, _n) once for each block, with _block: keys of more than PREDICT_BLOCK rows are dealt over several; of these there are few."""
        sizes = sizes.select(*[F.col(k).alias(k) for k in keys], F.ceil(F.col("_n") / PREDICT_BLOCK).alias("_blocks"))
        dealt = rows.join(F.broadcast(sizes.where("_blocks > 1").select(*keys, "_blocks")), keys, "left").withColumn("_block", F.pmod(salt, F.coalesce("_blocks", F.lit(1))).cast("long")).drop("_blocks")
        return dealt, sizes.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1))).drop("_blocks")

    def left_over(part: pa.Table, model: pa.Table) -> pa.Table:
        y, x = part.column("_y").to_numpy(), np.array(part.column("_x").to_pylist(), dtype=float)
        fitted = model.num_rows and model.column("_model")[0].as_py()
        r = pa.array(y - boosted_values(fitted, x)) if fitted and len(y) else pa.nulls(len(y), pa.float64())
        return pa.table({"target": part.column("target"), "_regime": part.column("_regime"), "r": r})

    held = drawn.where("_kind = 'held'").select("target", F.col("_scope").alias("_regime"), "_y", "_x", F.monotonically_increasing_id().alias("_id"))
    key = ["target", "_regime"]
    held, blocks = in_blocks(held, settled(held.groupBy(*key).agg(F.count("*").alias("_n"))), key, F.col("_id"))
    residuals = held.drop("_id").groupBy(*key, "_block").cogroup(models_of("rest", blocks).groupBy(*key, "_block")).applyInArrow(left_over, "target string, _regime string, r double")
    residuals = settled(residuals.where("r IS NOT NULL"))
    center, whole = centred(residuals, key, 8), centred(residuals, ["target"], 10).select("target", F.col("center").alias("_center"), F.col("scale").alias("_scale"))

    # Every row once, with all targets' models and scales of its regime; a regime that has none takes those of all.
    names = F.explode(F.array(*map(F.lit, targets)))
    plain = plain.select(*order, F.coalesce(F.concat(F.lit("r"), "_regime"), F.lit("none")).alias("_key"), *values)
    plain, blocks = in_blocks(plain, settled(plain.groupBy("_key").agg(F.count("*").alias("_n"))), ["_key"], F.xxhash64(*order))
    scales = models_of("full", blocks.withColumn("_regime", F.when(F.col("_key") != "none", F.substr("_key", F.lit(2)))).withColumn("target", names))
    scales = scales.join(center, key, "left").join(whole, "target", "left").select("_key", "_block", "target", "_model", F.coalesce("center", "_center", F.lit(0.0)).alias("center"), F.coalesce("scale", "_scale", F.lit(1.0)).alias("scale"))

    def score(part: pa.Table, model: pa.Table) -> pa.Table:
        at, out = {m["target"]: m for m in model.to_pylist()}, []
        x = np.column_stack([part.column(c).to_numpy().astype(float) for c in values])
        for t in targets:
            of = x[:, own[t]]
            fine, expected = ~np.isnan(of).any(axis=1), np.full(len(x), np.nan)
            if at[t]["_model"] and fine.any():
                expected[fine] = boosted_values(at[t]["_model"], of[fine])
            residual = x[:, columns.index(t)] - expected
            told = [pa.array(v, from_pandas=True) for v in (expected, residual, (residual - at[t]["center"]) / at[t]["scale"])]
            out.append(pa.table([*(part.column(c) for c in order), pa.array([t] * len(x), pa.string()), *told], names=[*order, "target", "expected", "residual", "normalized"]))
        return pa.concat_tables(out)

    dealt = plain.groupBy("_key", "_block").cogroup(scales.groupBy("_key", "_block"))
    return dealt.applyInArrow(score, f"{_types(df, order)}, target string, expected double, residual double, normalized double")


def centred(df: DataFrame, keys: list[str], least: int, value: str = "r") -> DataFrame:
    """(keys, center, scale): median and 1.4826 times the median absolute deviation (the deviation where that is zero, null where that is too) of at least `least` values."""
    mid = quantile_of(df, keys, value, 0.5, "center").join(df.groupBy(*keys).agg(F.count(value).alias("_n"), F.stddev_pop(value).alias("_std")), keys).where(F.col("_n") >= least)
    off = settled(df.join(mid, keys).withColumn("_off", F.abs(F.col(value) - F.col("center"))))
    mad = quantile_of(off, keys, "_off", 0.5, "_mad")
    scale = F.when(F.col("_mad") * 1.4826 >= 1e-12, F.col("_mad") * 1.4826).when(F.col("_std") >= 1e-12, F.col("_std"))
    return mid.join(mad, keys).select(*keys, "center", scale.alias("scale"))
