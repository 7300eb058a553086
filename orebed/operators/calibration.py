"""Calibration of monitoring on healthy rows: every setting of a grid judged from one pass of run lengths."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orebed.operators import kernels as K
from orebed.operators.decisions import run_places
from orebed.operators.longseries import BLOCK, placed, settled

ALPHAS, PERSISTENCES, TARGET, FRACTION = (0.99, 0.995, 0.9975, 0.999, 0.9995), (1, 2, 3, 5), 0.05, 0.35


def quantiles(rows: DataFrame, value: str, qs: tuple[float, ...]) -> list[float]:
    """Linearly interpolated quantiles of all rows' values: two rows for each are picked by their places."""
    at = placed(rows.select(F.lit(0).alias("_all"), value, F.monotonically_increasing_id().alias("_tie")), ["_all"], [value, "_tie"], [value])
    n = at.count()
    wanted = sorted({int(p) for q in qs for p in (np.floor(q * (n - 1)), np.ceil(q * (n - 1)))})
    known = {r.t_idx: r[value] for r in at.where(F.col("t_idx").isin(wanted)).collect()}
    return [known[int(np.floor(p))] + (known[int(np.ceil(p))] - known[int(np.floor(p))]) * (p - np.floor(p)) for p in (q * (n - 1) for q in qs)]


def calibrated_monitoring(df: DataFrame, order: list[str], vec: str, variance: float = 0.95, target: float = TARGET, fraction: float = FRACTION, alphas: tuple[float, ...] = ALPHAS, persistences: tuple[int, ...] = PERSISTENCES, size: int = BLOCK) -> DataFrame:
    """(alpha, min_consecutive, far, chosen): the false-alarm rate of every setting of component monitoring on held-out healthy rows, and the one that is taken.

    Components and limits come from the first rows, rates from the last `fraction` of them (15 to 50 %). A row alarms if a statistic is over its limit at alpha and so were the
    rows before it, min_consecutive in all: the places in runs over each alpha's limits give the rates of all persistences at once. Taken is the setting nearest to the
    target from below, else the lowest rate; then the smaller persistence, then the earlier setting. Fewer than 40 rows are an error.
    """
    rows = placed(df.where(F.col(vec).isNotNull()).withColumn("_all", F.lit(0)), ["_all"], order, [vec])
    n = rows.count()
    if n < 40:
        raise ValueError("at least 40 healthy rows are needed")
    split = min(max(20, round(n * (1 - min(max(fraction, 0.15), 0.5)))), n - 10)
    _, mean, cov = K.moments(rows.where(F.col("t_idx") < split), vec)
    axes, spread = K.components(cov, variance)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column(1).to_pylist(), dtype=float).reshape(batch.num_rows, len(mean)) - mean
            t = x @ axes
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(((x - t @ axes.T) ** 2).sum(axis=1)), pa.array((t**2 / spread).sum(axis=1))], names=["t_idx", "spe", "t2"])

    scored = settled(rows.select("t_idx", vec).mapInArrow(run, "t_idx long, spe double, t2 double"))
    healthy = scored.where(F.col("t_idx") < split)
    limits = list(zip(alphas, quantiles(healthy, "spe", alphas), quantiles(healthy, "t2", alphas), strict=True))
    levels = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(a).alias("alpha"), F.lit(float(s)).alias("s"), F.lit(float(t)).alias("t")) for i, (a, s, t) in enumerate(limits)])
    judged = scored.where(F.col("t_idx") >= split).select((F.col("t_idx") - split).alias("t_idx"), "spe", "t2", F.explode(levels).alias("_l")).select("t_idx", "_l.*", ((F.col("spe") > F.col("_l.s")) | (F.col("t2") > F.col("_l.t"))).alias("over"))
    places = run_places(judged, ["i", "alpha"], {"place": F.col("over")}, size)
    rates = places.groupBy("i", "alpha").agg(*[F.avg((F.col("place") >= max(1, p)).cast("double")).alias(f"_{j}") for j, p in enumerate(persistences)])
    trials = rates.select("i", "alpha", F.explode(F.array(*[F.struct(F.lit(j).alias("j"), F.lit(p).alias("min_consecutive"), F.col(f"_{j}").alias("far")) for j, p in enumerate(persistences)])).alias("_t")).select("i", "alpha", "_t.*")
    over = F.col("far") > target
    best = Window.orderBy(over, F.when(over, F.col("far")).otherwise(F.abs(F.col("far") - target)), "min_consecutive", "i", "j")  # a row for each setting
    return trials.withColumn("chosen", F.row_number().over(best) == 1).select("alpha", "min_consecutive", "far", "chosen")


def poisson_draw(*parts: str) -> F.Column:
    """A Poisson(1) number that the columns' hash decides."""
    u = uniform(*parts)
    return sum((F.when(u > s, 1).otherwise(0) for s in poisson_steps()), F.lit(0))


def uniform(*parts: str | F.Column) -> F.Column:
    """A number between 0 and 1 that the columns' hash decides."""
    return (F.pmod(F.xxhash64(*parts), F.lit(1 << 52)) + F.lit(0.5)) / float(1 << 52)


def poisson_steps() -> list[float]:
    """What a uniform number must be over for each next Poisson(1) number."""
    steps, total, p = [], 0.0, float(np.exp(-1))
    for k in range(12):
        total += p
        p /= k + 1
        steps.append(total)
    return steps


def calibrated_limits(alarms: DataFrame, event: str, settings: list[str], flag: str, alarmed: str, total: str, target: float = 0.08, draws: int = 500, seed: int = 0) -> DataFrame:
    """(settings, far, far_low, far_high, sample_far, false_alarms, chosen) from a row (event, settings, flag, alarmed, total) for each event and setting.

    far is the share of healthy events with a decision, its interval the 2.5 and 97.5 % points of `draws` means under Poisson weights that event and draw hash to (no weights at all: 0). Of the settings that keep the
    target the loosest is taken: the largest far, then the smallest settings in order; if none does, the least far, then the largest settings. Weights are drawn for events with a decision only; the draws' totals are the same for all settings.
    """
    hit = F.col(flag).cast("double")
    alarms = settled(alarms)  # read several times below
    numbered = settled(alarms.select(*settings).distinct().withColumn("_i", (F.row_number().over(Window.orderBy(*settings)) - 1).cast("int")))  # a row for each setting
    n, steps = numbered.count(), poisson_steps()
    seeded = F.transform(F.sequence(F.lit(0), F.lit(draws - 1)), lambda d: uniform(event, d, F.lit(seed)))
    events = alarms.join(F.broadcast(numbered), settings, "left").groupBy(event).agg(F.collect_list(F.when(F.col(flag), F.col("_i"))).alias("_hit")).select("_hit", seeded.alias("_u"))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each draw's weights of all events (setting n) and of the events that each setting hits: products of two matrices, piece by piece."""
        sums = np.zeros((n + 1, draws))
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                w = np.searchsorted(steps, part.column(1).flatten().to_numpy()).reshape(-1, draws).astype(float)
                hits = np.zeros((part.num_rows, n + 1))
                np.add.at(hits, (np.repeat(np.arange(part.num_rows), part.column(0).value_lengths().to_numpy()), part.column(0).flatten().to_numpy()), 1)
                hits[:, n] = 1
                sums += hits.T @ w
        i, d = np.indices(sums.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel().astype(np.int32)), pa.array(d.ravel().astype(np.int32)), pa.array(sums.ravel().astype(np.int64))], names=["_i", "_draw", "_h"])

    drawn = events.mapInArrow(summed, "_i int, _draw int, _h long").groupBy("_i", "_draw").agg(F.sum("_h").alias("_h"))
    drawn = settled(drawn)  # a row for each setting and draw
    totals = drawn.where(F.col("_i") == n).select("_draw", F.col("_h").alias("_n"))
    means = drawn.join(F.broadcast(numbered), "_i").join(F.broadcast(totals), "_draw").select(*settings, F.when(F.col("_n") > 0, F.coalesce("_h", F.lit(0)) / F.col("_n")).otherwise(0.0).alias("_m"))
    spread = means.groupBy(*settings).agg(F.percentile("_m", F.lit(0.025)).alias("far_low"), F.percentile("_m", F.lit(0.975)).alias("far_high"))  # `draws` numbers of each setting
    rates = alarms.groupBy(*settings).agg(F.avg(hit).alias("far"), (F.sum(alarmed) / F.greatest(F.sum(total), F.lit(1))).alias("sample_far"), F.sum(F.col(flag).cast("long")).alias("false_alarms"))
    keeps = F.col("far") <= target
    passing = F.row_number().over(Window.orderBy(F.desc(keeps), F.when(keeps, -F.col("far")).otherwise(F.col("far")), *[F.when(keeps, F.col(s)).otherwise(-F.col(s)) for s in settings]))  # a row for each setting
    return rates.join(spread, settings).withColumn("chosen", passing == 1).select(*settings, "far", "far_low", "far_high", "sample_far", "false_alarms", "chosen")


SETTINGS = ["residual_threshold", "persistence", "cusum_drift", "cusum_threshold", "least_residual"]


def limit_trials(rows: DataFrame, event: str, z: str, residual_thresholds: tuple[float, ...], persistences: tuple[int, ...], cusum_drifts: tuple[float, ...], cusum_thresholds: tuple[float, ...], least_residuals: tuple[float, ...], least_run: int = 6, least_drift: float = 0.02) -> DataFrame:
    """(event, settings, detected, alarmed, total): what each setting makes of each healthy event (event, t_idx, z), by the rule of decisions.event_evidence.

    An event is one recording of one residual, which a task takes whole: its residual masks are made once for each threshold and persistence, its drift masks once for each pair of limits.
    """
    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        x = np.nan_to_num(part.sort_values("t_idx")[z].to_numpy(float))
        out = []
        masks = {(d, c): K.cusum(x, d, c)[2] for d in cusum_drifts for c in cusum_thresholds}
        drifts = {at: (mask, bool(mask.mean() >= least_drift)) for at, mask in masks.items()}
        for threshold in residual_thresholds:
            place = run_length(np.abs(x) > threshold)
            for persistence in persistences:
                residual = place >= max(1, persistence)
                share = residual.mean()
                for (drift, limit), (mask, drifted) in drifts.items():
                    both = drifted and int(run_length(residual & mask).max(initial=0)) >= max(1, least_run)
                    alarmed = int((residual | mask).sum())
                    out += [(key[0], threshold, persistence, drift, limit, least, both and share >= least, alarmed, len(x)) for least in least_residuals]
        return pd.DataFrame(out, columns=[event, *SETTINGS, "detected", "alarmed", "total"])

    kind = rows.schema[event].dataType.simpleString()
    return rows.select(event, "t_idx", z).groupBy(event).applyInPandas(run, f"`{event}` {kind}, residual_threshold double, persistence int, cusum_drift double, cusum_threshold double, least_residual double, detected boolean, alarmed long, total long")


def run_length(mask: np.ndarray) -> np.ndarray:
    """How many rows in a row the mask has held, at each row."""
    at = np.arange(len(mask))
    return np.where(mask, at - np.maximum.accumulate(np.where(mask, -1, at)), 0)
