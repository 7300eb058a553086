"""Spectra, lags, stationarity and resampling of long series by aggregation: no series is gathered whole.

Series are long tables (keys, index from 0, value). A Fourier sum is a grouped sum over each sample's windows and frequencies,
added up where the samples are, so one very long series spreads over the cluster like many short ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Five-per-cent limits of the unit-root test with a constant and of the test for level stationarity.
UNIT_ROOT_LIMIT, LEVEL_LIMIT = -2.86, 0.463


def short_time_power(df: DataFrame, keys: list[str], size: int, hop: int, value: str = "value", index: str = "t_idx") -> DataFrame:
    """(keys, window, bin, power): squared Hann-windowed Fourier sums of each full window of size samples that starts at a multiple of hop."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    first = F.greatest(F.lit(0), F.ceil((F.col(index) - size + 1) / hop).cast("int"))
    last = F.least(F.floor(F.col(index) / hop), F.floor((F.col("_n") - size) / hop)).cast("int")
    rows = df.withColumn("_n", n).where(F.col("_n") >= size).withColumn("_f", first).withColumn("_l", last).where("_f <= _l")
    rows = rows.select(*keys, index, value, F.explode(F.sequence("_f", "_l")).alias("window")).withColumn("_j", F.col(index) - F.col("window") * hop)
    taper = 0.5 - 0.5 * F.cos(2 * F.pi() * F.col("_j") / size)
    rows = rows.withColumn("_x", F.col(value) * taper).withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(size // 2))))
    angle = 2 * F.pi() * F.col("_j") * F.col("bin") / size
    sums = rows.groupBy(*keys, "window", "bin").agg(F.sum(F.col("_x") * F.cos(angle)).alias("_re"), F.sum(F.col("_x") * F.sin(angle)).alias("_im"))
    return sums.select(*keys, "window", "bin", (F.col("_re") * F.col("_re") + F.col("_im") * F.col("_im")).alias("power"))


def transients(power: DataFrame, keys: list[str], ratio: float = 6.0) -> DataFrame:
    """power whose ratio to its frequency's median over the windows of the series is above ratio."""
    mid = power.groupBy(*keys, "bin").agg(F.median("power").alias("_mid"))
    return power.join(mid, [*keys, "bin"]).withColumn("ratio", F.col("power") / (F.col("_mid") + 1e-12)).where(F.col("ratio") > ratio).drop("_mid")


def spectral_entropy(power: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: entropy of the mean spectrum over its logarithm, 1 for an even one (the constant aside)."""
    mean = power.where("bin > 0").groupBy(*keys, "bin").agg(F.avg("power").alias("_p"))
    share = F.col("_p") / F.sum("_p").over(Window.partitionBy(*keys))
    w = mean.withColumn("_s", share).where("_s > 0")
    return w.groupBy(*keys).agg((-F.sum(F.col("_s") * F.ln("_s")) / F.ln(F.count(F.lit(1)) + 1e-12)).alias("entropy"))


def lag_correlation(df: DataFrame, keys: list[str], a: Column, b: Column, most: int, index: str = "t_idx") -> DataFrame:
    """(keys, lag, r): correlation of a with b lag samples later, for lags up to most on either side, and which lag is strongest."""
    left = df.select(*keys, F.col(index).alias("_i"), a.alias("_a"), F.explode(F.sequence(F.lit(-most), F.lit(most))).alias("lag")).withColumn("_k", F.col("_i") + F.col("lag"))
    right = df.select(*keys, F.col(index).alias("_k"), b.alias("_b"))
    r = left.join(right, [*keys, "_k"]).groupBy(*keys, "lag").agg(F.count(F.col("_a") + F.col("_b")).alias("n"), F.corr("_a", "_b").alias("r")).where("n >= 4 AND r IS NOT NULL AND NOT isnan(r)")
    best = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(F.round(F.abs("r"), 9)), F.abs("lag"), "lag")) == 1
    return r.withColumn("strongest", best)


def stationarity(df: DataFrame, keys: list[str], value: str = "value", index: str = "t_idx", least: int = 8) -> DataFrame:
    """Per key: unit-root statistic (without lags), level-stationarity statistic (without lags), and whether both speak for a stationary series."""
    w = Window.partitionBy(*keys).orderBy(index)
    rows = df.withColumn("_lag", F.lag(value).over(w)).withColumn("_d", F.col(value) - F.col("_lag"))
    mean = F.avg(value).over(Window.partitionBy(*keys))
    rows = rows.withColumn("_e", F.col(value) - mean).withColumn("_s", F.sum("_e").over(w))
    x, y = F.when(F.col("_d").isNotNull(), F.col("_lag")), F.col("_d")
    g = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.regr_slope(y, x).alias("_g"),
        F.regr_sxx(y, x).alias("_sxx"),
        F.regr_syy(y, x).alias("_syy"),
        F.regr_sxy(y, x).alias("_sxy"),
        F.sum(F.col("_s") * F.col("_s")).alias("_ss"),
        F.sum(F.col("_e") * F.col("_e")).alias("_ee"),
    ).where(F.col("n") >= least)
    rss = F.greatest(F.col("_syy") - F.col("_g") * F.col("_sxy"), F.lit(1e-12))
    unit = F.col("_g") / F.sqrt(rss / (F.col("n") - 3) / F.greatest(F.col("_sxx"), F.lit(1e-12)))
    level = F.col("_ss") / (F.col("n") * F.greatest(F.col("_ee"), F.lit(1e-12)))
    return g.select(*keys, "n", unit.alias("unit_root"), level.alias("level"), ((unit < UNIT_ROOT_LIMIT) & (level < LEVEL_LIMIT)).alias("stationary"))


def resampled(df: DataFrame, keys: list[str], size: int, value: str = "value", index: str = "t_idx") -> DataFrame:
    """(keys, j, x): size points evenly over each series (two samples or more) by linear interpolation, then centred and scaled to deviation one."""
    n = df.groupBy(*keys).agg((F.max(index) + 1).alias("_n")).where("_n >= 2")
    at = F.col("j") * (F.col("_n") - 1) / F.lit(float(size - 1))
    grid = n.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(size - 1)))).withColumn("_at", at).withColumn("_lo", F.least(F.floor(F.col("_at") + 1e-9), F.col("_n") - 2).cast("long"))
    lo = df.select(*keys, F.col(index).cast("long").alias("_lo"), F.col(value).alias("_a"))
    hi = df.select(*keys, (F.col(index).cast("long") - 1).alias("_lo"), F.col(value).alias("_b"))
    x = grid.join(lo, [*keys, "_lo"]).join(hi, [*keys, "_lo"]).withColumn("_x", F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("_at") - F.col("_lo")))
    w = Window.partitionBy(*keys)
    std = F.stddev_pop("_x").over(w)
    return x.select(*keys, "j", ((F.col("_x") - F.avg("_x").over(w)) / F.when(std < 1e-12, 1.0).otherwise(std)).alias("x"))


def three_phase(df: DataFrame, keys: list[str], phases: tuple[str, str, str]) -> DataFrame:
    """Per key: root mean square of each phase and of all, and their imbalance (largest distance from the mean over the mean)."""
    g = df.groupBy(*keys).agg(*[F.sqrt(F.avg(F.col(p) * F.col(p))).alias(f"rms_{p}") for p in phases])
    mean = sum((F.col(f"rms_{p}") for p in phases[1:]), F.col(f"rms_{phases[0]}")) / len(phases)
    g = g.withColumn("rms", mean)
    return g.withColumn("imbalance", F.greatest(*[F.abs(F.col(f"rms_{p}") - F.col("rms")) for p in phases]) / (F.col("rms") + 1e-12))


def sequence_ratios(phasors: DataFrame, keys: list[str]) -> DataFrame:
    """Per key of three phasors (ra, ia, rb, ib, rc, ic): size of the positive sequence, and the negative and zero ones over it, with the verdict on the phases' order."""
    c, s = -0.5, 3**0.5 / 2  # a third of a turn
    turn = lambda r, i, k: (r * c - i * (s * k), r * (s * k) + i * c)
    col = F.col
    out = {}
    for name, kb, kc in (("positive", 1, -1), ("negative", -1, 1), ("zero", 0, 0)):
        b = turn(col("rb"), col("ib"), kb) if kb else (col("rb"), col("ib"))
        d = turn(col("rc"), col("ic"), kc) if kc else (col("rc"), col("ic"))
        re, im = (col("ra") + b[0] + d[0]) / 3, (col("ia") + b[1] + d[1]) / 3
        out[name] = F.sqrt(re * re + im * im)
    g = phasors.select(*keys, *[v.alias(k) for k, v in out.items()])
    ratio = lambda x: col(x) / (col("positive") + 1e-12)
    verdict = F.when(ratio("negative") <= 0.1, "right").when(ratio("negative") >= 0.5, "swapped").otherwise("unclear")
    return g.select(*keys, "positive", ratio("negative").alias("negative_ratio"), ratio("zero").alias("zero_ratio"), verdict.alias("order"))


def lag_vectors(df: DataFrame, keys: list[str], columns: list[str], lags: int, index: str = "t_idx") -> DataFrame:
    """(keys, index, v): each row's columns and those of the lags rows before it, where all are there."""
    w = Window.partitionBy(*keys).orderBy(index)
    parts = [F.lag(c, k).over(w) for k in range(lags + 1) for c in columns]
    return df.select(*keys, index, F.array(*parts).alias("v")).where(F.forall("v", lambda x: x.isNotNull()))
