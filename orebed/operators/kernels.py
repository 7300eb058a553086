"""Numeric kernels per series: spectra, filters, monitoring models, change detection, causality.

Each kernel is numpy on one series or window, which a grouped map runs where Spark has
gathered that key; series are bounded recordings, and collections of them spread over the cluster.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def per_series(df: DataFrame, keys: list[str], order: str, columns: list[str], kernel: Callable[[np.ndarray], dict[str, list]], schema: str) -> DataFrame:
    """kernel(matrix of columns in order) -> columns of schema, for each key; NaN and nulls arrive as NaN."""
    key_types = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        x = part.sort_values(order)[columns].to_numpy(dtype=float)
        out = pd.DataFrame(kernel(x))
        for k, v in reversed(list(zip(keys, key, strict=True))):
            out.insert(0, k, v)
        return out

    return df.select(*keys, order, *columns).groupBy(*keys).applyInPandas(run, f"{key_types}, {schema}")


def filled(x: np.ndarray) -> np.ndarray:
    """NaN replaced by the column's median (0 if there is none)."""
    x = np.array(x, dtype=float)
    flat = x if x.ndim == 2 else x[:, None]
    for j in range(flat.shape[1]):
        good = np.isfinite(flat[:, j])
        flat[~good, j] = np.median(flat[good, j]) if good.any() else 0.0
    return flat if x.ndim == 2 else flat[:, 0]


def welch(x: np.ndarray, fs: float, size: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """(frequencies, density): mean periodogram of half-overlapping Hann windows, constant removed."""
    size = min(size, len(x))
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)
    starts = range(0, len(x) - size + 1, max(1, size // 2))
    p = np.mean([np.abs(np.fft.rfft((x[s : s + size] - x[s : s + size].mean()) * w)) ** 2 for s in starts], axis=0) / (fs * (w**2).sum())
    p[1 : -1 if size % 2 == 0 else None] *= 2
    return np.fft.rfftfreq(size, 1 / fs), p


def peaks(values: np.ndarray) -> np.ndarray:
    """Places higher than what stands before and behind, the middle of level tops."""
    out, i = [], 1
    while i < len(values) - 1:
        if values[i] > values[i - 1]:
            j = i
            while j + 1 < len(values) and values[j + 1] == values[i]:
                j += 1
            if j + 1 < len(values) and values[j + 1] < values[i]:
                out.append((i + j) // 2)
            i = j
        i += 1
    return np.array(out, dtype=int)


def analytic(x: np.ndarray) -> np.ndarray:
    """The analytic signal, by suppressing negative frequencies."""
    n = len(x)
    gain = np.zeros(n)
    gain[0] = 1
    gain[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        gain[n // 2] = 1
    return np.fft.ifft(np.fft.fft(x) * gain)


def envelope_spectrum(x: np.ndarray, fs: float) -> tuple[np.ndarray, np.ndarray]:
    """(frequencies, power) of the Hann-windowed, centred envelope."""
    e = np.abs(analytic(x - x.mean()))
    e = (e - e.mean()) * np.hanning(len(e))
    return np.fft.rfftfreq(len(e), 1 / fs), np.abs(np.fft.rfft(e)) ** 2


def spectral_kurtosis(x: np.ndarray, size: int) -> np.ndarray:
    """Kurtosis over time of each frequency of a short-time transform, less 2."""
    w = np.hanning(size)
    s = np.array([np.abs(np.fft.rfft(x[i : i + size] * w)) ** 2 for i in range(0, len(x) - size + 1, size // 2)])
    return (s**2).mean(axis=0) / np.maximum(s.mean(axis=0) ** 2, 1e-30) - 2


def bandpass(x: np.ndarray, fs: float, low: float, high: float, order: int = 4) -> np.ndarray:
    """Zero-phase Butterworth band-pass: its squared gain in the frequency domain, with mirrored ends."""
    pad = min(len(x) - 1, 3 * (2 * order + 1))
    y = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]]) if pad > 0 else x
    gain = band_gain(np.fft.rfftfreq(len(y), 1 / fs), fs, low, high, order)
    return np.fft.irfft(np.fft.rfft(y) * gain, len(y))[pad : pad + len(x)]


def band_gain(f: np.ndarray, fs: float, low: float, high: float, order: int) -> np.ndarray:
    """Squared gain of a Butterworth band-pass at frequencies f."""
    warp = lambda v: np.tan(np.pi * np.minimum(v, fs / 2 * (1 - 1e-9)) / fs)
    a, b = warp(low), warp(high)
    with np.errstate(divide="ignore", invalid="ignore"):
        s = (warp(f) ** 2 - a * b) / (warp(f) * (b - a))
        return np.where(f > 0, 1 / (1 + s ** (2 * order)), 0.0)


# The low-pass taps of the Daubechies wavelet with four vanishing moments.
DB4 = (-0.010597401785069032, 0.0328830116668852, 0.030841381835560764, -0.18703481171909309, -0.027983769416859854, 0.6308807679298589, 0.7148465705529157, 0.2303778133088965)


def wavelet_denoise(x: np.ndarray, levels: int = 3) -> np.ndarray:
    """Periodic db4 transform, details shrunk by the universal threshold (noise from the finest), and back."""
    step = 1 << levels
    y = np.concatenate([x, x[::-1][: -len(x) % step]]) if len(x) % step else x.copy()
    if len(y) % step:
        return x.copy()
    return wavelet_shrunk(y, levels)[: len(x)]


def high_pass() -> np.ndarray:
    """The wavelet's high-pass taps."""
    return np.array(DB4)[::-1] * (-1.0) ** np.arange(len(DB4))


def wavelet_shrunk(y: np.ndarray, levels: int, cut: float | None = None) -> np.ndarray:
    """A periodic db4 transform of a multiple of 2**levels values, its details shrunk by cut (the universal threshold if None), and back."""
    lo, hi, n = np.array(DB4), high_pass(), len(y)
    details = []
    for _ in range(levels):
        at = (2 * np.arange(len(y) // 2)[:, None] + np.arange(len(lo))) % len(y)
        details.append(y[at] @ hi)
        y = y[at] @ lo
    cut = np.median(np.abs(details[0])) / 0.6745 * np.sqrt(2 * np.log(n)) if cut is None else cut
    for d in reversed(details):
        d = np.sign(d) * np.maximum(np.abs(d) - cut, 0)
        out = np.zeros(2 * len(y))
        at = (2 * np.arange(len(y))[:, None] + np.arange(len(lo))) % len(out)
        np.add.at(out, at, y[:, None] * lo + d[:, None] * hi)
        y = out
    return y


def cusum(z: np.ndarray, drift: float, threshold: float, p: float = 0.0, n: float = 0.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(positive, negative, alarm): one-sided sums from p and n on, that start again after an alarm."""
    pos, neg, alarm = np.zeros(len(z)), np.zeros(len(z)), np.zeros(len(z), bool)
    for i, v in enumerate(z):
        p, n = max(0.0, p + v - drift), max(0.0, n - v - drift)
        pos[i], neg[i], alarm[i] = p, n, p > threshold or n > threshold
        if alarm[i]:
            p = n = 0.0
    return pos, neg, alarm


def contrasts(x: np.ndarray, size: int) -> np.ndarray:
    """For each place the contrast of the medians of size values on each side in pooled robust scales; 0 where a side is short."""
    scores = np.zeros(len(x))
    for i in range(size, len(x) - size + 1):
        a, b = x[i - size : i], x[i : i + size]
        pooled = np.concatenate([a - np.median(a), b - np.median(b)])
        scale = 1.4826 * np.median(np.abs(pooled))
        scores[i] = abs(np.median(b) - np.median(a)) / (scale if scale > 1e-12 else max(float(pooled.std()), 1e-12))
    return scores


def change_points(x: np.ndarray, size: int, z: float) -> list[tuple[int, float]]:
    """(place, score): the strongest contrasts of z or more, none nearer than size to a stronger one."""
    scores = contrasts(x, size)
    taken: list[int] = []
    for i in np.lexsort((np.arange(len(x)), -scores)):
        if scores[i] < z:
            break
        if all(abs(int(i) - t) >= size for t in taken):
            taken.append(int(i))
    return sorted((i, float(scores[i])) for i in taken)


def granger(x: np.ndarray, y: np.ndarray, lags: int) -> float:
    """Smallest p of the F-tests that lags of x help to predict y, over 1 .. lags."""
    best = 1.0
    for lag in range(1, lags + 1):
        n = len(y) - lag
        if n - 2 * lag - 1 < 1:
            break
        target = y[lag:]
        own = np.column_stack([np.ones(n)] + [y[lag - i : len(y) - i] for i in range(1, lag + 1)])
        both = np.column_stack([own] + [x[lag - i : len(x) - i] for i in range(1, lag + 1)])
        rss = [float(((target - m @ np.linalg.lstsq(m, target, rcond=None)[0]) ** 2).sum()) for m in (own, both)]
        df = n - 2 * lag - 1
        f = max(0.0, (rss[0] - rss[1]) / lag / max(rss[1] / df, 1e-300))
        best = min(best, f_tail(f, lag, df))
    return best


def f_tail(f: float, d1: float, d2: float) -> float:
    """P(F > f), by the incomplete beta function's continued fraction."""
    from math import exp, lgamma, log

    x = d2 / (d2 + d1 * f)
    a, b = d2 / 2, d1 / 2
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log(1 - x))

    def fraction(a: float, b: float, x: float) -> float:
        c, d = 1.0, 1 - (a + b) * x / (a + 1)
        d = 1 / (d if abs(d) > 1e-300 else 1e-300)
        h = d
        for m in range(1, 300):
            for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d, c = 1 + num * d, 1 + num / c
                d, c = 1 / (d if abs(d) > 1e-300 else 1e-300), c if abs(c) > 1e-300 else 1e-300
                h *= d * c
            if abs(d * c - 1) < 1e-14:
                break
        return h

    return front * fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * fraction(b, a, 1 - x) / b


def moments(df: DataFrame, vec: str) -> tuple[int, np.ndarray, np.ndarray]:
    """(rows, mean, covariance) of an array column: partial sums by batch, added up by Spark; only d x d numbers reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.array(batch.column(0).to_pylist(), dtype=float)
            x = np.column_stack([np.ones(len(x)), x])
            s = x.T @ x
            i, j = np.indices(s.shape)
            yield pa.RecordBatch.from_arrays([pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(s.ravel())], names=["i", "j", "s"])

    rows = df.where(F.col(vec).isNotNull()).select(vec).mapInArrow(run, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()
    if not rows:
        return 0, np.zeros(0), np.zeros((0, 0))
    d = max(r.i for r in rows) + 1
    s = np.zeros((d, d))
    for r in rows:
        s[r.i, r.j] = r.s
    n = s[0, 0]
    mean = s[0, 1:] / n
    return int(n), mean, (s[1:, 1:] - n * np.outer(mean, mean)) / max(n - 1, 1)


def components(cov: np.ndarray, variance: float) -> tuple[np.ndarray, np.ndarray]:
    """(axes, their variances): the principal components that make up this share of the variance."""
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values)
    values, vectors = np.maximum(values[order], 0), vectors[:, order]
    k = int(np.searchsorted(np.cumsum(values) / max(values.sum(), 1e-300), variance)) + 1
    return vectors[:, :k], np.maximum(values[:k], 1e-12)


def pca_monitor(df: DataFrame, reference: DataFrame, id_col: str, vec: str, variance: float = 0.95, alpha: float = 0.99) -> DataFrame:
    """(id, spe, t2, alarm): squared prediction error and Hotelling statistic against the reference's principal components; limits are its quantiles."""
    _, mean, cov = moments(reference, vec)
    axes, spread = components(cov, variance)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column(1).to_pylist(), dtype=float).reshape(batch.num_rows, len(mean)) - mean
            t = x @ axes
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(((x - t @ axes.T) ** 2).sum(axis=1)), pa.array((t**2 / spread).sum(axis=1))], names=[id_col, "spe", "t2"])

    score = lambda d: d.select(id_col, vec).mapInArrow(run, f"`{id_col}` {d.schema[id_col].dataType.simpleString()}, spe double, t2 double")
    limits = score(reference).agg(F.percentile("spe", F.lit(alpha)).alias("_s"), F.percentile("t2", F.lit(alpha)).alias("_t"))
    return score(df).join(F.broadcast(limits)).select(id_col, "spe", "t2", ((F.col("spe") > F.col("_s")) | (F.col("t2") > F.col("_t"))).alias("alarm"))  # one row


def cva_monitor(x: np.ndarray, n_ref: int, past: int, k: int, alpha: float = 0.99) -> tuple[np.ndarray, np.ndarray]:
    """(t2, alarm) of a multichannel series: canonical variates between past and future blocks, trained on its first n_ref rows."""
    x = filled(x)
    mu, sd = x[:n_ref].mean(axis=0), x[:n_ref].std(axis=0)
    x = (x - mu) / np.where(sd < 1e-12, 1, sd)
    n = len(x)
    t2, alarm = np.full(n, np.nan), np.zeros(n, bool)
    block = lambda i: x[i - past : i].ravel()
    rows = range(past, n_ref - past)
    if len(rows) < 3:
        return t2, alarm
    both = np.array([np.concatenate([[1.0], x[i - past : i + past].ravel()]) for i in rows])
    mean, project = cva_model(both.T @ both, past * x.shape[1], k)
    for i in range(past, n):
        t2[i] = float(((project @ (block(i) - mean)) ** 2).sum())
    limit = np.quantile(t2[past:n_ref], alpha)
    alarm[past:] = t2[past:] > limit
    return t2, alarm


#: What a trained model of canonical variates is made of.
CVA_PARTS = ("fill", "center", "scale", "mean", "project", "limit")


def cva_trained(x: np.ndarray, past: int, k: int, alpha: float) -> dict[str, np.ndarray] | None:
    """The model that cva_monitor trains on reference rows x; None if they are too few."""
    if len(x) < 2 * past + 3:
        return None
    good = np.where(np.isfinite(x), x, np.nan)
    fill = np.array([np.median(c[np.isfinite(c)]) if np.isfinite(c).any() else 0.0 for c in good.T])
    x = np.where(np.isfinite(x), x, fill)
    center, sd = x.mean(axis=0), x.std(axis=0)
    scale = np.where(sd < 1e-12, 1, sd)
    x = (x - center) / scale
    both = np.array([np.concatenate([[1.0], x[i - past : i + past].ravel()]) for i in range(past, len(x) - past)])
    mean, project = cva_model(both.T @ both, past * x.shape[1], k)
    t2 = [float(((project @ (x[i - past : i].ravel() - mean)) ** 2).sum()) for i in range(past, len(x))]
    return dict(zip(CVA_PARTS, (fill, center, scale, mean, project, np.array([np.quantile(t2, alpha)])), strict=True))


def cva_model(sums: np.ndarray, width: int, k: int) -> tuple[np.ndarray, np.ndarray] | None:
    """(mean of past blocks, projection on k canonical variates) from the summed products of rows (1, past block, future block); None from under three rows."""
    n = sums[0, 0]
    if n < 3:
        return None
    mean = sums[0, 1:] / n
    cov = sums[1:, 1:] / n - np.outer(mean, mean)

    def white(a: np.ndarray) -> np.ndarray:
        v, u = np.linalg.eigh(a + 1e-6 * np.eye(len(a)))
        return u @ np.diag(np.maximum(v, 1e-12) ** -0.5) @ u.T

    wp, wf = white(cov[:width, :width]), white(cov[width:, width:])
    _, _, vt = np.linalg.svd(wf @ cov[width:, :width] @ wp)
    return mean[:width], vt[: min(k, len(vt))] @ wp


def hash_embedding(text: str | None, dim: int) -> list[float]:
    """Unit vector of signed hashed words and adjacent pairs (blake2b of eight bytes: bucket from four, sign from the fifth)."""
    import hashlib
    import re

    words = re.findall(r"[a-z0-9]+", (text or "").lower())
    out = np.zeros(dim)
    for w in words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]:
        d = hashlib.blake2b(w.encode(), digest_size=8).digest()
        out[int.from_bytes(d[:4], "little") % dim] += 1.0 if d[4] & 1 else -1.0
    norm = float(np.linalg.norm(out))
    return (out / (norm or 1.0)).tolist()


def embedded(docs: DataFrame, id_col: str, text: str, dim: int = 384) -> DataFrame:
    """(id, embedding): hash_embedding of each text, in Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([hash_embedding(t, dim) for t in batch.column(1).to_pylist()], pa.list_(pa.float64()))], names=[id_col, "embedding"])

    return docs.select(id_col, text).mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, embedding array<double>")


def packed_chunks(text: str | None, budget: int) -> list[tuple[int, int, int, str]]:
    """(index, start, end, chunk): paragraphs packed up to budget characters; a longer paragraph stands alone, in pieces."""
    out: list[tuple[int, int, int, str]] = []
    at, held, first = 0, "", 0
    for para in (text or "").split("\n"):
        pieces = [para[i : i + budget] for i in range(0, max(len(para), 1), budget)]
        for piece in pieces:
            if held and len(held) + 1 + len(piece) > budget:
                out.append((len(out), first, first + len(held), held))
                held = ""
            if not held:
                first, held = at, piece
            else:
                held += "\n" + piece
            at += len(piece)
        at += 1
    if held.strip():
        out.append((len(out), first, first + len(held), held))
    return [c for c in out if c[3].strip()]
