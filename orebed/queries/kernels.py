"""Numeric kernels over events, one series for each user, and over embeddings; where SQL can't express them, tests/test_kernels.py compares them with slow definitions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from orebed.operators import kernels as K
from orebed.operators import series as S
from orebed.queries.base import query, table
from orebed.queries.streams import cusum_sql

#: Samples a day that the event series are taken to have.
FS = 1.0
LEAST = 16


def _series(spark, sf_dir, kernel, schema):
    """kernel on the values of each user with enough of them."""

    def run(x: np.ndarray) -> dict[str, list]:
        x = K.filled(x[:, 0])
        return kernel(x) if len(x) >= LEAST else {c.split()[0]: [] for c in schema.split(", ")}

    rows = S.indexed(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"])
    return K.per_series(rows, ["user_id"], "t_idx", ["value"], run, schema)


USER_SERIES = """us AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, coalesce(value, median(value) OVER (PARTITION BY user_id), 0)::DOUBLE AS v, count(*) OVER (PARTITION BY user_id) AS n FROM events)"""


@query("welch_peaks", f"""WITH {USER_SERIES}, g AS (SELECT user_id, any_value(n) AS n, least(256, any_value(n)) AS size FROM us WHERE n >= 16 GROUP BY user_id), st AS (SELECT *, unnest(range(0, n - size + 1, greatest(1, size // 2))) AS s FROM g),
c AS (SELECT st.user_id, size, s, i - s AS j, v - avg(v) OVER (PARTITION BY st.user_id, s) AS x, 0.5 - 0.5 * cos(2 * pi() * (i - s) / size) AS w FROM st JOIN us ON us.user_id = st.user_id AND i >= s AND i < s + size),
p AS (SELECT user_id, size, s, k, sum(x * w * cos(2 * pi() * j * k / size)) AS re, sum(x * w * sin(2 * pi() * j * k / size)) AS im, sum(w * w) AS ww FROM c, (SELECT unnest(range(0, 129)) AS k) WHERE k <= size // 2 GROUP BY ALL),
d AS (SELECT user_id, k, k / any_value(size) AS frequency, avg((re * re + im * im) / ww) * CASE WHEN k = 0 OR (any_value(size) % 2 = 0 AND k = any_value(size) // 2) THEN 1 ELSE 2 END AS density FROM p GROUP BY user_id, k),
m AS (SELECT *, lag(density) OVER w AS a, lead(density) OVER w AS b FROM d WINDOW w AS (PARTITION BY user_id ORDER BY k))
SELECT user_id, (row_number() OVER (PARTITION BY user_id ORDER BY density DESC, k))::INT AS rank, frequency, density FROM m WHERE density > a AND density > b QUALIFY rank <= 3""", "frequency density")
def welch_peaks(spark, sf_dir):
    """The three strongest spectral peaks of each series."""

    def kernel(x):
        f, p = K.welch(x, FS)
        at = K.peaks(p)
        at = at[np.lexsort((at, -p[at]))][:3]
        return {"rank": list(range(1, len(at) + 1)), "frequency": f[at].tolist(), "density": p[at].tolist()}

    return _series(spark, sf_dir, kernel, "rank int, frequency double, density double")


@query("envelope_peaks")
def envelope_peaks(spark, sf_dir):
    """The strongest frequency of each series' envelope."""

    def kernel(x):
        f, p = K.envelope_spectrum(x - x.mean(), FS)
        at = int(np.argmax(p[1:])) + 1
        return {"frequency": [float(f[at])], "amplitude": [float(p[at])]}

    return _series(spark, sf_dir, kernel, "frequency double, amplitude double")


@query("spectral_kurtosis")
def spectral_kurtosis(spark, sf_dir):
    return _series(spark, sf_dir, lambda x: {"bin": list(range(len(k := K.spectral_kurtosis(x, 8)))), "kurtosis": [float(v) for v in k]}, "bin int, kurtosis double")


@query("bandpass_energy")
def bandpass_energy(spark, sf_dir):
    """Energy left of each series in a band."""
    return _series(spark, sf_dir, lambda x: {"energy": [float((K.bandpass(x - x.mean(), FS, 0.05, 0.25) ** 2).mean())]}, "energy double")


@query("wavelet_denoised")
def wavelet_denoised(spark, sf_dir):
    return _series(spark, sf_dir, lambda x: {"t_idx": list(range(len(x))), "smooth": [float(v) for v in K.wavelet_denoise(x, 2)]}, "t_idx int, smooth double")


@query("cusum_resetting", f"""WITH RECURSIVE {USER_SERIES}, zz AS (SELECT user_id, i, (v - avg(v) OVER (PARTITION BY user_id)) / greatest(stddev_pop(v) OVER (PARTITION BY user_id), 1e-12) AS z FROM us WHERE n >= 16), {cusum_sql("zz", "user_id", 0.5, 4.0)}
SELECT user_id, i::INT AS t_idx, pos, neg, alarm FROM r WHERE i >= 0""", "pos neg")
def cusum_resetting(spark, sf_dir):
    """One-sided sums of the standardised series that start again after an alarm."""

    def kernel(x):
        pos, neg, alarm = K.cusum((x - x.mean()) / max(float(x.std()), 1e-12), 0.5, 4.0)
        return {"t_idx": list(range(len(x))), "pos": pos.tolist(), "neg": neg.tolist(), "alarm": alarm.tolist()}

    return _series(spark, sf_dir, kernel, "t_idx int, pos double, neg double, alarm boolean")


@query("change_points")
def change_points(spark, sf_dir):
    def kernel(x):
        found = K.change_points(x, 5, 3.0)
        return {"t_idx": [i for i, _ in found], "score": [s for _, s in found]}

    return _series(spark, sf_dir, kernel, "t_idx int, score double")


def wide(spark, sf_dir):
    """Daily means of two event types beside each other for each user."""
    daily = table(spark, sf_dir, "events").groupBy("user_id", F.date_trunc("day", "ts").alias("day"))
    kinds = {"a": "event_type IN ('error', 'click')", "b": "event_type NOT IN ('error', 'click')"}
    return daily.agg(*[F.avg(F.when(F.expr(c), F.col("value"))).alias(k) for k, c in kinds.items()])


@query("granger_edges")
def granger_edges(spark, sf_dir):
    """The p-values of each user's channels predicting one another."""

    def run(x):
        x = K.filled(x)
        if len(x) < LEAST:
            return {"cause": [], "effect": [], "p_value": []}
        return {"cause": ["a", "b"], "effect": ["b", "a"], "p_value": [K.granger(x[:, 0], x[:, 1], 2), K.granger(x[:, 1], x[:, 0], 2)]}

    return K.per_series(wide(spark, sf_dir), ["user_id"], "day", ["a", "b"], run, "cause string, effect string, p_value double")


@query("cva_monitoring")
def cva_monitoring(spark, sf_dir):
    def run(x):
        if len(x) < LEAST:
            return {"t_idx": [], "t2": [], "alarm": []}
        t2, alarm = K.cva_monitor(x, len(x) * 2 // 3, 2, 2)
        return {"t_idx": list(range(len(x))), "t2": [None if np.isnan(v) else float(v) for v in t2], "alarm": alarm.tolist()}

    return K.per_series(wide(spark, sf_dir), ["user_id"], "day", ["a", "b"], run, "t_idx int, t2 double, alarm boolean")


@query("pca_monitoring")
def pca_monitoring(spark, sf_dir):
    """Embeddings against the principal components of every fourth of them, complete vectors only."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    fine = vectors.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & (F.size("v") > 0))
    return K.pca_monitor(fine, fine.where("vec_id % 4 = 0"), "vec_id", "v")


@query("hash_embeddings")
def hash_embeddings(spark, sf_dir):
    """Feature-hash vectors of all documents."""
    return K.embedded(table(spark, sf_dir, "documents"), "doc_id", "text", 64)


@query("packed_chunks")
def packed_chunks(spark, sf_dir):
    """Paragraphs of every document packed up to 800 characters."""
    @F.pandas_udf("array<struct<idx:int,start:int,end:int,chunk:string>>")
    def chunks(text: pd.Series) -> pd.Series:
        return text.map(lambda t: [{"idx": i, "start": s, "end": e, "chunk": c} for i, s, e, c in K.packed_chunks(t, 800)])

    return table(spark, sf_dir, "documents").select("doc_id", F.explode(chunks("text")).alias("c")).select("doc_id", "c.*")
