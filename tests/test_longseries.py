"""Kernels by blocks against the same kernels on whole series."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from orebed.operators import kernels as K
from orebed.operators import longseries as L

LENGTHS = {"hot": 701, "even": 128, "mid": 150, "few": 20, "tiny": 3, "one": 1}


@pytest.fixture(scope="module")
def values():
    rng = np.random.default_rng(5)
    out = {}
    for k, n in LENGTHS.items():
        x = rng.standard_normal(n).cumsum() * 0.1 + rng.standard_normal(n) + 3 * np.sin(np.arange(n) / 3)
        x[n // 2 :] += 8
        out[k] = x
    return out


@pytest.fixture(scope="module")
def rows(spark, values):
    """Dealt out of order, with times that tie within a series."""
    table = [(k, float(i // 2), i, float(v), bool(v > 4), bool(i % 7)) for k, x in values.items() for i, v in enumerate(x)]
    df = spark.createDataFrame(table, "k string, ts double, id long, value double, alarm boolean, normal boolean").repartition(5, "id")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so that series lie over many partitions
    out = L.settled(L.placed(df, ["k"], ["ts", "id"], ["id", "value", "alarm", "normal"]))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    return out


def by_place(df, *columns):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.k, r.t_idx)):
        out.setdefault(r.k, []).append(tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]])
    return out


def test_places(rows):
    assert rows.where("t_idx != id").count() == 0
    assert rows.count() == sum(LENGTHS.values())
    assert rows.select(F.spark_partition_id().alias("p")).distinct().count() > 1


@pytest.mark.parametrize("q", [0.0, 0.37, 0.5, 0.99])
def test_quantiles_by_place(rows, values, q):
    got = {r.k: r.q for r in L.quantile_of(rows, ["k"], "value", q, "q").collect()}
    assert got == pytest.approx({k: np.quantile(x, q) for k, x in values.items()})


@pytest.mark.parametrize(("size", "maximum", "initial"), [(1, 3, 1), (16, 5, 0), (64, 1000, 700), (1 << 16, 4, 4)])
def test_counter(rows, values, size, maximum, initial):
    got = by_place(L.saturating_counter(rows, ["k"], "alarm", "normal", initial, maximum, size), "criticality")
    for k, x in values.items():
        c, expected = initial, []
        for i, v in enumerate(x):
            c = max(0, min(maximum, c + ((1 if v > 4 else -1) if i % 7 else 0)))
            expected.append(c)
        assert got[k] == expected


def test_counter_takes_unknown_flags(spark):
    df = spark.createDataFrame([("a", 0, None, True), ("a", 1, True, None), ("a", 2, True, True)], "k string, t_idx long, alarm boolean, normal boolean")
    assert by_place(L.saturating_counter(df, ["k"], "alarm", "normal", initial=3), "criticality") == {"a": [2, 2, 3]}
    assert by_place(L.saturating_counter(df, ["k"], F.col("alarm"), initial=3), "criticality") == {"a": [2, 3, 4]}
    assert L.saturating_counter(df.limit(0), ["k"], "alarm").count() == 0


@pytest.mark.parametrize(("size", "threshold"), [(8, 5.0), (64, 5.0), (8, 1e9)])
def test_cusum(rows, values, size, threshold):
    got = by_place(L.cusum(rows, ["k"], "value", 0.5, threshold, size), "pos", "neg", "alarm")
    for k, x in values.items():
        assert got[k] == list(zip(*(a.tolist() for a in K.cusum(x, 0.5, threshold)), strict=True))


@pytest.mark.parametrize("size", [5, 64])
def test_change_points(rows, values, size):
    got = by_place(L.change_points(rows, ["k"], 5, 2.0, block=size), "t_idx", "score")
    expected = {k: K.change_points(x, 5, 2.0) for k, x in values.items()}
    assert sum(map(len, expected.values())) > 10
    assert got == {k: v for k, v in expected.items() if v}


@pytest.mark.parametrize("size", [16, 100, 1 << 16])
@pytest.mark.parametrize("levels", [1, 3])
def test_wavelet(rows, values, size, levels):
    got = by_place(L.wavelet_denoised(rows, ["k"], levels, size=size), "smooth")
    for k, x in values.items():
        assert np.allclose(got[k], K.wavelet_denoise(x, levels), atol=1e-9)


@pytest.mark.parametrize("size", [50, 300])
def test_band(rows, values, size):
    got = by_place(L.banded(rows, ["k"], 1.0, 0.1, 0.3, size=size), "band", "envelope")
    for k, x in values.items():
        band, envelope = np.array(got[k]).T
        assert np.allclose(band, K.bandpass(x, 1.0, 0.1, 0.3), atol=1e-6)
        assert (envelope >= np.abs(band) - 1e-12).all()
    x = np.concatenate([values["hot"]])
    pad = 27
    y = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]])
    f = np.abs(np.fft.fftfreq(len(y)))
    whole = np.abs(K.analytic(np.fft.ifft(np.fft.fft(y) * K.band_gain(f, 1.0, 0.1, 0.3, 4)).real))[pad:-pad]
    assert np.allclose(np.array(got["hot"])[:, 1], whole, atol=1e-6)


@pytest.mark.parametrize("size", [16, 1 << 16])
def test_canonical_variates(spark, values, size):
    rng = np.random.default_rng(8)
    series = {k: np.column_stack([x, rng.standard_normal(len(x)) + 0.3 * x]) for k, x in values.items()}
    series["mid"][5, 1] = np.nan
    table = [(k, i, float(a), float(b)) for k, x in series.items() for i, (a, b) in enumerate(x)]
    got = by_place(L.cva_monitoring(spark.createDataFrame(table, "k string, t_idx long, a double, b double"), ["k"], ["a", "b"], 2, 3, size=size), "t2", "alarm")
    for k, x in series.items():
        t2, alarm = K.cva_monitor(x, int(len(x) * (2 / 3)), 2, 3)
        assert [g[1] for g in got[k]] == alarm.tolist()
        assert np.allclose([np.nan if g[0] is None else g[0] for g in got[k]], t2, equal_nan=True, rtol=1e-6)


def test_status(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", None), ("b", float("nan")), ("c", 1.0), ("d", 3.0), ("d", 3.0)], "k string, value double")
    assert {r.k: (r.n, r.missing, r.status) for r in L.series_status(df, ["k"], 2).collect()} == {"a": (2, 0, "ok"), "b": (2, 2, "no_values"), "c": (1, 0, "too_short"), "d": (2, 0, "constant")}
