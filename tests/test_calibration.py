"""Calibrations against plain grid searches, and streams over several files against batches."""

from __future__ import annotations

import numpy as np
import pytest

from orebed.operators import calibration as C
from orebed.operators import kernels as K
from orebed.streaming import online as O


def test_monitoring_by_a_plain_grid(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((400, 4)) @ rng.standard_normal((4, 4))
    x[300:] *= 1.3
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i long, v array<double>").repartition(3)
    grid = ((0.8, 0.9, 0.95, 0.99), (1, 2, 3))
    got = {(r.alpha, r.min_consecutive): r for r in C.calibrated_monitoring(df, ["i"], "v", variance=0.9, alphas=grid[0], persistences=grid[1], size=16).collect()}
    split = round(400 * 0.65)
    fit, rest = x[:split], x[split:]
    mean = fit.mean(axis=0)
    axes, spread = K.components(np.cov(fit.T), 0.9)

    def statistics(a):
        t = (a - mean) @ axes
        return ((a - mean - t @ axes.T) ** 2).sum(axis=1), (t**2 / spread).sum(axis=1)

    ref, new, trials = statistics(fit), statistics(rest), []
    for alpha in grid[0]:
        over = (new[0] > np.quantile(ref[0], alpha)) | (new[1] > np.quantile(ref[1], alpha))
        for p in grid[1]:
            run, alarms = 0, 0
            for o in over:
                run = run + 1 if o else 0
                alarms += run >= p
            trials.append((alpha, p, alarms / len(over)))
    assert {k: r.far for k, r in got.items()} == pytest.approx({(a, p): f for a, p, f in trials})
    best = min(trials, key=lambda t: (t[2] > 0.05, t[2] if t[2] > 0.05 else abs(t[2] - 0.05), t[1]))
    assert [k for k, r in got.items() if r.chosen] == [best[:2]]
    with pytest.raises(ValueError, match="40"):
        C.calibrated_monitoring(df.limit(30), ["i"], "v")


def test_limits_by_a_plain_grid(spark):
    rng = np.random.default_rng(4)
    z = {e: rng.standard_normal(60) * (1.6 if e < 3 else 1) + (np.arange(60) > 40) * (e == 1) for e in range(12)}
    df = spark.createDataFrame([(e, i, float(v)) for e, x in z.items() for i, v in enumerate(x)], "e long, t_idx long, z double")
    grids = ((0.5, 1.0, 2.0), (1, 2), (0.25, 0.5), (1.0, 3.0), (0.05, 0.2))
    got = {tuple(r)[:5]: r for r in C.calibrated_limits(C.limit_trials(df, "e", "z", *grids, least_run=2), "e", C.SETTINGS, "detected", "alarmed", "total", target=0.3, draws=50).collect()}
    trials = {}
    for a, p, d, c, f in ((a, p, d, c, f) for a in grids[0] for p in grids[1] for d in grids[2] for c in grids[3] for f in grids[4]):
        seen = alarmed = 0
        for x in z.values():
            drift, run, residual, both, longest = K.cusum(x, d, c)[2], 0, [], 0, 0
            for v in x:
                run = run + 1 if abs(v) > a else 0
                residual.append(run >= p)
            for r, m in zip(residual, drift, strict=True):
                both = both + 1 if r and m else 0
                longest = max(longest, both)
            seen += longest >= 2 and np.mean(residual) >= f and np.mean(drift) >= 0.02
            alarmed += int(sum(r or m for r, m in zip(residual, drift, strict=True)))
        trials[a, p, d, c, f] = (seen / 12, alarmed / 720, seen)
    for i, name in enumerate(("far", "sample_far", "false_alarms")):
        assert {k: r[name] for k, r in got.items()} == pytest.approx({k: float(t[i]) for k, t in trials.items()})
    passing = [k for k, t in trials.items() if t[0] <= 0.3]
    best = max(passing, key=lambda k: (trials[k][0], *(-v for v in k)))
    assert [k for k, r in got.items() if r.chosen] == [best]
    for k, r in got.items():
        assert r.far_low <= trials[k][0] + 1e-9 <= r.far_high + 2e-9 or 0 < trials[k][2] < 3


def test_draws_are_poisson(spark):
    n = spark.range(20_000).select(C.poisson_draw("id").alias("w"))
    mean, var = n.selectExpr("avg(w)", "var_pop(w)").first()
    assert abs(mean - 1) < 0.03
    assert abs(var - 1) < 0.06


def files(spark, path, parts, schema):
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(path))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def test_freshness_by_timers(spark, tmp_path):
    schema = "k string, ts double, at double"
    parts = [[("a", 10.0, 10.0), ("b", 10.0, 10.0), ("c", 15.0, 15.0)], [("b", 20.0, 20.0), ("b", 13.0, 22.0), ("d", 22.0, 22.0)], [("d", 22.0, 22.0), ("c", 410.0, 410.0)], [("b", 5000.0, 5000.0), ("z", 100.0, 5000.0)]]
    got = sorted(tuple(r) for r in O.drained(O.streamed_freshness(files(spark, tmp_path / "in", parts, schema), ["k"], "ts", "at", 100, 1000)).collect())
    changes = lambda k, t: [(k, t, t + 100, "STALE", False), (k, t, t + 1000, "EXPIRED", False)]
    fresh = lambda k, t: (k, t, t, "FRESH", False)
    expected = [fresh("a", 10.0), *changes("a", 10.0), fresh("b", 10.0), fresh("b", 20.0), ("b", 13.0, 22.0, "FRESH", True), *changes("b", 20.0), fresh("b", 5000.0)]
    expected += [fresh("c", 15.0), changes("c", 15.0)[0], fresh("c", 410.0), *changes("c", 410.0), fresh("d", 22.0), fresh("d", 22.0), *changes("d", 22.0), ("z", 100.0, 5000.0, "EXPIRED", False)]
    assert got == sorted(expected)


@pytest.mark.parametrize("rows", [1, 7, 10_000])
def test_freshness_takes_readings_of_one_batch_in_their_order(spark, tmp_path, rows):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    usual = spark.conf.get(name)
    times = 1000 + np.random.default_rng(5).permutation(60) * 40.0
    made = [(k, float(t), float(t)) for t in times for k in ("a", "b", "c")]
    spark.conf.set(name, rows)
    try:
        got = sorted(tuple(r) for r in O.drained(O.streamed_freshness(files(spark, tmp_path / "in", [made], "k string, ts double, at double"), ["k"], "ts", "at", 30, 100)).collect())
    finally:
        spark.conf.set(name, usual)
    fresh = [(k, float(t), float(t), "FRESH", False) for k in "abc" for t in range(1000, 3400, 40)]
    stale = [(k, float(t), t + 30.0, "STALE", False) for k in "abc" for t in range(1000, 3360, 40)]
    assert got == sorted(fresh + stale)


@pytest.mark.parametrize("cuts", [[120], [1, 2, 3, 70], []])
def test_online_variates_are_the_batch_ones(spark, tmp_path, cuts):
    rng = np.random.default_rng(7)
    x = rng.standard_normal((120, 2)).cumsum(axis=0) * 0.2 + rng.standard_normal((120, 2))
    rows = [("a", i, float(v[0]), None if i == 100 else float(v[1])) for i, v in enumerate(x)]
    x[100, 1] = np.nan
    schema = "k string, i long, u double, v double"
    ref = spark.createDataFrame(rows[:60], schema)
    models = O.trained_variates(ref, ["k"], "i", ["u", "v"], 2, 2, 0.9)
    edges = [0, *cuts, 120]
    parts = [rows[a:b] for a, b in zip(edges, edges[1:], strict=False) if b > a]
    parts[-1] = [*parts[-1], ("new", 0, 1.0, 1.0)]
    got = {(r.k, r.i): r for r in O.drained(O.online_variates(files(spark, tmp_path / "in", parts, schema), ["k"], ["i"], ["u", "v"], models, 2)).collect()}
    x[100, 1] = np.median(x[:60, 1])
    t2, alarm = K.cva_monitor(x, 60, 2, 2, 0.9)
    assert np.allclose([np.nan if got["a", i].t2 is None else got["a", i].t2 for i in range(120)], t2, equal_nan=True)
    assert [got["a", i].alarm for i in range(120)] == alarm.tolist()
    assert (got["new", 0].t2, got["new", 0].alarm) == (None, False)


def test_trials_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    def seen(parts):
        for part in parts:
            made.add(len(part))
            yield part

    schema = "e long, s double, hit boolean, alarmed long, total long"
    rows = [(e, s, e % 3 == 0 and s < 2, e, 10) for e in range(30) for s in (0.5, 1.0, 2.0)]
    df = spark.createDataFrame(rows, schema).mapInPandas(seen, schema)
    got = {r.s: r for r in C.calibrated_limits(df, "e", ["s"], "hit", "alarmed", "total", draws=40, seed=3).collect()}
    assert made.value == len(rows)
    w = {(r.e, r.d): r.w for r in spark.range(30).withColumnRenamed("id", "e").selectExpr("e", "explode(sequence(0, 39)) AS d", "3 AS seed").withColumn("w", C.poisson_draw("e", "d", "seed")).collect()}
    means = [sum(w[e, d] for e in range(0, 30, 3)) / sum(w[e, d] for e in range(30)) for d in range(40)]
    for s in (0.5, 1.0):
        assert (got[s].far_low, got[s].far_high) == pytest.approx(np.percentile(means, [2.5, 97.5]))
    assert (got[2.0].far, got[2.0].far_low, got[2.0].far_high) == (0, 0, 0)


def test_variates_slice_by_slice():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((300, 2))
    model = K.cva_trained(x[:150], 3, 2, 0.99)
    z = O.scaled(x, model)
    ring, whole = O.ring_scores(np.zeros((0, 2)), z, model, 3)
    assert np.isnan(whole[:3]).all()
    assert np.isfinite(whole[3:]).all()
    for cuts in ([1, 2, 4], [2, 100, 101, 299]):
        held, scores = np.zeros((0, 2)), []
        for part in np.split(z, cuts):
            held, t2 = O.ring_scores(held, part, model, 3)
            scores.append(t2)
        assert np.allclose(np.concatenate(scores), whole, equal_nan=True)
        assert np.array_equal(held, ring)
    assert np.isnan(O.ring_scores(held, z, None, 3)[1]).all()
