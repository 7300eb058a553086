"""Turbines' physical bounds against plain numpy on odd readings."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from orebed.operators import longseries as L
from orebed.operators import turbines as W

NAMES = ["Ambient temp", "Rotor speed", "Torque", "Gearbox oil temp", "Bearing temp", "Wind speed", "Reactive power", "Active power", "Pitch", "Generator speed"]


def plain(x, area):
    amb, rotor, torque, gear, bear, wind, _, power, pitch, gen = x.T
    fin, n, out = np.isfinite, len(x), {}

    def keep(flag, channel, bad, value, severity):
        if bad.sum() >= 8:
            p = np.percentile(value[bad], 90)
            out[flag, channel] = (int(bad.sum()), bad.sum() / n, p, min(5.0, max(1.0, severity(p))))

    with np.errstate(invalid="ignore"):
        rated = np.percentile(power[fin(power)], 99.5)
        upper = np.minimum(0.5 * 1.225 * area * 0.59 * np.maximum(wind, 0) ** 3 / 1000 * 1.2, rated * 1.2)
        keep("power_exceeds_aerodynamic_limit", 7, fin(power) & fin(upper) & (power > upper) & (wind > 2), power / np.maximum(upper, 1e-6), lambda p: p)
        active = np.abs(gen) > 0.1 * np.percentile(np.abs(gen[fin(gen)]), 95)
        lost = fin(power) & fin(wind) & active & (wind >= np.percentile(wind[fin(wind)], 70)) & (power < 0.55 * rated) & (np.abs(pitch) < 8)
        keep("possible_unannounced_curtailment_or_electrical_loss", 7, lost, (rated - power) / rated, lambda p: 3 * p)
        for c, v, (o, t, s) in ((3, gear, (5, 0.18, 0.35)), (4, bear, (2, 0.15, 0.30))):
            excess = v - (amb + o + t * np.abs(torque) + s * np.abs(rotor) + 12)
            keep("temperature_above_steady_state_dissipation_bound", c, fin(excess) & (excess > 0), excess, lambda p: 1 + p / 12)
    return out


def frames(spark, units):
    readings = [(u, i, c, None if k % 2 and np.isnan(v) else float(v)) for u, x in units.items() for i, row in enumerate(x) for c, (k, v) in enumerate(zip(range(i, i + 10), row, strict=True))]
    return spark.createDataFrame(readings, "unit string, sample long, channel int, value double"), spark.createDataFrame([(u, c, n) for u in units for c, n in enumerate(NAMES)] * 2, "unit string, channel int, name string")


def test_findings(spark):
    rng = np.random.default_rng(5)
    units = {}
    for u, n in (("a", 300), ("b", 40), ("c", 7)):
        x = np.stack([rng.uniform(5, 25, n), rng.uniform(-15, 15, n), rng.uniform(0, 30, n), rng.uniform(20, 70, n), rng.uniform(20, 60, n), rng.uniform(0, 20, n), np.ones(n), rng.uniform(0, 2000, n), rng.uniform(0, 15, n), rng.uniform(-5, 1500, n)], axis=1)
        x[rng.random(x.shape) < 0.05] = np.nan
        units[u] = x
    readings, channels = frames(spark, units)
    findings = W.wind_findings(readings, channels, "unit", "sample", bounds=W.Bounds(area=800.0))
    got = {}
    for r in findings.collect():
        got.setdefault(r.unit, {})[r.flag, r.channel] = (r.violations, r.violation_fraction, r.p90, r.severity)
    for u, x in units.items():
        want = plain(x, 800.0)
        assert got.get(u, {}).keys() == want.keys()
        for k, v in want.items():
            np.testing.assert_allclose(got[u][k], v, rtol=1e-9)
    assert len(got["a"]) == 4 and "c" not in got
    verdicts = {r.unit: r for r in W.wind_physics(channels, findings, "unit").collect()}
    assert verdicts["c"].physics_consistent and verdicts["c"].ranked_subsystems == [] and verdicts["a"].ranked_subsystems[0] in ("electrical", "gearbox", "bearing")
    worst = {}
    for r in findings.where("unit = 'a'").collect():
        worst[r.subsystem] = max(worst.get(r.subsystem, 0), r.severity)
    assert [worst[s] for s in verdicts["a"].ranked_subsystems] == sorted(worst.values(), reverse=True)


def test_roles_and_odd_tables(spark):
    rows = [("a", 1, "Reactive power"), ("a", 2, "apparent power"), ("a", 3, None), ("b", 1, "Generator apparent power"), ("b", 2, "power out"), ("c", 4, "Outside temp"), ("c", 9, "Ambient temp"), ("c", 2, "Wind speed"), ("c", 1, "wind SPEED")]
    roles = {r.unit: r for r in W.channel_roles(spark.createDataFrame(rows, "unit string, channel int, name string"), "unit").collect()}
    assert (roles["a"].power, roles["b"].power, roles["c"].ambient, roles["c"].wind) == (None, 1, 9, 1)
    readings, channels = frames(spark, {"a": np.ones((20, 10))})
    none = W.wind_findings(readings.where("false"), channels, "unit", "sample")
    assert none.count() == 0
    part = W.wind_findings(readings.where("channel <> 7").withColumn("name", readings["unit"]), channels.where("channel <> 7"), "unit", "sample")
    assert part.count() == 0


def test_quantiles_place_few_rows(spark, monkeypatch):
    rng = np.random.default_rng(8)
    series = {"a": rng.standard_normal(4000), "b": np.ones(50), "c": np.array([1.0, -np.inf, np.inf, 2.0, 3.0]), "d": np.array([5.0]), "e": rng.integers(0, 4, 300).astype(float)}
    placed, sizes = L.placed, []
    monkeypatch.setattr(L, "placed", lambda df, *x: sizes.append(df.count()) or placed(df, *x))
    df = spark.createDataFrame([(k, float(v)) for k, x in series.items() for v in x] + [("a", None)], "k string, x double")
    for q in (0.0, 0.3, 0.995, 1.0):
        got = {r.k: r.q for r in L.binned_quantile_of(df, ["k"], "x", q, "q").collect()}
        want = {k: np.percentile(x, 100 * q) for k, x in series.items() if k != "c"}
        np.testing.assert_allclose([got[k] for k in want], list(want.values()), rtol=1e-12)
    assert max(sizes) < 2000
    got = {r.k: r.q for r in L.binned_quantile_of(df.where("k = 'c'"), ["k"], "x", 0.5, "q").collect()}
    assert got == {"c": 2.0}


def test_findings_place_few_rows(spark, monkeypatch):
    rng = np.random.default_rng(6)
    readings, channels = frames(spark, {"a": rng.uniform(5, 25, (600, 10))})
    placed, sizes = L.placed, []
    monkeypatch.setattr(L, "placed", lambda df, *x: sizes.append(df.count()) or placed(df, *x))
    W.wind_findings(readings, channels, "unit", "sample", bounds=W.Bounds(area=800.0))
    assert 0 < sizes[0] < 600


@pytest.mark.parametrize(("packed", "largest"), [(False, 500), (True, 10**6)])
def test_findings_of_many_units_are_those_of_few(spark, monkeypatch, packed, largest):
    rng = np.random.default_rng(9)
    units = {u: np.where(rng.random((n, 10)) < 0.05, np.nan, rng.uniform(5, 60, (n, 10)) * np.where(np.arange(10) == 7, 30, 1)) for u, n in (("a", 90), ("b", 40), ("c", 7), ("d", 60))}
    readings, channels = frames(spark, units)
    channels = channels.where("NOT (unit = 'b' AND channel IN (2, 8)) AND unit <> 'd'")
    readings = readings.withColumn("sample", F.expr("nullif(sample, 3)")).unionByName(readings.where("sample < 9").withColumn("value", F.col("value") * 1.5))
    if packed:
        readings = readings.groupBy("unit", "sample", F.expr("channel % 2").alias("k")).agg(F.collect_list(F.struct("channel", "value")).alias("r")).select("unit", "sample", F.col("r.channel").alias("channels"), F.col("r.value").alias("values"))
    monkeypatch.setattr(W, "LARGEST", largest)
    found = lambda reference: {tuple(r)[:5]: tuple(r)[5:] for r in W.wind_findings(readings, channels, "unit", "sample", reference, W.Bounds(area=800.0)).collect()}
    usual = W._samples
    for reference in (None, readings.where("sample > 10")):
        monkeypatch.setattr(W, "MANY", 500)
        monkeypatch.setattr(W, "_samples", usual)
        want = found(reference)
        assert len({k[0] for k in want}) == 2 and len(want) >= 3
        monkeypatch.setattr(W, "MANY", 0)
        if largest == 10**6:
            monkeypatch.setattr(W, "_samples", None)  # is not called
        got = found(reference)
        assert got.keys() == want.keys()
        np.testing.assert_allclose([got[k] for k in want], list(want.values()), rtol=1e-12)
