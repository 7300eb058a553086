"""Decisions on small cases that can be worked out by hand."""

from __future__ import annotations

import numpy as np
import pytest

from orebed.operators import decisions as D
from orebed.sources.catalogue import faults, topology


def evidence(spark, rows, **more):
    df = spark.createDataFrame([("u", i, *r) for i, r in enumerate(rows)], "k string, t_idx long, r boolean, d boolean, e boolean, o boolean")
    return D.event_evidence(df, ["k"], "r", "d", "e", "o", **more).first()


@pytest.mark.parametrize("size", [4, 1 << 16])
def test_sustained_overlap_is_a_fault(spark, size):
    rows = [(False, False, True, False)] * 40 + [(True, True, True, False)] * 8 + [(True, False, True, False)] * 2
    got = evidence(spark, rows, size=size)
    assert (got.decision, got.longest_both, got.longest_residual, got.first_index) == ("fault", 8, 10, 45)
    assert got.score == pytest.approx(0.25 + 0.20 + 0.30 + 0.20)


def test_scattered_alarms_are_watched(spark):
    rows = [(bool(i % 2), True, True, False) for i in range(50)]
    got = evidence(spark, rows)
    assert (got.decision, got.reason, got.longest_both, got.first_index) == ("monitor", "no_sustained_run", 1, None)


def test_unknown_operation_abstains(spark):
    rows = [(True, True, True, i < 6) for i in range(50)]
    got = evidence(spark, rows)
    assert (got.decision, got.confidence) == ("abstain", 1.0)


def test_rows_that_are_not_evaluable_break_runs(spark):
    rows = [(True, True, i != 5, False) for i in range(11)]
    got = evidence(spark, rows)
    assert (got.decision, got.longest_both) == ("monitor", 5)


def test_catalogue_is_whole(spark):
    rows = {r.fault_id: r for r in faults(spark).collect()}
    assert sorted(rows) == list(range(1, 22))
    assert rows[4].roots == ["XMV(10)", "XMEAS(21)", "XMEAS(9)"]
    edges = topology(spark)
    assert edges.count() == edges.distinct().count() == 46


def test_a_known_pattern_is_named(spark):
    scores = spark.createDataFrame([("a", v, s, s, s, i) for i, (v, s) in enumerate([("XMV(15)", 0.1), ("XMEAS(24)", 1.0), ("XMEAS(30)", 0.9), ("XMEAS(35)", 0.8), ("XMEAS(36)", 0.7)], 1)] + [("b", "none", 1.0, None, None, None)], "unit string, variable string, generic double, shift double, contribution double, onset_rank int")
    got = {r.unit: r for r in D.guided_roots(scores, "unit", faults(spark)).collect()}
    assert (got["a"].fault_id, got["a"].root_cause, got["a"].abstain_reason) == (2, "XMEAS(24)", None)
    assert got["b"].abstain_reason == "catalog_evidence_below_threshold"
    close = spark.createDataFrame([("a", "step", 0.0)], "unit string, kind string, score double")
    assert {r.unit: r.abstain_reason for r in D.guided_roots(scores, "unit", faults(spark), close).collect()}["a"] in (None, "ambiguous_catalog_fault_id")


def test_reach_goes_no_further_than_asked(spark):
    edges = spark.createDataFrame([("u", a, b) for a, b in ("ab", "bc", "cd", "da", "xy")], "unit string, cause string, effect string")
    roots = spark.createDataFrame([("u", "a"), ("v", "a")], "unit string, root string")
    for depth, nodes in ((1, "ab"), (2, "abc"), (9, "abcd")):
        assert sorted(r.node for r in D.reached(roots, edges, "unit", depth).collect()) == list(nodes)


def test_life_with_its_interval(spark):
    rng = np.random.default_rng(0)
    x = np.arange(60)
    y = 2 - 0.008 * x + 0.004 * rng.standard_normal(60)
    table = [("a", int(i), float(v), float(v)) for i, v in zip(x, y, strict=True)] + [("gone", i, 1.9 if i < 29 else None, 1.9 if i < 29 else None) for i in range(30)] + [("few", i, 1.9, 1.9) for i in range(5)] + [("flat", i, 1.9, 1.9) for i in range(30)] + [("done", i, 1.8 - 0.02 * i, 1.8 - 0.02 * i) for i in range(30)] + [("low", i, 1.0, 1.0) for i in range(30)]
    got = {r.k: r for r in D.life_interval(spark.createDataFrame(table, "k string, t_idx long, value double, smooth double"), ["k"], 1.4, 2.0).collect()}
    assert {k: r.state for k, r in got.items()} == {"a": "projected", "gone": "latest_capacity_missing", "few": "insufficient_history", "flat": "non_degrading_or_unstable_slope", "done": "observed_crossing", "low": "left_censored_crossing"}
    fits = [np.polyfit(x[-n:], y[-n:], 1) for n in (20, 20, 40, 60)]
    ends = [(1.4 - c) / m for m, c in fits]
    design = np.column_stack([x[-20:], np.ones(20)])
    (m, c), left = fits[0], y[-20:] - design @ fits[0]
    g = np.array([-ends[0] / m, -1 / m])
    u = 1.96 * np.sqrt(g @ (left @ left / 18 * np.linalg.inv(design.T @ design)) @ g)
    a = got["a"]
    assert a.eol == pytest.approx(ends[0])
    assert a.line_uncertainty == pytest.approx(u)
    assert a.disagreement == pytest.approx(max(abs(ends[0] - min(ends[1:])), abs(max(ends[1:]) - ends[0])))
    assert (a.eol_low, a.eol_high) == (pytest.approx(max(59, min(ends[0] - u, min(ends[1:])))), pytest.approx(max(ends[0] + u, max(ends[1:]))))
    assert (got["done"].eol, got["done"].eol_low, got["done"].remaining) == (20.0, 19.0, 0.0)
    assert (got["low"].eol, got["low"].eol_low, got["low"].risk) == (0.0, 0.0, 1.0)


def test_ends_that_lie_between_two_figures_are_those_of_sql(spark, tmp_path):
    import duckdb

    from conftest import assert_same
    from orebed.queries import ORACLE_SQL, QUERIES

    series = (
        [15.31, 42.38, 29.45, 22.91, 29.85, 13.57, 25.29, 1.6, 66.31],
        [42.56, 10.62, 18.06, 32.95, 24.24, 92.91, 5.96, 15.88, 2.86, 100.62, 9.08],
        [12.34, 42.92, 55.25, 13.76, 68.58, 37.3, 81.98, 110.17, 7.41, 12.83, 52.11, 24.91, 71.07, 13.29],
        [46.77, 78.08, 45.23, 89.56, 3.27, 2.38, 16.93, 28.7, 40.68, 25.39, 8.23, 14.19, 37.54],
    )
    events = [(100 * u + i, u, "view", v, 60 * i) for u, values in enumerate(series) for i, v in enumerate(values)]
    table = spark.createDataFrame(events, "event_id long, user_id long, event_type string, value double, s long").selectExpr("event_id", "user_id", "event_type", "value", "CAST(timestamp_seconds(s) AS timestamp_ntz) AS ts")
    table.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    assert_same(QUERIES["life_interval"](spark, str(tmp_path)), con, ORACLE_SQL["life_interval"])


def test_latest_lines(spark):
    rng = np.random.default_rng(3)
    x, y = np.arange(30.0), rng.standard_normal(30)
    table = [("a", float(i), None if i == 28 else float(v)) for i, v in zip(x, y, strict=True)] + [("one", 1.0, 2.0), ("none", 1.0, None)]
    got = {r.k: r for r in D.latest_lines(spark.createDataFrame(table, "k string, x double, y double").repartition(5), ["k"], "x", "y", [4, 50]).collect()}
    x, y = np.delete(x, 28), np.delete(y, 28)
    for i, n in enumerate((3, 29, 29)):
        assert np.allclose([got["a"][f"_m{i}"], got["a"][f"_c{i}"]], np.polyfit(x[-n:], y[-n:], 1))
    assert list(got["one"])[1:] == list(got["none"])[1:] == [None] * 6
