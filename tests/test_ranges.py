"""Cited ranges and unit conversion on worked cases."""

import pytest

from orebed.operators import ranges as R


def test_cited_ranges(spark):
    documents = [
        ("a", "doc-1", "PX-1 normal discharge  pressure is 4 to 6.0 bar.", "current", None, "sop"),
        ("a", "doc-2", "PX-1 normal discharge pressure is 4 to 7 bar.", "superseded", None, "sop"),
        ("b", "doc-1", "About PX-2. Normal load was 40–60 %.", "Current", "trusted", "Equipment_Manual"),
        ("b", "doc-2", "PX-2 normal load is 40 to 70 %. PX-9 is new.", "current", None, "operating_limits"),
        ("c", "doc-1", "PX-3 normal speed is 900 to 1000 rpm.", "current", None, "sop"),
        ("c", "doc-2", "Unless started, the speed is never 100 to 200 rpm.", "current", None, "sop"),
        ("d", "doc-1", "PX-4 normal load is 4 to 5 percent.", "current", None, "sop"),
        ("d", "doc-2", "PX-4 normal load is 4 to 5 %.", "current", None, "sop"),
        ("e", "doc-1", "PX-5 normal temperature is 40 to 50 °C.", "current", "untrusted", "sop"),
        ("f", "doc-1", "PX-6 normal temperature is 40 to 50 C.", "current", None, "note"),
        ("g", "doc-1", None, None, None, None),
    ]
    claims = [
        ("a", 1, "px-1 normal discharge pressure is 4.0 to 6 bar [doc-1].", "How is PX-1?"),
        ("a", 2, "PX-1 normal discharge pressure is 4 to 6 bar [doc-1].", "Compare PX-1 with PX-2."),
        ("a", 3, "PX-1 normal discharge pressure is 4 to 7 bar [doc-2].", None),
        ("a", 4, "PX-1 normal discharge pressure is 4 to 6 bar [doc-1] [doc-2].", None),
        ("a", 5, "PX-1 normal discharge pressure is 4 to 6 bar, so it is safe [doc-1].", None),
        ("b", 6, "PX-2 normal load is 40 to 60 % [doc-1]", None),
        ("c", 7, "PX-3 normal speed is 900 to 1000 rpm [doc-1]", None),
        ("d", 8, "PX-4 normal load is 4 to 5 percent [doc-1]", None),
        ("e", 9, "PX-5 normal temperature is 40 to 50 °C [doc-1]", None),
        ("f", 10, "PX-6 normal temperature is 40 to 50 C [doc-1]", None),
        ("g", 11, None, None),
    ]
    got = R.proved_ranges(spark.createDataFrame(claims, "case string, claim int, text string, prompt string"), spark.createDataFrame(documents, "case string, evidence_id string, text string, status string, trust string, kind string")).collect()
    assert sorted(map(tuple, got)) == [("a", 1, "doc-1", "SUPPORTED", 1), ("b", 6, "doc-1", "CONFLICTING", 2)]


def test_units(spark):
    rows = [(450.0, " kPa ", "bar", 4.5, "OK"), (4.5, "bar", "MPa", 0.45, "OK"), (25.0, "°C", "K", 298.15, "OK"), (1500.0, "RPM", "hz", 25.0, "OK"), (2.25, "mm/s  R.M.S.", "m/s", 0.0023, "OK"), (1.0, "bar", "mm", None, "INCOMPATIBLE_UNITS"), (1.0, "psi", "bar", None, "UNIT_AMBIGUOUS"), (1.0, None, "bar", None, "UNIT_AMBIGUOUS"), (None, "bar", "bar", None, "OK")]
    df = spark.createDataFrame([r[:3] for r in rows], "v double, u string, w string")
    got = R.convert_units(df, "v", "u", "w").collect()
    assert [r.unit_status for r in got] == [r[4] for r in rows]
    assert [r.converted for r in got] == [r[3] for r in rows]
    canonical = R.convert_units(df, "v", "u").collect()
    assert [(r.converted, r.shown_unit) for r in canonical[:5]] == [(4.5, "bar"), (4.5, "bar"), (25.0, "°C"), (25.0, "Hz"), (pytest.approx(2.25), "mm/s")]


def test_documents_and_claims_are_parsed_once(spark, capsys):
    documents = spark.createDataFrame([("a", "doc-1", "PX-1 normal load is 4 to 6 %. PX-2 speed is 4 to 5.", "current", None, "sop")], "case string, evidence_id string, text string, status string, trust string, kind string")
    claims = spark.createDataFrame([("a", 1, "PX-1 normal load is 4 to 6 % [doc-1].", None)], "case string, claim int, text string, prompt string")
    got = R.proved_ranges(claims, documents)
    got.explain()
    assert "regexp" not in capsys.readouterr().out
    assert [tuple(r) for r in got.collect()] == [("a", 1, "doc-1", "SUPPORTED", 1)]
