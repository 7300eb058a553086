"""Stated ranges: what counts as one, and how often a text is looked at."""

import re

from orebed.operators import claims as C


def test_ranges_are_matched_once(spark):
    texts = ["P-1 oil pressure normal range is 1 to 2 bar.", " p-2 Flow normal range is 1.5 to 1.5 BAR ", "P-3 flow normal range is 2 to 1 bar.", "P-4 flow normal range is 1.2.3 to 4 bar", "P-5 flow normal range is 1 to 2 bar always.", "P-6 flow normal range is 1 to 2 bar\n", "P-7 flow\x01 normal range is 1 to 2 bar", "", None]
    facts = C.range_facts(spark.createDataFrame(list(enumerate(texts)), "k int, text string"), "k", "text")
    want = set()
    for k, text in enumerate(texts):
        m = re.search(C.RANGE_FACT, re.sub(r"\.$", "", (text or "").strip(" ")))
        if m and all(re.fullmatch(r"[0-9]+\.?[0-9]*|\.[0-9]+", x) for x in m.groups()[2:4]) and float(m[3]) <= float(m[4]):
            want.add((k, m[1].lower(), m[2].lower(), float(m[3]), float(m[4]), m[5].lower()))
    assert {tuple(r) for r in facts.collect()} == want and {r[0] for r in want} == {0, 1, 5}
    # Before, each part of each filter and column was a match of its own.
    assert facts._jdf.queryExecution().optimizedPlan().toString().count("normal range is") == 1


def test_claims_stay_where_they_lie(spark):
    rows = [(1, "a", "flow", 1.0, 2.0, "bar"), (1, "a", "flow", 1.0, 2.0, "bar"), (2, "a", "flow", 1.0, 3.0, "bar"), (3, "b", "flow", 1.0, 2.0, "bar")]
    facts = spark.createDataFrame(rows, "doc int, asset string, metric string, low double, high double, unit string")
    claims = facts.withColumn("claim", facts["doc"]).unionByName(facts.where("doc = 3").selectExpr("4 AS claim", "3 AS doc", "asset", "metric", "low + 1 AS low", "high + 1 AS high", "unit"))
    got = C.cited_ranges(claims, facts, "claim")
    assert sorted((r.claim, r.status) for r in got.collect()) == [(1, "CONFLICTING"), (1, "CONFLICTING"), (2, "CONFLICTING"), (3, "SUPPORTED")]
    # Before, all claims that speak of one fact were one task's.
    assert not re.search(r"hashpartitioning\(asset#\d+, metric#\d+, unit#\d+, \d", got._jdf.queryExecution().executedPlan().toString())


def test_claims_are_dealt_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(C, "PART_CLAIMS", 2)
    claims = spark.createDataFrame([(i, f"common pump number{i}") for i in range(30)], "k int, text string").coalesce(1)
    queries = spark.createDataFrame([(1, "Common pumps"), (2, "number7 the"), (3, None)], "q int, text string")
    got = C.claims_for_query(claims, queries, ("the",), "k", "q")
    assert {tuple(r) for r in got.collect()} == {(1, i, 1.0) for i in range(30)} | {(2, 7, 1.0)}
    # Before, the pairs of a file's claims were made and counted by the one task that reads it.
    assert "hashpartitioning(k" in (plan := got._jdf.queryExecution().executedPlan().toString()) and ", 15)" in plan
