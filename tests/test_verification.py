"""Anchored verdicts on worked cases."""

from orebed.operators import verification as V


def test_verdicts(spark):
    said = spark.createDataFrame([("d", 1, "Pump discharge pressure was 14 bar in March."), ("d", 2, "The motor temperature was 80 percent."), ("d", 3, "Pump discharge pressure reached 20 bar."), ("d", 4, "Inspection of the pump took place on March 3, 2024."), ("e", 1, "Nothing to see.")], "k string, sentence int, text string")
    claims = {1: "Pump discharge pressure was 14 bar.", 2: "Pump discharge pressure was 17 bar.", 3: "Pump discharge pressure is above the limit of 14 bar.", 4: "Staff costs were 14 euros.", 5: "The pump inspection took place on March 3, 2024.", 6: "The pump inspection took place on April 3, 2024.", 7: "The pump is fine.", 8: "It is 14."}
    got = {r.claim: (r.status, r.method, r.evidence) for r in V.anchored_verdict(spark.createDataFrame([("d", i, t) for i, t in claims.items()], "k string, claim int, text string"), said, "k").collect()}
    first, dated = said.collect()[0].text, said.collect()[3].text
    assert got == {
        1: ("SUPPORTED", "numeric_exact", first),
        2: ("UNKNOWN", "numeric_conflict_candidate", first),
        3: ("UNKNOWN", "comparison_requires_context", None),
        4: ("UNKNOWN", "numeric_unresolved", None),
        5: ("SUPPORTED", "date_exact", dated),
        6: ("UNKNOWN", "date_conflict_candidate", dated),
        7: ("UNKNOWN", "unresolved", None),
        8: ("UNKNOWN", "numeric_unresolved", None),
    }


def test_claims_and_sentences_are_parsed_once(spark):
    claims = spark.createDataFrame([("d", 1, "pumps ran 5 hours on 3 May 2021"), ("d", 2, "pumps ran 5 hours")], "k string, claim int, text string")
    said = spark.createDataFrame([("d", 1, "pumps ran 5 hours"), ("d", 2, "pumps ran on May 3, 2021"), ("d", 3, "pumps ran")], "k string, sentence int, text string")
    out = V.anchored_verdict(claims, said, "k")
    assert {(r.claim, r.method, r.evidence) for r in out.collect()} == {(1, "date_exact", "pumps ran on May 3, 2021"), (2, "numeric_exact", "pumps ran 5 hours")}
    lines = [x for x in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "jan(?:uary)" in x]
    assert len(lines) == 1 and "Project" in lines[0]
