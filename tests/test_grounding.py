"""Evidence of claims on worked cases."""

from orebed.operators import grounding as G

CLAIM = "Pump-731 normal discharge pressure is 3.2 to 4.1 bar [manual-1]."
MANUAL = ("manual-1", "Pump-731 normal discharge pressure is 3.2 to 4.1 bar.", "current")


def chosen(spark, cases, top=2):
    claims = spark.createDataFrame([(k, 1, c) for k, (c, _) in cases.items()], "k string, claim int, text string")
    items = spark.createDataFrame([(k, i, None, t, s, None, "x") for k, (_, rows) in cases.items() for i, t, s in rows], "k string, item string, document string, text string, status string, score double, _n string")
    out = {}
    for r in sorted(G.claim_evidence(claims, items, "k", top).collect(), key=lambda r: r.place):
        out.setdefault(r.k, []).append((r.item, r.cited, r.omitted))
    return out


def test_evidence(spark):
    readings = [MANUAL, ("log", "Pump-731 discharge pressure was 3.7 bar.", "current"), ("temperature", "Pump-731 normal temperature is 70 to 80 C.", None), ("draft", "Pump-731 normal discharge pressure is 2.2 to 2.9 bar.", "Draft"), ("old", "Pump-731 normal discharge pressure is 1 to 2 bar.", "superseded")]
    cases = {"readings": (CLAIM, readings), "cited draft": (CLAIM.replace("manual-1", "draft"), readings), "broad": (CLAIM.replace(" bar [", " bar and operation is safe ["), readings[:2]), "past": ("Historical discharge pressure of Pump-731", readings[-1:]), "now": ("Latest discharge pressure of Pump-731", readings[-1:]), "none": (None, readings), "short": ("pump-731", [("a", "Pump-731 runs", None), ("b", None, None)])}
    rivals = ["Pump-731 normal discharge pressure is 2.2 to 2.9 bar.", "Pump-731 normal discharge pressure is not 3.2 to 4.1 bar.", "Pump-731 normal discharge pressure is 3.2 to 4.1 rpm.", "If Pump-731 is at startup, normal discharge pressure is 2.2 to 2.9 bar."]
    for i, t in enumerate(rivals):
        cases[f"rival {i}"] = (CLAIM, [MANUAL, ("r1", t, None), ("r2", t.replace("Pump-731", "Pump-731 at load"), None), ("r3", t, None)])
    got = chosen(spark, cases)
    assert got["readings"] == [("manual-1", True, 0)]
    assert got["cited draft"] == [("draft", True, 0), ("manual-1", False, 0)]
    assert got["broad"] == [("manual-1", True, 0), ("log", False, 0)]
    assert got["past"] == [("old", False, 0)] and "now" not in got and "none" not in got and got["short"] == [("a", False, 0)]
    for i in range(4):
        items = got[f"rival {i}"]
        assert [x[:2] for x in items] == [("manual-1", True), ("r1", False)] and items[0][2] == 1


def test_empty(spark):
    assert chosen(spark, {"a": (CLAIM, [MANUAL])}) == {"a": [("manual-1", True, 0)]}
    none = spark.createDataFrame([], "k string, item string, document string, text string, status string, score double")
    assert G.claim_evidence(spark.createDataFrame([("a", 1, CLAIM)], "k string, claim int, text string"), none, "k").count() == 0


def test_cases_meet_whole_or_by_terms(spark, monkeypatch):
    cases = {k: (f"Pump-{k} normal pressure of discharge [man{k}] and load", [(f"man{k}", "Nothing alike", None), ("x", f"pump-{k} discharge pressure", None), ("y", "unlike words", None), ("z", f"normal load of pump-{k}", None)]) for k in "1234"}
    cases["none"] = (None, [("a", None, None)])
    met = chosen(spark, cases)
    assert met["1"][:1] == [("man1", True, 1)] and len(met) == 4
    monkeypatch.setattr(G, "TOGETHER", 2)
    assert chosen(spark, cases) == met


def test_small_cases_shuffle_no_terms(spark):
    claims = spark.createDataFrame([("a", 1, CLAIM)], "k string, claim int, text string")
    items = spark.createDataFrame([("a", "manual-1", None, MANUAL[1], None, None)], "k string, item string, document string, text string, status string, score double")
    assert "Generate" not in G.claim_evidence(claims, items, "k")._jdf.queryExecution().optimizedPlan().toString()
