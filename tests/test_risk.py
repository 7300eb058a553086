"""Features of a response against Python's own patterns, and claims of work on worked cases."""

import re

import numpy as np
from orebed.operators import risk as K
from pyspark.sql import functions as F

NUM = re.compile(r"(?<!\w)[+-]?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?%?")
YEAR = re.compile(r"\b(?:18|19|20|21)\d{2}\b")
DAY = re.compile(rf"\b(?:\d{{1,2}}[/-]\d{{1,2}}[/-](?:\d{{2}}|\d{{4}})|(?:{K.MONTHS})\s+\d{{1,2}}(?:,\s*\d{{4}})?)\b", re.I)
NAME = re.compile(r"\b(?:[A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,4}|[A-Z]{2,})\b")


def words(t):
    return re.findall(r"\b[\w'-]+\b", t.lower())


def sents(t):
    return [s for s in re.split(r"(?<=[.!?])\s+(?=[A-Z0-9\"'])", " ".join(t.split())) if s]


def pieces(t, size):
    out, held = [], ""
    for p in filter(None, (p.strip() for p in re.split(r"\n\s*\n", t))):
        for u in sents(p) if len(p) > size else [p]:
            if held and len(held) + 1 + len(u) > size:
                out.append(held)
                held = u
            else:
                held = f"{held} {u}" if held else u
    return out + [held] if held else out


def within(a, b):
    return len(set(words(a)) & set(words(b))) / len(set(words(a))) if words(a) else 0.0


def days(t):
    return list(dict.fromkeys([d.lower().replace(",", "") for d in DAY.findall(t)] + YEAR.findall(t)))


def share(items, test):
    return sum(map(test, items)) / len(items) if items else 1.0


def plain(r, q, c, size):
    r, q, c = r or "", q or "", c or ""
    rw, rs, n = words(r), sents(r), [x.replace(",", "") for x in NUM.findall(r)]
    sup = [max((within(s, k) for k in pieces(c, size)), default=0.0) for s in rs] or [0.0]
    per = max(1, len(rs))
    return [len(r), len(rw), len(rs), len(rw) / per, r.count("?") / per, len(n), len(re.findall(r"\b\d+(?:\.\d+)?\s*%", r)), len(re.findall(r"[$€£₹]\s*\d|\b(?:USD|EUR|GBP|INR)\s*\d", r, re.I)), len(YEAR.findall(r)), len(days(r)), len(re.findall(r"https?://\S+|www\.\S+", r, re.I)), len(re.findall(K.CITATION, r)), len(NAME.findall(r)), sum(w in K.HEDGES for w in rw), sum(w in K.CERTAINTY for w in rw), len(q), len(words(q)), len(NAME.findall(q)), len(NUM.findall(q)), len(YEAR.findall(q)), float(any(w in K.CURRENT for w in words(q))), float(any(w in K.CITING for w in words(q))), within(r, c), min(sup), np.mean(sup), max(sup), share(NAME.findall(r), lambda e: e.lower() in c.lower()), share(n, lambda x: x in {v.replace(",", "") for v in NUM.findall(c)}), share(days(r), lambda d: d in days(c))]


def test_features(spark):
    rows = [
        ("Émile Zola said 1,234.5 or -7% in May 2021. Perhaps NASA's X-15 cost $ 5,000 (Smith et al., 2020)! It's \"never\" over?", "What is the LATEST on Zola, 1999?", "Émile Zola wrote. NASA flew.\n\n  In may 2021, 1,234.5 units.\n \nX-15's   cost"),
        (None, None, None), ("", "", ""), ("   \n ", "?", "\n\n"), ("ABc é5 5é 5% 12/3/99 x2020 2020x 2020", "cite 1850", "5% " * 300 + "End. " + "Another Sentence here. " * 60),
        ("-'- a-b 'tis o'clock' --", "now", "a-b\n\n" + "word " * 200 + "\n\no'clock 'tis"), ("Anna Bob Carl Dora Emil Fred Gus www.a.b HTTP://x USD5 eur 7.5 [12] [1234] March 3, 2020 1. Two 3! four? Five", "source", "anna bob carl dora emil"),
    ] + [("Long text. " * 3000 + "The End 42", "q", "Long text here. " * 2000 + "42")]
    table = spark.createDataFrame([(i, *r, "x") for i, r in enumerate(rows)], "id int, response string, query string, context string, _r string")
    got = K.risk_features(table, ["id"])
    assert len(got.columns) == 30
    for r in got.collect():
        np.testing.assert_allclose(list(r)[1:], plain(*rows[r.id], 800), rtol=1e-12, err_msg=str((r.id, got.columns)))
    assert K.risk_features(table.where("false"), ["id"]).count() == 0


def test_work(spark):
    claim = "No repair was performed on Pump-7 on 2024-03-05."
    responses = spark.createDataFrame([(1, "", claim), (2, "about pump-7", "Physical  work has been completed."), (3, "x", "All is well."), (4, None, None), (5, "", claim), (6, "", claim), (7, "", "Replacement was completed")], "k int, prompt string, response string")
    good = "Log 2024-03-05: no  repair was\nperformed, PUMP-7."
    evidence = [(1, good, "current", "work_order"), (1, good, None, "maintenance_history"), (2, "physical work has been completed at Pump-8", None, "operations_log"), (5, good, "Draft", "work_order"), (5, good, "current", "manual"), (5, good, "current", None), (6, good.replace("-05", "-06"), None, "inspection_report"), (6, None, None, "work_order"), (7, "replacement was completed", "", "WORK_ORDER 5"), (3, good, "", "work_order")]
    got = {r.k: (r.claimed, r.recorded) for r in K.work_records(responses, spark.createDataFrame(evidence, "k int, text string, status string, kind string"), "k").collect()}
    assert got == {1: (True, True), 2: (True, False), 3: (False, False), 4: (False, False), 5: (True, False), 6: (True, False), 7: (True, True)}
    said = ["Isolate the line; a check should follow.", "Shutdown is required", "You must not isolate it.", "Isolate it. It should do.", "A shutdown is historical. Perform a line-break!", None, ""]
    out = spark.createDataFrame([(i, t) for i, t in enumerate(said)], "i int, t string").select("i", K.consequential_action(F.col("t")).alias("a")).collect()
    assert [r.a for r in sorted(out)] == [True, True, False, False, True, False, False]
