"""Results that have to be those of the SQL where values lie on a limit, and work that must not grow with chance meetings."""

import math
import random

import pytest
from pyspark.sql import functions as F

from orebed.functions import text as T
from orebed.operators import decisions as D
from orebed.operators import diagnosis as G
from orebed.operators import graph
from orebed.operators import selection as R
from orebed.operators import series as S


@pytest.mark.parametrize("least", [0.3, 0.6, 1.0])
def test_linked_claims(spark, least):
    draw = random.Random(3)
    claims = {i: (sorted(draw.sample(range(14 if i % 3 else 40), draw.choice([1, 1, 2, 3, 4, 6, 9, 13]) if i % 3 else draw.randint(15, 30))), i % 2 == 0) for i in range(240)}
    got = {(r.a, r.b): (round(r.similarity, 9), r.relation) for r in R.linked_claims(spark.createDataFrame([(i, e, n) for i, (e, n) in claims.items()], "id int, e array<int>, neg boolean"), "id", "e", "neg", least).collect()}
    want = {}
    for a, (x, p) in claims.items():
        for b, (y, q) in claims.items():
            alike = len(set(x) & set(y)) / len(set(x) | set(y))
            if a < b and alike >= least:
                want[a, b] = round(alike, 9), "SUPPORTS" if p == q else "CONTRADICTS"
    assert got == want


def test_levels_of_any_depth(spark):
    edges = [(i, i + 1) for i in range(25)] + [(0, 25), (90, 91), (91, 90), (91, 92)]
    got = {r.node: r.level for r in graph.levels(spark.createDataFrame(edges, "cause int, effect int")).collect()}
    assert got == {i: i for i in range(26)} | {90: None, 91: None, 92: None}


def test_moments_are_summed_in_order(spark):
    draw = random.Random(5)
    rows = [(k, t, round(draw.uniform(0, 120), 2)) for k in range(400) for t in range(1 + k % 9)]
    got = {r.k: (r["mean"], r["std"]) for r in S.ordered_moments(spark.createDataFrame(rows, "k int, t int, value double").repartition(7), ["k"], "value", "t").collect()}
    for k in range(400):
        n = total = mean = m2 = 0.0
        for _, _, v in (r for r in rows if r[0] == k):
            n, total = n + 1, total + v
            new = mean + (v - mean) / n
            m2, mean = m2 + (v - new) * (v - mean), new
        assert got[k] == (total / n, math.sqrt(m2 / n))
    long = spark.range(1000).select(F.lit(1).alias("k"), F.col("id").alias("t"), F.col("id").cast("double").alias("value"))
    r = S.ordered_moments(long, ["k"], "value", "t").first()
    assert r["mean"] == pytest.approx(499.5) and r["std"] == pytest.approx(288.6749902572095)


def test_single_readings_have_no_slope(spark):
    rows = [("a", "x", 0, 0.0), ("a", "y", 0, 0.5), ("a", "y", 1, 2.5), ("a", "y", 2, 4.0)]
    df = spark.createDataFrame(rows, "u string, c string, t_idx int, z double")
    got = {r.c: r for r in G.fault_types(df, ["u", "c"]).collect()}
    assert math.isnan(got["x"].drift) and got["x"].strongest == "drift"
    health = {r.t_idx: r.health for r in G.health_index(df, ["u"], "c").collect()}
    assert health == {0: 0.0}  # the median is not a number either, so only x counts, without a direction


def test_equal_roots_go_by_name(spark):
    ranking = spark.createDataFrame([(u, v, s) for u in range(20) for v, s in (("b", 0.9), ("d", 0.9), ("a", 0.9), ("c", 0.1))], "unit int, variable string, score double").repartition(5)
    edges = spark.createDataFrame([(0, "x", "y")], "unit int, cause string, effect string")
    kinds = spark.createDataFrame([(1, "k", ["q"], ["r"])], "fault_id int, label string, roots array<string>, affected array<string>")
    assert {r.root for r in D.diagnosed(ranking, edges, "unit", kinds).collect()} == {"d"}


def test_rounding_is_duckdbs(spark, duck):
    from orebed.queries.base import rounded

    draw = random.Random(9)
    xs = [0.5024999999999999, 1704074901.5649, 0.0005, -0.0005, 2.5e-3, 1e300, float("inf"), 0.0] + [draw.choice([1, -1]) * round(draw.uniform(0, 2000), 4) + 5e-4 for _ in range(4000)]
    got = [r.y for r in spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double").withColumn("y", rounded(F.col("x"), 3)).orderBy("i").collect()]
    want = [r[0] for r in duck.execute("SELECT round(x, 3) FROM (SELECT unnest(?::DOUBLE[]) AS x)", [xs]).fetchall()]
    assert got == want


def test_patterns_match_as_in_re2(spark, duck):
    texts = ["12 Old Mill st\u00e9", "12 Old Mill st\u00e9 7 High road", "a@b.co\u00fc", "12\u00a0Old road", "3 Long\x0bMill st", "\u00e912 Old lane", "9 Oa\u212aley lane"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for pattern in T.PII.values():
        got = [r.n for r in df.select("i", F.regexp_count("t", F.lit(T.as_re2(pattern))).alias("n")).orderBy("i").collect()]
        want = [duck.execute("SELECT len(regexp_extract_all(?, ?))", [t, pattern]).fetchall()[0][0] for t in texts]
        assert got == want, pattern
