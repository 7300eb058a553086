"""Selections, joins, sets and closed forms over the star schema and over events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from orebed.operators import selection as R
from orebed.queries.base import EVENTS_SQL, PART, SERIES, query, series, table


@query("summarize_numbers", "SELECT l_returnflag, count(l_quantity) AS n, sum(l_quantity) AS total, min(l_quantity) AS low, max(l_quantity) AS high, avg(l_quantity) AS mean, median(l_quantity) AS middle FROM lineitem GROUP BY 1", "total mean middle")
def summarize_numbers(spark, sf_dir):
    x = "l_quantity"
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count(x).alias("n"), F.sum(x).alias("total"), F.min(x).alias("low"), F.max(x).alias("high"), F.avg(x).alias("mean"), F.median(x).alias("middle"))


@query("rollup_totals", "SELECT l_returnflag, l_linestatus, grouping(l_returnflag) + grouping(l_linestatus) AS level, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)", "quantity")
def rollup_totals(spark, sf_dir):
    out = table(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus")
    return out.agg((F.grouping("l_returnflag") + F.grouping("l_linestatus")).cast("long").alias("level"), F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity"))


@query("rank_functions", "SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER v AS rk, dense_rank() OVER v AS dr, ntile(4) OVER w AS quarter FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey), v AS (PARTITION BY o_custkey ORDER BY o_orderpriority)")
def rank_functions(spark, sf_dir):
    w, v = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"), Window.partitionBy("o_custkey").orderBy("o_orderpriority")
    kinds = {"rn": F.row_number().over(w), "rk": F.rank().over(v), "dr": F.dense_rank().over(v), "quarter": F.ntile(4).over(w)}
    return table(spark, sf_dir, "orders").select("o_orderkey", *[c.cast("long").alias(k) for k, c in kinds.items()])


SPANS_SQL = "spans AS (SELECT user_id, min(ts) AS s, min(ts) + INTERVAL 3 DAY AS e FROM events WHERE event_type = 'error' GROUP BY user_id)"


def error_spans(spark, sf_dir):
    return table(spark, sf_dir, "events").where("event_type = 'error'").groupBy("user_id").agg(F.min("ts").alias("s"), (F.min("ts") + F.expr("INTERVAL 3 DAYS")).alias("e"))


@query("event_window_join", f"WITH {SPANS_SQL} SELECT event_id, user_id FROM events JOIN spans USING (user_id) WHERE ts BETWEEN s AND e")
def event_window_join(spark, sf_dir):
    return R.within(table(spark, sf_dir, "events").select("event_id", "user_id", "ts"), error_spans(spark, sf_dir), ["user_id"], "ts", "s", "e").select("event_id", "user_id")


@query("interval_overlap", "WITH s AS (SELECT l_orderkey, l_linenumber, min(l_shipdate) AS s, min(l_shipdate) + INTERVAL 10 DAY AS e FROM lineitem GROUP BY ALL) SELECT x.l_orderkey, x.l_linenumber AS a, y.l_linenumber AS b FROM s x JOIN s y ON x.l_orderkey = y.l_orderkey AND x.l_linenumber < y.l_linenumber AND x.s <= y.e AND y.s <= x.e")
def interval_overlap(spark, sf_dir):
    spans = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_shipdate").alias("s")).withColumn("e", F.col("s") + F.expr("INTERVAL 10 DAYS"))
    return R.overlapping(spans, ["l_orderkey"], "l_linenumber", "s", "e")


@query("budget_selection", "SELECT o_custkey, o_orderkey, spent FROM (SELECT *, sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderkey ROWS UNBOUNDED PRECEDING) AS spent FROM orders) WHERE spent <= 500000", "spent", digits=2)
def budget_selection(spark, sf_dir):
    """Orders by priority while the customer's budget lasts."""
    return R.within_budget(table(spark, sf_dir, "orders"), ["o_custkey"], [F.asc("o_orderpriority"), F.asc("o_orderkey")], "o_totalprice", 500_000).select("o_custkey", "o_orderkey", "spent")


@query("screening", """WITH e AS (SELECT *, max((o_orderstatus = 'O')::INT) OVER (PARTITION BY o_custkey) = 1 AS has_open FROM orders),
k AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS "rank" FROM e WHERE NOT has_open OR o_orderstatus = 'O') SELECT o_custkey, o_orderkey, "rank" FROM k WHERE "rank" <= 3""")
def screening(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumn("open", F.col("o_orderstatus") == "O")
    return R.eligible_or_all(orders, ["o_custkey"], "open", [F.desc("o_totalprice"), F.asc("o_orderkey")], 3).select("o_custkey", "o_orderkey", "rank")


@query("rank_margin", "SELECT o_custkey, o_orderkey, o_totalprice, margin FROM (SELECT *, o_totalprice - lead(o_totalprice) OVER w AS margin, row_number() OVER w AS r FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)) WHERE r = 1", "margin", digits=2)
def rank_margin(spark, sf_dir):
    return R.margins(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderkey", "o_totalprice").select("o_custkey", "o_orderkey", "o_totalprice", "margin")


@query("multi_query_merge", "SELECT l_partkey, max(s) AS s FROM (SELECT l_partkey, l_discount AS s FROM lineitem WHERE l_returnflag = 'A' UNION ALL SELECT l_partkey, l_tax FROM lineitem WHERE l_returnflag = 'R') GROUP BY 1")
def multi_query_merge(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return R.best_of([li.where("l_returnflag = 'A'").select("l_partkey", F.col("l_discount").alias("s")), li.where("l_returnflag = 'R'").select("l_partkey", F.col("l_tax").alias("s"))], ["l_partkey"], "s")


CLAIMS_SQL = "c AS (SELECT o_orderkey, array_agg(DISTINCT l_suppkey ORDER BY l_suppkey) AS e, any_value(o_orderstatus) = 'F' AS neg FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)"


@query("claim_relations", f"""WITH {CLAIMS_SQL}, x AS (SELECT o_orderkey AS id, unnest(e) AS s FROM c), p AS (SELECT a.id AS a, b.id AS b, count(*) AS n FROM x a JOIN x b ON a.s = b.s AND a.id < b.id GROUP BY ALL)
SELECT a, b, n / (len(l.e) + len(r.e) - n) AS similarity, CASE WHEN l.neg = r.neg THEN 'SUPPORTS' ELSE 'CONTRADICTS' END AS relation FROM p JOIN c l ON l.o_orderkey = a JOIN c r ON r.o_orderkey = b WHERE n / (len(l.e) + len(r.e) - n) >= 0.6""", "similarity")
def claim_relations(spark, sf_dir):
    """Orders as claims about suppliers."""
    claims = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_orderkey").agg(F.collect_set("l_suppkey").alias("e"), (F.first("o_orderstatus") == "F").alias("neg"))
    return R.linked_claims(claims, "o_orderkey", "e", "neg")


@query("set_operations", """WITH a AS (SELECT DISTINCT l_suppkey AS k FROM lineitem WHERE l_discount > 0.09), b AS (SELECT DISTINCT l_suppkey AS k FROM lineitem WHERE l_tax > 0.07)
SELECT 'both' AS part, count(*) AS n FROM (SELECT k FROM a INTERSECT SELECT k FROM b) UNION ALL SELECT 'left', count(*) FROM (SELECT k FROM a EXCEPT SELECT k FROM b) UNION ALL SELECT 'any', count(*) FROM (SELECT k FROM a UNION SELECT k FROM b)""")
def set_operations(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    a, b = li.where("l_discount > 0.09").select("l_suppkey"), li.where("l_tax > 0.07").select("l_suppkey")
    parts = {"both": a.intersect(b), "left": a.distinct().subtract(b), "any": a.union(b).distinct()}
    out = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("part"), "n") for k, df in parts.items()]
    return out[0].union(out[1]).union(out[2])


@query("value_sets", "WITH g AS (SELECT l_orderkey, list_distinct(list(l_returnflag)) AS f FROM lineitem GROUP BY 1) SELECT l_orderkey, list_has_all(['A', 'N'], f) AS is_subset, NOT list_has_any(f, ['R']) AS is_disjoint FROM g")
def value_sets(spark, sf_dir):
    flags = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("f"))
    return flags.select("l_orderkey", (F.size(F.array_except("f", F.array(F.lit("A"), F.lit("N")))) == 0).alias("is_subset"), (~F.arrays_overlap("f", F.array(F.lit("R")))).alias("is_disjoint"))


@query("stable_hash", "SELECT p_partkey, sha256(concat_ws('|', p_brand, p_type, p_size::VARCHAR)) AS checksum FROM part")
def stable_hash(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.sha2(F.concat_ws("|", "p_brand", "p_type", F.col("p_size").cast("string")), 256).alias("checksum"))


@query("bearing_frequencies", """WITH p AS (SELECT p_partkey, p_size + 6 AS n, 0.2 + 0.001 * p_size AS r, p_retailprice / 60 AS f FROM part)
SELECT p_partkey, f / 2 * (1 - r) AS cage, n * f / 2 * (1 - r) AS outer_race, n * f / 2 * (1 + r) AS inner_race, f / (2 * r) * (1 - r * r) AS ball FROM p""", "cage outer_race inner_race ball")
def bearing_frequencies(spark, sf_dir):
    """Characteristic frequencies at zero contact angle; r is ball by pitch diameter, f shaft turns a second."""
    n, r, f = F.col("p_size") + 6, 0.2 + 0.001 * F.col("p_size"), F.col("p_retailprice") / 60
    return table(spark, sf_dir, "part").select("p_partkey", (f / 2 * (1 - r)).alias("cage"), (n * f / 2 * (1 - r)).alias("outer_race"), (n * f / 2 * (1 + r)).alias("inner_race"), (f / (2 * r) * (1 - r * r)).alias("ball"))


@query("frequency_match", """WITH t AS (SELECT p_brand, unnest([1, 2, 3]) AS harmonic, avg(p_retailprice) AS f FROM part GROUP BY p_brand), l AS (SELECT l_orderkey, l_linenumber, l_extendedprice / l_quantity AS x FROM lineitem)
SELECT p_brand, harmonic, count(*) AS n FROM t JOIN l ON abs(x - harmonic * f) <= 0.001 * harmonic * f GROUP BY ALL""")
def frequency_match(spark, sf_dir):
    """Peaks near the harmonics of target frequencies: both sides meet in bins of a logarithmic scale, so that no pair beyond neighbouring bins is formed."""
    tol, width = 0.001, 0.004
    targets = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.avg("p_retailprice").alias("f")).select("p_brand", F.explode(F.array(*[F.lit(h) for h in (1, 2, 3)])).alias("harmonic"), "f")
    targets = targets.withColumn("at", F.col("harmonic") * F.col("f")).withColumn("bin", F.explode(F.transform(F.array(*[F.lit(d) for d in (-1, 0, 1)]), lambda d: F.floor(F.log("at") / width) + d)))
    peaks = table(spark, sf_dir, "lineitem").select((F.col("l_extendedprice") / F.col("l_quantity")).alias("x")).withColumn("bin", F.floor(F.log("x") / width))
    return peaks.join(targets, "bin").where(F.abs(F.col("x") - F.col("at")) <= tol * F.col("at")).groupBy("p_brand", "harmonic").agg(F.count(F.lit(1)).alias("n"))


@query("linear_rul", f"""WITH {EVENTS_SQL}, f AS (SELECT user_id, event_type, regr_slope(value, t_idx) AS slope, regr_intercept(value, t_idx) AS intercept, max(t_idx) AS last, count(*) AS n FROM ev GROUP BY ALL HAVING count(*) >= 3)
SELECT user_id, event_type, slope, CASE WHEN slope > 1e-9 THEN greatest(0, (100 - intercept) / slope - last) END AS remaining FROM f""", "slope remaining", digits=3)
def linear_rul(spark, sf_dir):
    """Steps until a rising line through each series reaches 100; null where it doesn't rise."""
    x = series(spark, sf_dir).groupBy(*SERIES).agg(F.regr_slope("value", "t_idx").alias("slope"), F.regr_intercept("value", "t_idx").alias("intercept"), F.max("t_idx").alias("last"), F.count(F.lit(1)).alias("n")).where("n >= 3")
    return x.select(*SERIES, "slope", F.when(F.col("slope") > 1e-9, F.greatest(F.lit(0.0), (100 - F.col("intercept")) / F.col("slope") - F.col("last"))).alias("remaining"))


@query("phasors", f"""WITH {EVENTS_SQL}, a AS (SELECT user_id, event_type, value, n, 2 * pi() * t_idx / n AS a FROM ev)
SELECT user_id, event_type, 2 / any_value(n) * sum(value * cos(a)) AS re, -2 / any_value(n) * sum(value * sin(a)) AS im FROM a GROUP BY ALL""", "re im", digits=4)
def phasors(spark, sf_dir):
    return R.phasor(SERIES, "value", "t_idx", 1.0, series(spark, sf_dir))


@query("json_pointer_match", "SELECT event_id, abs((props->>'k')::DOUBLE - value) <= 5 AS agrees FROM events")
def json_pointer_match(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", (F.abs(F.get_json_object("props", "$.k").cast("double") - F.col("value")) <= 5).alias("agrees"))


@query("verification_summary", """WITH c AS (SELECT o_custkey, count(*) AS n, avg((o_orderstatus = 'F')::INT) AS support, avg((o_orderstatus = 'P')::INT) AS contradiction, avg(o_totalprice) FILTER (o_orderstatus = 'F') / 600000 AS confidence FROM orders GROUP BY 1)
SELECT o_custkey, n, support, contradiction, greatest(0, least(1, support * coalesce(confidence, 0) * (1 - contradiction))) AS score FROM c""", "support contradiction score")
def verification_summary(spark, sf_dir):
    share = lambda s: F.avg((F.col("o_orderstatus") == s).cast("int"))
    c = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), share("F").alias("support"), share("P").alias("contradiction"), (F.avg(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))) / 600000).alias("confidence"))
    score = F.col("support") * F.coalesce("confidence", F.lit(0.0)) * (1 - F.col("contradiction"))
    return c.select("o_custkey", "n", "support", "contradiction", F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)).alias("score"))


@query("cache_stats", """WITH a AS (SELECT user_id, event_type, ts, lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS before FROM events)
SELECT event_type, count(*) AS n, count(*) FILTER (before IS NOT NULL AND ts <= before + INTERVAL 1 DAY) AS hits, count(*) FILTER (before IS NOT NULL AND ts > before + INTERVAL 1 DAY) AS expired FROM a GROUP BY 1""")
def cache_stats(spark, sf_dir):
    """Hits of a cache whose entries live for a day after their last use."""
    a = table(spark, sf_dir, "events").withColumn("before", F.lag("ts").over(Window.partitionBy(*SERIES).orderBy("ts", "event_id")))
    end = F.col("before") + F.expr("INTERVAL 1 DAY")
    return a.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("ts") <= end, 1)).alias("hits"), F.count(F.when(F.col("ts") > end, 1)).alias("expired"))


@query("session_gaps", """WITH g AS (SELECT *, coalesce(ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 12 HOUR, true)::INT AS is_first FROM events), s AS (SELECT *, sum(is_first) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS started, count(*) AS n, max(value) AS peak FROM s GROUP BY user_id, k""")
def session_gaps(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "12 hours").alias("w")).agg(F.min("ts").alias("started"), F.count(F.lit(1)).alias("n"), F.max("value").alias("peak")).drop("w")


@query("robust_diagnosis", f"""WITH {EVENTS_SQL}, m AS (SELECT event_type, median(value) AS c FROM events GROUP BY 1), d AS (SELECT event_type, any_value(c) AS c, greatest(median(abs(value - c)), 0.25 * stddev_pop(value), 1e-6) AS s FROM events JOIN m USING (event_type) GROUP BY 1),
z AS (SELECT user_id, event_type, avg((value - c) / s) AS z FROM ev JOIN d USING (event_type) GROUP BY ALL)
SELECT user_id, arg_max(event_type, (abs(z), event_type)) AS leading, max(abs(z)) AS score, CASE WHEN max(abs(z)) >= 2 THEN 'abnormal' WHEN max(abs(z)) >= 1 THEN 'watch' ELSE 'normal' END AS decision FROM z GROUP BY user_id""", "score")
def robust_diagnosis(spark, sf_dir):
    """The feature of each asset farthest from its median in robust scales, and the decision on it."""
    ev = table(spark, sf_dir, "events")
    center = ev.groupBy("event_type").agg(F.median("value").alias("c"))
    scale = ev.join(F.broadcast(center), "event_type").groupBy("event_type").agg(F.first("c").alias("c"), F.greatest(F.median(F.abs(F.col("value") - F.col("c"))), 0.25 * F.stddev_pop("value"), F.lit(1e-6)).alias("s"))  # one row per event type
    z = ev.join(F.broadcast(scale), "event_type").groupBy(*SERIES).agg(F.abs(F.avg((F.col("value") - F.col("c")) / F.col("s"))).alias("z"))
    top = z.groupBy("user_id").agg(F.max_by("event_type", F.struct("z", "event_type")).alias("leading"), F.max("z").alias("score"))
    return top.withColumn("decision", F.when(F.col("score") >= 2, "abnormal").when(F.col("score") >= 1, "watch").otherwise("normal"))


@query("sudden_jumps", f"WITH {EVENTS_SQL} SELECT event_id, coalesce(value > 1.5 * avg(value) OVER ({PART} ORDER BY t_idx ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), false) AS jumped FROM ev")
def sudden_jumps(spark, sf_dir):
    w = Window.partitionBy(*SERIES).orderBy("t_idx").rowsBetween(-5, -1)
    return series(spark, sf_dir).select("event_id", F.coalesce(F.col("value") > 1.5 * F.avg("value").over(w), F.lit(False)).alias("jumped"))
