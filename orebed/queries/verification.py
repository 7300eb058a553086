"""Anchored verdicts on statements about orders, and bearing decisions on line items as evidence."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from orebed.operators import verification as V
from orebed.queries.base import query, table


@query("anchored_verdict", """WITH l AS (SELECT l_orderkey, round(l_extendedprice * 100)::BIGINT * 10 + l_linenumber AS l_linenumber, l_quantity::INT AS n, CASE l_returnflag WHEN 'A' THEN 'accepted' WHEN 'R' THEN 'returned' ELSE 'new' END AS w FROM lineitem),
s AS (SELECT l_orderkey, l_linenumber, n, w, CASE WHEN w = 'returned' THEN 'Nothing else counted ' || n ELSE 'Crates ' || w || ' hold ' || n || ' pieces' END AS text FROM l),
c AS (SELECT o_orderkey AS l_orderkey, o_custkey % 50 + 1 AS n, o_orderkey % 9 = 0 AS limited, ['accepted', 'returned', 'new'][o_orderkey % 3 + 1] AS w FROM orders),
m AS (SELECT c.l_orderkey, s.text, l_linenumber, CASE WHEN s.n = c.n THEN 2 ELSE 1 END AS kind, CASE WHEN s.w = c.w THEN 1 ELSE 0.75 END AS share FROM c JOIN s USING (l_orderkey) WHERE NOT limited AND s.w <> 'returned'),
b AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY kind DESC, share DESC, l_linenumber) = 1)
SELECT l_orderkey, 1 AS claim, CASE WHEN kind = 2 THEN 'SUPPORTED' ELSE 'UNKNOWN' END AS status, CASE WHEN kind = 2 THEN 0.98::DOUBLE ELSE 0 END AS confidence, CASE WHEN limited THEN 'comparison_requires_context' WHEN kind = 2 THEN 'numeric_exact' WHEN kind = 1 THEN 'numeric_conflict_candidate' ELSE 'numeric_unresolved' END AS method, b.text AS evidence FROM c LEFT JOIN b USING (l_orderkey)""", "confidence")
def anchored_verdict(spark, sf_dir):
    """What orders claim to hold against what their line items say."""
    word = F.when(F.col("l_returnflag") == "A", "accepted").when(F.col("l_returnflag") == "R", "returned").otherwise("new")
    n = F.col("l_quantity").cast("int").cast("string")
    text = F.when(word == "returned", F.concat(F.lit("Nothing else counted "), n)).otherwise(F.concat(F.lit("Crates "), word, F.lit(" hold "), n, F.lit(" pieces")))
    said = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.round(F.col("l_extendedprice") * 100).cast("long") * 10 + F.col("l_linenumber")).alias("sentence"), text.alias("text"))
    kind = F.element_at(F.array(F.lit("accepted"), F.lit("returned"), F.lit("new")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    count = (F.col("o_custkey") % 50 + 1).cast("string")
    claim = F.when(F.col("o_orderkey") % 9 == 0, F.concat(F.lit("Crates hold more, above the limit of "), count)).otherwise(F.concat(F.lit("Crates "), kind, F.lit(" hold "), count, F.lit(" pieces")))
    claims = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(1).alias("claim"), claim.alias("text"))
    return V.anchored_verdict(claims, said, "l_orderkey")


@query("bearing_policy", """WITH e AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_quantity < 3 THEN 'too_short' WHEN l_quantity < 9 THEN 'mild' END AS flag, 2 + l_quantity / 10 AS kurtosis, l_quantity / 10 AS crest, l_linenumber <> 5 AS band, l_suppkey % 4 > 0 AS freq, CASE WHEN l_partkey % 6 < 5 THEN ['BPFO', 'BPFI', 'BSF', 'FTF', 'odd'][l_partkey % 6 + 1] END AS fault, l_partkey % 5 AS harmonics, l_discount * 8 AS strength, l_tax * 10 AS separation, l_quantity / 50 AS conf, CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN 'ambiguous' END AS why FROM lineitem),
s AS (SELECT *, CASE WHEN flag = 'too_short' THEN 'signal_quality' WHEN NOT band THEN 'no_resonance_band' WHEN NOT freq THEN 'no_fault_frequencies' ELSE 'fused' END AS stage, greatest(0, least(1, greatest(kurtosis - 3, 0) / 7)) AS imp FROM e),
r AS (SELECT *, CASE WHEN stage <> 'fused' THEN stage WHEN fault IS NOT NULL AND harmonics < 2 THEN 'too_few_harmonics' WHEN why IS NOT NULL THEN why WHEN conf < 0.45 THEN 'low_confidence' END AS abstain_reason, CASE stage WHEN 'fused' THEN greatest(0, least(1, greatest(strength, imp))) WHEN 'no_fault_frequencies' THEN imp END AS score FROM s)
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN abstain_reason IS NULL THEN 'diagnose' ELSE 'abstain' END AS decision, CASE stage WHEN 'fused' THEN score >= 0.35 WHEN 'no_fault_frequencies' THEN kurtosis > 3.5 OR crest > 4 END AS abnormal, score::DOUBLE AS score, (CASE stage WHEN 'fused' THEN conf WHEN 'signal_quality' THEN 0 WHEN 'no_resonance_band' THEN 0.1 ELSE 0.2 END)::DOUBLE AS confidence,
CASE WHEN stage = 'fused' AND fault IS NOT NULL THEN 1 - greatest(0, least(1, separation)) END::DOUBLE AS uncertainty, CASE WHEN abstain_reason IS NULL THEN CASE fault WHEN 'BPFO' THEN 'outer_race' WHEN 'BPFI' THEN 'inner_race' WHEN 'BSF' THEN 'rolling_element' WHEN 'FTF' THEN 'cage' ELSE fault END END AS component, abstain_reason FROM r""", "score confidence uncertainty")
def bearing_policy(spark, sf_dir):
    c = F.col
    fault = F.when(c("l_partkey") % 6 < 5, F.element_at(F.array(*[F.lit(x) for x in ("BPFO", "BPFI", "BSF", "FTF", "odd")]), (F.least(c("l_partkey") % 6, F.lit(4)) + 1).cast("int")))
    q = c("l_quantity").cast("double")
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.when(q < 3, F.array(F.lit("too_short"))).when(q < 9, F.array(F.lit("mild"))).alias("quality_flags"), (2 + q / 10).alias("kurtosis"), (q / 10).alias("crest"), (c("l_linenumber") != 5).alias("band"), (c("l_suppkey") % 4 > 0).alias("frequencies"), fault.alias("best_fault"), (c("l_partkey") % 5).cast("int").alias("harmonics"),
        (c("l_discount").cast("double") * 8).alias("strength"), (c("l_tax").cast("double") * 10).alias("separation"), (q / 50).alias("fused_confidence"), fault.alias("label"), F.when((c("l_returnflag") == "R") & (c("l_linestatus") == "O"), "ambiguous").alias("fused_reason"),
    )
    return V.bearing_policy(rows, ["l_orderkey", "l_linenumber", "l_partkey"])


@query("battery_verdict", """WITH c AS (SELECT user_id, event_type, 2 + value / 50 AS v, value - 10 AS t, value - avg(value) OVER (PARTITION BY user_id) AS dv, (value - median(value) OVER (PARTITION BY user_id)) * 2 AS dt FROM events),
e AS (SELECT user_id, event_type, bool_and(v BETWEEN 1.5 AND 5.5 AND t BETWEEN -50 AND 120) AS ok, median(abs(dv)) AS mv, median(abs(dt)) AS mt FROM c GROUP BY ALL),
s AS (SELECT *, round(greatest(mv / greatest(max(mv) OVER w, 1e-12), mt / greatest(max(mt) OVER w, 1e-12)), 9) AS share FROM e WINDOW w AS (PARTITION BY user_id)),
g AS (SELECT user_id, bool_and(ok) AS bounds_hold, arg_min(event_type, {'s': -share, 'c': event_type}) AS dominant_cell FROM s GROUP BY user_id)
SELECT user_id, CASE WHEN NOT bounds_hold THEN 'CONTRADICTED' WHEN user_id % 4 > 0 AND dominant_cell = ['click', 'error', 'purchase', 'signup', 'view'][user_id % 5 + 1] THEN 'SUPPORTED' ELSE 'INSUFFICIENT' END AS status, bounds_hold, dominant_cell FROM g""")
def battery_verdict(spark, sf_dir):
    """Users as packs, event types as cells."""
    ev, own = table(spark, sf_dir, "events"), Window.partitionBy("user_id")
    v = F.col("value")
    cells = ev.select("user_id", F.col("event_type").alias("cell"), (2 + v / 50).alias("voltage"), (v - 10).alias("temperature"), (v - F.avg("value").over(own)).alias("delta_voltage"), ((v - F.median("value").over(own)) * 2).alias("delta_temperature"))
    named = F.element_at(F.array(*[F.lit(x) for x in ("click", "error", "purchase", "signup", "view")]), (F.col("user_id") % 5 + 1).cast("int"))
    return V.battery_verdict(cells, ev.select("user_id").distinct().select("user_id", named.alias("top_cell"), (F.col("user_id") % 4 > 0).alias("abnormal")), "user_id")


@query("turbofan_verdict", """WITH s AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS cycle, value AS health FROM events),
g AS (SELECT user_id, CASE WHEN count(health) > 2 AND stddev_pop(health) > 1e-12 THEN coalesce(corr(cycle, health), 0) ELSE 0 END AS correlation, regr_slope(health, cycle) AS slope, count(*) - 55 AS left_ FROM s GROUP BY user_id)
SELECT user_id, CASE WHEN user_id % 6 > 0 AND left_ < 0 THEN 'CONTRADICTED' WHEN user_id % 2 = 0 AND slope > 0 AND correlation > 0.25 THEN 'SUPPORTED' ELSE 'INSUFFICIENT' END AS status, correlation FROM g""", "correlation")
def turbofan_verdict(spark, sf_dir):
    """Users as engines, their events as cycles; every sixth has no life estimate."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    health = table(spark, sf_dir, "events").select("user_id", F.row_number().over(w).alias("cycle"), F.col("value").alias("health"))
    made = health.groupBy("user_id").agg(F.regr_slope("health", "cycle").alias("slope"), (F.count(F.lit(1)) - 55).alias("_left"))
    return V.turbofan_verdict(health, made.select("user_id", "slope", F.when(F.col("user_id") % 6 > 0, F.col("_left")).alias("rul"), (F.col("user_id") % 2 == 0).alias("abnormal")), "user_id")


@query("transformer_verdict", """WITH o AS (SELECT l_orderkey, max(l_discount) * 4 AS score, 2 + max(l_quantity) / 20 AS kurtosis, count(*) AS n, count(*) FILTER (l_tax > 0.05) AS heavy, count(*) FILTER (l_discount > 1e-9) AS active FROM lineitem GROUP BY 1),
s AS (SELECT *, active >= least(2, n) AND heavy >= least(2, n) AS several_sensors FROM o)
SELECT l_orderkey, CASE WHEN l_orderkey % 5 = 0 AND score < 0.3 THEN 'CONTRADICTED' WHEN score >= 0.3 AND score >= 0.25 AND kurtosis > 3 AND several_sensors THEN 'SUPPORTED' ELSE 'INSUFFICIENT' END AS status, several_sensors FROM s""")
def transformer_verdict(spark, sf_dir):
    """Orders as transformers, their line items as sensors."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg((F.max("l_discount") * 4).alias("anomaly_score"), (2 + F.max("l_quantity") / 20).alias("kurtosis"), F.collect_list("l_tax").alias("weights"), F.collect_list("l_discount").alias("deviations"))
    return V.transformer_verdict(rows.withColumn("label", F.when(F.col("l_orderkey") % 5 == 0, "short")).withColumn("abnormal", F.col("anomaly_score") >= 0.3), ["l_orderkey"])
