"""Diagnosis operators over events: units are users, channels are event types, readings are values by time."""

from __future__ import annotations

from pyspark.sql import functions as F

from orebed.operators import diagnosis as D
from orebed.operators import series as S
from orebed.queries.base import EVENTS_SQL, SERIES, query, series, table
from orebed.queries.series import RUN_SQL, Z_SQL, zscored

PERSIST_SQL = f"{Z_SQL}, flagged AS (SELECT *, coalesce(abs(z) > 1.0, false) AS alarm FROM z), {RUN_SQL}, kept AS (SELECT user_id, event_type, t_idx FROM runs WHERE place >= 2)"
ANY_SQL = f"{PERSIST_SQL}, any_alarm AS (SELECT user_id, t_idx, bool_or(kept.t_idx IS NOT NULL) AS alarm, max(abs(z)) AS score FROM z LEFT JOIN kept USING (user_id, event_type, t_idx) GROUP BY ALL)"


def any_alarms(spark, sf_dir):
    return D.residual_alarms(zscored(spark, sf_dir), ["user_id"], "event_type", 1.0, 2)


@query("fault_mask", f"WITH {EVENTS_SQL} SELECT event_id, t_idx >= 5 AND user_id % 3 <> 0 AS faulty FROM ev")
def fault_mask(spark, sf_dir):
    return D.fault_mask(series(spark, sf_dir).withColumn("fault", F.col("user_id") % 3), "fault", 5).select("event_id", "faulty")


@query("residual_scaled", f"WITH {EVENTS_SQL}, r AS (SELECT *, value - avg(value) OVER (PARTITION BY event_type) AS residual FROM ev) SELECT event_id, residual, residual / (stddev_pop(residual) OVER (PARTITION BY user_id, event_type) + 1e-12::DOUBLE) AS scaled FROM r", "residual scaled")
def residual_scaled(spark, sf_dir):
    """Readings against the mean of their type, which is joined as a grouped table."""
    rows = series(spark, sf_dir)
    return D.residuals(rows.join(rows.groupBy("event_type").agg(F.avg("value").alias("expected")), "event_type"), SERIES, "expected").select("event_id", "residual", "scaled")


@query("residual_alarms", f"WITH {ANY_SQL} SELECT * FROM any_alarm", "score")
def residual_alarms(spark, sf_dir):
    return any_alarms(spark, sf_dir)


@query("alarm_decision", f"""WITH {ANY_SQL}, g AS (SELECT user_id, avg((score > 2.0)::INT) AS alarm_fraction, quantile_cont(score, 0.95) AS q95 FROM any_alarm GROUP BY user_id)
SELECT *, greatest(0.05::DOUBLE, least(0.95::DOUBLE, greatest(4 * alarm_fraction, q95 / 8))) AS confidence, CASE WHEN alarm_fraction >= 0.05 THEN 'diagnose' ELSE 'monitor' END AS decision FROM g""", "alarm_fraction q95 confidence")
def alarm_decision(spark, sf_dir):
    return D.alarm_decision(any_alarms(spark, sf_dir), ["user_id"], limit=2.0)


@query("contribution_ranking", f"""WITH {PERSIST_SQL}, f AS (SELECT z.*, kept.t_idx IS NOT NULL AS hit FROM z LEFT JOIN kept USING (user_id, event_type, t_idx)),
a AS (SELECT *, bool_or(hit) OVER (PARTITION BY user_id) AS has, max(t_idx) OVER (PARTITION BY user_id, event_type) AS last FROM f),
c AS (SELECT user_id, event_type, avg(z * z) AS c FROM a WHERE CASE WHEN has THEN hit ELSE t_idx > last - 20 END GROUP BY ALL),
s AS (SELECT user_id, event_type, c / (sum(c) OVER (PARTITION BY user_id) + 1e-12::DOUBLE) AS contribution, count(*) OVER (PARTITION BY user_id) AS n FROM c)
SELECT user_id, event_type, contribution, row_number() OVER (PARTITION BY user_id ORDER BY round(contribution, 9) DESC, event_type) AS rank, contribution >= greatest(0.1::DOUBLE, 1 / (2 * n)) AS suspect FROM s""", "contribution")
def contribution_ranking(spark, sf_dir):
    z = zscored(spark, sf_dir)
    marked = S.alarm_persistence(z.withColumn("alarm", F.coalesce(F.abs("z") > 1.0, F.lit(False))), SERIES, "alarm", 2)
    return D.contributions(marked, ["user_id"], "event_type", "persistent", "z").select("user_id", "event_type", "contribution", "rank", "suspect")


@query("monitor_arbitration", f"""WITH {Z_SQL}, g AS (SELECT user_id, avg(coalesce(abs(z) > 1.5, false)::INT) AS fast_fraction, avg(coalesce(abs(z) > 2.2, false)::INT) AS confirming_fraction FROM z GROUP BY user_id)
SELECT *, CASE WHEN confirming_fraction >= 0.05 OR fast_fraction >= 0.2 THEN 'confirmed_fault' WHEN fast_fraction >= 0.05 THEN 'early_warning' ELSE 'normal' END AS status FROM g""", "fast_fraction confirming_fraction")
def monitor_arbitration(spark, sf_dir):
    z = zscored(spark, sf_dir).select("user_id", F.coalesce(F.abs("z") > 1.5, F.lit(False)).alias("fast"), F.coalesce(F.abs("z") > 2.2, F.lit(False)).alias("slow"))
    return D.arbitrate(z, ["user_id"], "fast", "slow")


@query("frequency_fusion", """WITH r AS (SELECT l_partkey % 500 AS unit, l_returnflag AS fault, sum(l_discount) AS score, sum(l_tax) AS carrier, count(*) AS n FROM lineitem GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY -score, fault) AS r FROM r),
g AS (SELECT unit, max(fault) FILTER (r = 1) AS label, max(score) FILTER (r = 1) AS best, max(score) FILTER (r = 2) AS second, max(carrier) FILTER (r = 1) AS carrier, max(n) FILTER (r = 1) AS n FROM k WHERE r <= 2 GROUP BY unit),
f AS (SELECT l_partkey % 500 AS unit, 3 + stddev_pop(l_quantity) / 5 AS kurtosis, max(l_quantity) / 10 AS crest, count(*) % 2 = 0 AS has_band FROM lineitem GROUP BY ALL),
s AS (SELECT unit, label, best, second, n, has_band, 1 - exp(-carrier / 2.5) AS strength, greatest(0, (best - coalesce(second, 0)) / greatest(best, 1e-12)) AS separation,
  greatest(0, least(1, 0.55 * greatest(0, kurtosis - 3) / 7 + 0.45 * greatest(0, crest - 3) / 7)) AS impulsiveness FROM g JOIN f USING (unit)),
d AS (SELECT *, CASE WHEN n < 2 THEN 'few_harmonics' WHEN strength < 0.35 THEN 'weak' WHEN separation < 0.08 AND second IS NOT NULL THEN 'not_separated' END AS abstain_reason FROM s)
SELECT unit, CASE WHEN abstain_reason IS NULL THEN label END AS label, greatest(0, least(0.99, 0.5 * strength + 0.25 * separation + 0.15 * impulsiveness + 0.1 * has_band::INT)) AS confidence,
greatest(0, least(1, 0.65 * strength + 0.35 * impulsiveness)) AS severity, abstain_reason, strength, separation, impulsiveness FROM d""", "confidence severity strength separation impulsiveness")
def frequency_fusion(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumn("unit", F.col("l_partkey") % 500)
    ranking = li.groupBy("unit", F.col("l_returnflag").alias("fault")).agg(F.sum("l_discount").alias("score"), F.sum("l_tax").alias("carrier"), F.count(F.lit(1)).alias("n"))
    features = li.groupBy("unit").agg((3 + F.stddev_pop("l_quantity") / 5).alias("kurtosis"), (F.max("l_quantity") / 10).alias("crest"), (F.count(F.lit(1)) % 2 == 0).alias("has_band"))
    return D.fuse_frequencies(ranking, ["unit"], "fault", "score", "carrier", "n", features)


GROUPS = {"disturbance": ["click", "view"], "asymmetry": ["purchase", "signup"], "internal": ["error", "click"]}


@query("transformer_rules", """WITH f AS (SELECT user_id, event_type, avg(value) AS value FROM events GROUP BY ALL),
m AS (SELECT event_type, median(value) AS center, stddev_pop(value) AS std FROM f GROUP BY event_type),
r AS (SELECT event_type, any_value(center) AS center, greatest(1.4826 * median(abs(value - center)), 0.25 * any_value(std), 1e-6) AS scale FROM f JOIN m USING (event_type) GROUP BY event_type),
z AS (SELECT user_id, event_type, abs((value - center) / scale) AS z FROM f JOIN r USING (event_type)),
g AS (SELECT user_id, coalesce(max(z) FILTER (event_type IN ('click', 'view')), 0) AS disturbance, coalesce(max(z) FILTER (event_type IN ('purchase', 'signup')), 0) AS asymmetry, coalesce(max(z) FILTER (event_type IN ('error', 'click')), 0) AS internal FROM z GROUP BY user_id),
s AS (SELECT *, internal + 0.35 * disturbance - 0.45 * greatest(asymmetry - 2, 0) AS rule_score FROM g)
SELECT user_id, disturbance, asymmetry, internal, rule_score, asymmetry >= 4 AS external, disturbance >= 3 AND internal >= 3 AND asymmetry < 4 AS internal_fault, greatest(0.05, least(0.95, (rule_score - 1) / 6)) AS confidence FROM s""", "disturbance asymmetry internal rule_score confidence")
def transformer_rules(spark, sf_dir):
    f = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.avg("value").alias("value"))
    return D.rule_scores(f, D.feature_reference(f, "event_type"), ["user_id"], "event_type", GROUPS)


SMOOTH_SQL = f"{EVENTS_SQL}, sm AS (SELECT *, median(value) OVER (PARTITION BY user_id, event_type ORDER BY t_idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS smooth FROM ev), bk AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY t_idx DESC) AS back FROM sm)"


def smoothed(spark, sf_dir):
    return S.smooth_median(series(spark, sf_dir), SERIES, 2)


@query("capacity_features", f"""WITH {SMOOTH_SQL} SELECT user_id, event_type, count(*) AS cycles, arg_max(value, t_idx) AS capacity, regr_slope(smooth, t_idx) AS global_slope, regr_slope(smooth, t_idx) FILTER (back <= 8) AS local_slope, arg_max(value, t_idx) / 100 AS soh FROM bk GROUP BY ALL""", "capacity global_slope local_slope soh")
def capacity_features(spark, sf_dir):
    return D.capacity_features(smoothed(spark, sf_dir), SERIES, 100.0, window=8)


@query("end_of_life", f"""WITH {SMOOTH_SQL}, g AS (SELECT user_id, event_type, count(*) AS cycles, max(t_idx)::DOUBLE AS now, arg_max(smooth, t_idx) AS level, min(t_idx) FILTER (smooth <= 4) AS crossed, regr_slope(smooth, t_idx) FILTER (back <= 10) AS slope, regr_intercept(smooth, t_idx) FILTER (back <= 10) AS icept FROM bk GROUP BY ALL),
e AS (SELECT *, (4 - icept) / slope AS x FROM g),
s AS (SELECT *, CASE WHEN cycles < 8 THEN 'insufficient_history' WHEN level <= 4 THEN 'observed' WHEN coalesce(slope >= -1e-5, true) THEN 'not_degrading' WHEN x < now OR x - now > 60 THEN 'outside_horizon' ELSE 'projected' END AS state FROM e)
SELECT user_id, event_type, cycles, state, CASE state WHEN 'observed' THEN crossed::DOUBLE WHEN 'projected' THEN x END AS eol, CASE state WHEN 'observed' THEN 1.0::DOUBLE WHEN 'projected' THEN greatest(0, least(1, 1 - greatest(level - 4, 0) / 36)) END AS risk FROM s""", "eol risk", digits=4)
def end_of_life(spark, sf_dir):
    return D.end_of_life(smoothed(spark, sf_dir), SERIES, 4.0, 40.0, least=8, window=10, horizon=60.0)


@query("health_index", f"""WITH {Z_SQL}, p AS (SELECT user_id, event_type, regr_slope(z, t_idx) * (max(t_idx) - min(t_idx)) AS move FROM z GROUP BY ALL), m AS (SELECT user_id, median(abs(move)) AS mid FROM p GROUP BY user_id),
k AS (SELECT user_id, event_type, sign(move) AS sg FROM p JOIN m USING (user_id) WHERE abs(move) >= greatest(0.1, mid)), h AS (SELECT user_id, t_idx, avg(z * sg) AS h FROM z JOIN k USING (user_id, event_type) GROUP BY ALL)
SELECT user_id, t_idx, h - first_value(h) OVER (PARTITION BY user_id ORDER BY t_idx) AS health FROM h""", "health")
def health_index(spark, sf_dir):
    return D.health_index(zscored(spark, sf_dir), ["user_id"], "event_type")


@query("healthy_split", f"""WITH {Z_SQL}, flagged AS (SELECT *, coalesce(abs(z) <= 1.0, false) AS alarm FROM z), {RUN_SQL},
b AS (SELECT user_id, event_type, run_start, run_length FROM runs WHERE place = 1 QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY run_length DESC, run_start) = 1)
SELECT user_id, event_type, t_idx, CASE WHEN place <= floor(b.run_length * 0.7) THEN 'fit' ELSE 'calibrate' END AS role FROM runs JOIN b USING (user_id, event_type, run_start)""")
def healthy_split(spark, sf_dir):
    return D.healthy_split(zscored(spark, sf_dir).withColumn("fine", F.coalesce(F.abs("z") <= 1.0, F.lit(False))), SERIES, "fine")


@query("conditional_difference", f"""WITH {EVENTS_SQL}, d AS (SELECT *, value - lag(value) OVER (PARTITION BY user_id, event_type ORDER BY t_idx) AS d FROM ev)
SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN coalesce(d, lead(d) OVER (PARTITION BY user_id, event_type ORDER BY t_idx)) ELSE value END AS used FROM d""", "used")
def conditional_difference(spark, sf_dir):
    return D.differenced(series(spark, sf_dir), SERIES, F.col("event_type").isin("click", "view")).select("event_id", "used")


@query("channel_fusion", f"""WITH {EVENTS_SQL}, e AS (SELECT user_id, event_type, avg(value) - 8 AS energy FROM ev GROUP BY ALL),
w AS (SELECT user_id, event_type, CASE WHEN sum(greatest(energy, 0)) OVER (PARTITION BY user_id) > 0 THEN greatest(energy, 0) / sum(greatest(energy, 0)) OVER (PARTITION BY user_id) ELSE 1 / count(*) OVER (PARTITION BY user_id) END AS weight FROM e)
SELECT user_id, t_idx, sum(value * weight) AS fused FROM ev JOIN w USING (user_id, event_type) GROUP BY ALL""", "fused")
def channel_fusion(spark, sf_dir):
    rows = series(spark, sf_dir)
    weights = D.channel_weights(rows.groupBy(*SERIES).agg((F.avg("value") - 8).alias("energy")), ["user_id"])
    return D.fused(rows, weights, ["user_id"], "event_type")


@query("regime_distance", """WITH a AS (SELECT user_id, avg(value) AS m FROM events GROUP BY user_id), d AS (SELECT user_id, c AS center, abs(m - c) AS distance FROM a, (VALUES (6.0::DOUBLE), (10.0), (14.0)) AS t(c)),
n AS (SELECT user_id, min(distance) AS nearest, arg_min(center, distance) AS regime, list_sort(list(distance))[2] - list_sort(list(distance))[1] AS margin FROM d GROUP BY user_id),
q AS (SELECT quantile_cont(nearest, 0.9) AS cut FROM n WHERE user_id % 2 = 0) SELECT user_id, nearest, regime, margin, nearest > cut AS outside FROM n, q""", "nearest margin")
def regime_distance(spark, sf_dir):
    """How far assets are from three stated centres, against the even ids' 90 % quantile."""
    means = table(spark, sf_dir, "events").groupBy("user_id").agg(F.avg("value").alias("m"))
    d = means.select("user_id", "m", F.explode(F.array(*[F.lit(c) for c in (6.0, 10.0, 14.0)])).alias("center")).withColumn("distance", F.abs(F.col("m") - F.col("center")))
    return D.distance_margin(d, ["user_id"], "distance", F.col("user_id") % 2 == 0, 0.9)


EVENT_SQL = """al AS (SELECT user_id AS unit, epoch(ts) AS x FROM events WHERE event_type = 'error'), evs AS (SELECT o_orderkey AS event, o_custkey AS unit, 1704067200.0::DOUBLE + (o_orderkey % 20) * 86400 AS start, 1704067200.0::DOUBLE + (o_orderkey % 20) * 86400 + 5 * 86400 AS "end", o_orderstatus = 'F' AS is_fault FROM orders),
oc AS (SELECT event, is_fault, start, "end", count(*) FILTER (x BETWEEN start AND "end") AS hits, count(*) FILTER (NOT (x BETWEEN start AND "end")) AS outside, min(x) FILTER (x BETWEEN start AND "end") AS first FROM evs LEFT JOIN al USING (unit) GROUP BY ALL),
oo AS (SELECT event, is_fault, hits, outside, hits >= 1 AS detected, CASE WHEN hits >= 1 THEN first - start END AS delay, CASE WHEN hits >= 1 THEN "end" - first END AS left_over FROM oc)"""


def outcomes(spark, sf_dir):
    alarms = table(spark, sf_dir, "events").where("event_type = 'error'").select(F.col("user_id").alias("unit"), S.seconds("ts").alias("x"))
    start = F.lit(1704067200.0) + (F.col("o_orderkey") % 20) * 86400
    events = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("event"), F.col("o_custkey").alias("unit"), start.alias("start"), (start + 5 * 86400).alias("end"), (F.col("o_orderstatus") == "F").alias("is_fault"))
    return D.event_outcome(alarms, events, "event")


@query("event_outcome", f"WITH {EVENT_SQL} SELECT * FROM oo", "delay left_over", digits=2)
def event_outcome(spark, sf_dir):
    return outcomes(spark, sf_dir)


@query("event_summary", f"""WITH {EVENT_SQL}, g AS (SELECT count(*) FILTER (is_fault AND detected) AS tp, count(*) FILTER (is_fault AND NOT detected) AS fn, count(*) FILTER (NOT is_fault AND detected) AS fp, count(*) FILTER (NOT is_fault AND NOT detected) AS tn, avg(delay) FILTER (is_fault) AS mean_delay, median(delay) FILTER (is_fault) AS median_delay FROM oo)
SELECT tp, fn, fp, tn, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END AS recall, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END AS "precision", CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) END AS f1, CASE WHEN fp + tn > 0 THEN fp / (fp + tn) END AS false_alarm_rate, mean_delay, median_delay FROM g""", 'recall "precision" f1 false_alarm_rate mean_delay median_delay'.replace('"', ""), digits=3)
def event_summary(spark, sf_dir):
    return D.event_summary(outcomes(spark, sf_dir))


@query("physics_checks", """SELECT user_id, count(e) AS violations, count(e) >= 8 AS violated, CASE WHEN count(e) >= 8 THEN greatest(0, least(1, quantile_cont(e, 0.9))) ELSE 0 END::DOUBLE AS severity FROM (SELECT user_id, CASE WHEN value / 15 - 1 > 0 THEN value / 15 - 1 END AS e FROM events) GROUP BY user_id""", "severity")
def physics_checks(spark, sf_dir):
    """Readings over a bound of 15, as a share of it."""
    return D.physics_violations(table(spark, sf_dir, "events"), ["user_id"], F.col("value") / 15 - 1)


@query("hybrid_arbitration", """WITH s AS (SELECT l_orderkey, l_linenumber, l_discount >= 0.05 AS m, l_tax >= 0.04 AS r, l_returnflag = 'R' AS e, l_discount * 10 AS cm, l_tax * 12 AS cr FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN m AND r AND NOT e THEN 'diagnose' WHEN m AND e THEN 'abstain' WHEN m AND NOT r THEN 'diagnose' WHEN NOT m AND r THEN 'abstain' ELSE 'monitor' END AS decision,
CASE WHEN m AND r AND NOT e THEN greatest(cm, cr) WHEN m AND NOT r AND NOT e THEN 0.75 * cm + 0.25 * cr ELSE least(cm, cr) END AS confidence FROM s""", "confidence")
def hybrid_arbitration(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    flags = li.select("l_orderkey", "l_linenumber", (F.col("l_discount") >= 0.05).alias("model"), (F.col("l_tax") >= 0.04).alias("rule"), (F.col("l_returnflag") == "R").alias("external"), (F.col("l_discount") * 10).alias("model_confidence"), (F.col("l_tax") * 12).alias("rule_confidence"))
    return D.blend_decisions(flags).select("l_orderkey", "l_linenumber", "decision", "confidence")


@query("phase_swaps", """WITH p AS (SELECT l_orderkey, l_linenumber, l_quantity AS a, l_discount AS b, l_tax AS c FROM lineitem)
SELECT l_orderkey, l_linenumber, 0 AS variant, a, b, c FROM p UNION ALL SELECT l_orderkey, l_linenumber, 1, b, a, c FROM p UNION ALL SELECT l_orderkey, l_linenumber, 2, c, b, a FROM p""", "a b c")
def phase_swaps(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("a"), F.col("l_discount").alias("b"), F.col("l_tax").alias("c"))
    return D.phase_swaps(rows, ["a", "b", "c"], "l_linenumber")


RANKED_SQL = """rk AS (SELECT l_partkey AS unit, l_suppkey AS cand, sum(l_quantity) AS s FROM lineitem GROUP BY ALL), ra AS (SELECT *, row_number() OVER w AS rank, (s - lead(s) OVER w) / 50 AS margin FROM rk WINDOW w AS (PARTITION BY unit ORDER BY s DESC, cand)), tr AS (SELECT p_partkey AS unit, p_partkey % 10 AS cand FROM part)"""


@query("ranker_evaluation", f"""WITH {RANKED_SQL}, g AS (SELECT unit, bool_or(rank = 1 AND ra.cand = tr.cand) AS one, bool_or(ra.cand = tr.cand) AS three, max(coalesce(margin, 1)) FILTER (rank = 1) AS m FROM ra JOIN tr USING (unit) WHERE rank <= 3 GROUP BY unit)
SELECT count(*) AS n, avg(one::INT) AS top1, avg(three::INT) AS top3, avg((round(m, 9) < 0.2)::INT) AS abstained, avg((NOT round(m, 9) < 0.2 AND NOT one)::INT) AS confident_errors FROM g""", "top1 top3 abstained confident_errors")
def ranker_evaluation(spark, sf_dir):
    """Suppliers ranked for each part by quantity, against a stated one."""
    from pyspark.sql import Window

    s = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("unit"), F.col("l_suppkey").alias("cand")).agg(F.sum("l_quantity").alias("s"))
    w = Window.partitionBy("unit").orderBy(F.desc("s"), "cand")
    ranked = s.withColumn("rank", F.row_number().over(w)).withColumn("margin", (F.col("s") - F.lead("s").over(w)) / 50)
    return D.ranker_evaluation(ranked, table(spark, sf_dir, "part").select(F.col("p_partkey").alias("unit"), (F.col("p_partkey") % 10).alias("cand")), "unit", "cand", 0.2)


@query("process_roots", """WITH s AS (SELECT user_id, event_type, avg(value) AS shift, coalesce(stddev_pop(value), 0) AS spread, count(*)::DOUBLE AS burden, min(epoch(ts)) FILTER (value > 12) AS onset FROM events GROUP BY ALL)
SELECT user_id, event_type, 0.35 * shift / greatest(max(shift) OVER w, 1e-12) + 0.35 * burden / greatest(max(burden) OVER w, 1e-12) + 0.2 * spread / greatest(max(spread) OVER w, 1e-12) + 0.1 * CASE WHEN onset IS NOT NULL THEN pow(0.82, row_number() OVER (PARTITION BY user_id ORDER BY onset NULLS LAST, event_type) - 1) ELSE 0 END AS score FROM s WINDOW w AS (PARTITION BY user_id)""", "score")
def process_roots(spark, sf_dir):
    """Candidates by shift, burden and spread, early ones ahead."""
    s = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.avg("value").alias("shift"), F.coalesce(F.stddev_pop("value"), F.lit(0.0)).alias("spread"), F.count(F.lit(1)).cast("double").alias("burden"), F.min(F.when(F.col("value") > 12, S.seconds("ts"))).alias("onset"))
    return D.blended_roots(s, ["user_id"], "event_type", {"shift": 0.35, "burden": 0.35, "spread": 0.2}, "onset", 0.1).select("user_id", "event_type", "score")


@query("fault_types", f"""WITH {Z_SQL}, r AS (SELECT *, t_idx * 3 // n AS third, abs(z - lag(z) OVER (PARTITION BY user_id, event_type ORDER BY t_idx)) AS d FROM z),
g AS (SELECT user_id, event_type, coalesce(avg(z) FILTER (third = 0), 0) AS m0, coalesce(avg(z) FILTER (third = 2), 0) AS m2, coalesce(stddev_pop(z) FILTER (third = 0), 0) AS s0, coalesce(stddev_pop(z) FILTER (third = 2), 0) AS s2, coalesce(regr_slope(z, t_idx) * count(*), 0) AS dr, coalesce(avg((d < 1e-9)::INT), 0) AS fl, coalesce(max(abs(z)), 0) AS pk, coalesce(avg(abs(z)), 0) AS lv FROM r GROUP BY ALL),
s AS (SELECT user_id, event_type, tanh(abs(m2 - m0) / 2) AS shift, tanh(abs(dr) / 3) AS drift, tanh(abs(ln((s2 + 0.1) / (s0 + 0.1)))) AS spread, fl AS stuck, tanh(greatest(pk - 3 * lv, 0) / 4) AS extreme FROM g)
SELECT *, list_sort([{{'s': round(shift, 9), 'i': 0, 'n': 'shift'}}, {{'s': round(drift, 9), 'i': -1, 'n': 'drift'}}, {{'s': round(spread, 9), 'i': -2, 'n': 'spread'}}, {{'s': round(stuck, 9), 'i': -3, 'n': 'stuck'}}, {{'s': round(extreme, 9), 'i': -4, 'n': 'extreme'}}])[-1].n AS strongest FROM s""", "shift drift spread stuck extreme")
def fault_types(spark, sf_dir):
    return D.fault_types(zscored(spark, sf_dir), SERIES)


def _newton_sql(steps: int) -> str:
    out = ["n0 AS (SELECT 0.0::DOUBLE AS a, 0.0::DOUBLE AS b)"]
    for k in range(steps):
        out.append(f"m{k} AS (SELECT any_value(a) AS a, any_value(b) AS b, sum((y - p) * x) AS ga, sum(y - p) AS gb, sum(p * (1 - p) * x * x) AS aa, sum(p * (1 - p) * x) AS ab, sum(p * (1 - p)) AS bb FROM (SELECT y, x, a, b, 1 / (1 + exp(-(a * x + b))) AS p FROM s, n{k}))")
        out.append(f"n{k + 1} AS (SELECT a + (bb * ga - ab * gb) / (aa * bb - ab * ab) AS a, b + (aa * gb - ab * ga) / (aa * bb - ab * ab) AS b FROM m{k})")
    return ", ".join(out)


@query("platt_calibration", f"""WITH s AS (SELECT doc_id, toxic AS y, ((doc_id * 37) % 101) / 100.0::DOUBLE + 0.3 * toxic AS x FROM labels), {_newton_sql(6)} SELECT doc_id, x, 1 / (1 + exp(-(a * x + b))) AS calibrated FROM s, n6""", "x calibrated")
def platt_calibration(spark, sf_dir):
    """Scores of the labelled documents through the logistic curve that fits them best."""
    s = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("y"), (((F.col("doc_id") * 37) % 101) / F.lit(100.0) + 0.3 * F.col("toxic")).alias("x"))
    a, b = D.platt(s, "y", "x")
    return s.select("doc_id", "x", (1 / (1 + F.exp(-(F.lit(a) * F.col("x") + F.lit(b))))).alias("calibrated"))


@query("root_weights_cv", """WITH s AS (SELECT l_partkey AS unit, l_suppkey AS cand, l_partkey % 3 AS fold, l_suppkey = l_partkey % 10 AS is_root, sum(l_quantity) / 100 AS q, sum(l_discount) AS d, count(*) / 5.0 AS c FROM lineitem GROUP BY ALL), g(id, wq, wd, wc) AS (VALUES (0, 1.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE), (1, 0.0, 1.0, 0.0), (2, 0.0, 0.0, 1.0), (3, 0.5, 0.5, 0.0), (4, 0.2, 0.3, 0.5)),
b AS (SELECT id, fold, unit, is_root FROM s, g QUALIFY row_number() OVER (PARTITION BY id, unit ORDER BY round(q * wq + d * wd + c * wc, 9) DESC, cand) = 1), p AS (SELECT id, fold, sum(is_root::INT) AS h, count(*) AS n FROM b GROUP BY ALL),
t AS (SELECT *, (sum(h) OVER (PARTITION BY id) - h) / (sum(n) OVER (PARTITION BY id) - n) AS train_accuracy, h / n AS accuracy FROM p) SELECT fold, id AS grid, train_accuracy, accuracy FROM t QUALIFY row_number() OVER (PARTITION BY fold ORDER BY train_accuracy DESC, id) = 1""", "train_accuracy accuracy")
def root_weights_cv(spark, sf_dir):
    """Weights of three scores chosen on two folds of the parts and tried on the third."""
    s = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("unit"), F.col("l_suppkey").alias("cand")).agg((F.sum("l_quantity") / 100).alias("q"), F.sum("l_discount").alias("d"), (F.count(F.lit(1)) / 5.0).alias("c"))
    s = s.withColumn("fold", F.col("unit") % 3).withColumn("is_root", F.col("cand") == F.col("unit") % 10)
    grid = spark.createDataFrame([(0, 1.0, 0.0, 0.0), (1, 0.0, 1.0, 0.0), (2, 0.0, 0.0, 1.0), (3, 0.5, 0.5, 0.0), (4, 0.2, 0.3, 0.5)], "id int, q double, d double, c double")
    return D.cross_validated_weights(s, "unit", "cand", grid, ["q", "d", "c"], "fold")
