"""Decisions over events and line items."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from orebed.operators import decisions as D
from orebed.operators import series as S
from orebed.queries.base import query, table
from orebed.queries.diagnosis import SMOOTH_SQL, smoothed
from orebed.queries.series import SERIES
from orebed.sources.catalogue import EDGES, catalogue_sql, faults, topology, variable

TOPOLOGY = ", ".join("({})".format(", ".join(f"'{variable(s)}'" for s in e.split(">"))) for e in EDGES.split())


@query("event_evidence", """WITH z AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t_idx, value > 15 AS r, abs(value - avg(value) OVER (PARTITION BY user_id)) > 6 AS d, event_type <> 'view' AS e, value > 80 AS o FROM events),
f AS (SELECT *, e AND r AS fr, e AND d AS fd, e AND r AND d AS fb, e AND o AS fo FROM z),
i AS (SELECT *, t_idx - sum(fr::INT) OVER w AS ir, t_idx - sum(fd::INT) OVER w AS id, t_idx - sum(fb::INT) OVER w AS ib FROM f WINDOW w AS (PARTITION BY user_id ORDER BY t_idx)),
p AS (SELECT *, CASE WHEN fr THEN row_number() OVER (PARTITION BY user_id, fr, ir ORDER BY t_idx) ELSE 0 END AS pr, CASE WHEN fd THEN row_number() OVER (PARTITION BY user_id, fd, id ORDER BY t_idx) ELSE 0 END AS pd, CASE WHEN fb THEN row_number() OVER (PARTITION BY user_id, fb, ib ORDER BY t_idx) ELSE 0 END AS pb FROM i),
g AS (SELECT user_id, greatest(sum(e::INT), 1) AS n, sum(fr::INT) / greatest(sum(e::INT), 1) AS residual_fraction, sum(fd::INT) / greatest(sum(e::INT), 1) AS drift_fraction, sum(fb::INT) / greatest(sum(e::INT), 1) AS both_fraction, sum(fo::INT) / greatest(sum(e::INT), 1) AS outside_fraction,
max(pr) AS longest_residual, max(pd) AS longest_drift, max(pb) AS longest_both, min(t_idx) FILTER (pb >= 3) AS first FROM p GROUP BY user_id),
x AS (SELECT user_id, sum((value > 60)::INT) AS n FROM events GROUP BY 1),
s AS (SELECT g.*, least(1, 0.25 * least(1, residual_fraction / 0.1) + 0.2 * least(1, drift_fraction / 0.1) + 0.3 * least(1, both_fraction / 0.05) + 0.2 * least(1, longest_both / 3) + 0.05 * least(1, x.n / 3)) AS score,
CASE WHEN outside_fraction > 0.1 THEN 'outside_regimes' WHEN longest_both >= 3 AND residual_fraction >= 0.15 AND drift_fraction >= 0.15 THEN 'corroborated' WHEN longest_both < 3 THEN 'no_sustained_run' ELSE 'burden_too_low' END AS reason FROM g JOIN x USING (user_id))
SELECT user_id, CASE reason WHEN 'outside_regimes' THEN 'abstain' WHEN 'corroborated' THEN 'fault' ELSE 'monitor' END AS decision, reason, score, CASE reason WHEN 'outside_regimes' THEN least(1, outside_fraction / 0.1) WHEN 'corroborated' THEN score ELSE greatest(0, 1 - score) END AS confidence,
residual_fraction, drift_fraction, both_fraction, outside_fraction, longest_residual, longest_drift, longest_both, CASE WHEN reason = 'corroborated' THEN first END AS first_index FROM s""", "score confidence residual_fraction drift_fraction both_fraction outside_fraction")
def event_evidence(spark, sf_dir):
    """A decision for each user's series by two alarms; views are not evaluable, values over 80 outside the regimes."""
    ev = table(spark, sf_dir, "events")
    rows = S.indexed(ev, ["user_id"], ["ts", "event_id"]).withColumn("t_idx", F.col("t_idx").cast("long"))
    rows = rows.join(S.ordered_moments(rows, ["user_id"], "value", "t_idx").select("user_id", "mean"), "user_id")
    rows = rows.withColumns({"r": F.col("value") > 15, "d": F.abs(F.col("value") - F.col("mean")) > 6, "e": F.col("event_type") != "view", "o": F.col("value") > 80})
    findings = ev.groupBy("user_id").agg(F.sum((F.col("value") > 60).cast("int")).alias("n"))
    return D.event_evidence(rows, ["user_id"], "r", "d", "e", "o", findings, least_run=3, least_residual=0.15, least_drift=0.15)


VARIABLE_SQL = "CASE WHEN l_partkey % 52 < 41 THEN 'XMEAS(' || l_partkey % 52 + 1 || ')' ELSE 'XMV(' || l_partkey % 52 - 40 || ')' END"
EVIDENCE_SQL = f"""v AS (SELECT l_suppkey AS unit, {VARIABLE_SQL} AS variable, max(l_extendedprice)::DOUBLE AS generic, avg(l_quantity)::DOUBLE AS shift, sum(l_discount)::DOUBLE AS contribution, min(l_shipdate) AS onset FROM lineitem GROUP BY ALL),
o AS (SELECT *, CASE WHEN shift > 20 THEN row_number() OVER (PARTITION BY unit ORDER BY CASE WHEN shift > 20 THEN onset END NULLS LAST, variable) END AS onset_rank FROM v)"""


def evidence(spark, sf_dir):
    """Line items of a supplier as a plant's evidence for 52 variables."""
    k = F.col("l_partkey") % 52
    name = F.when(k < 41, F.concat(F.lit("XMEAS("), (k + 1).cast("string"), F.lit(")"))).otherwise(F.concat(F.lit("XMV("), (k - 40).cast("string"), F.lit(")")))
    v = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("unit"), name.alias("variable")).agg(F.max("l_extendedprice").cast("double").alias("generic"), F.avg("l_quantity").cast("double").alias("shift"), F.sum("l_discount").cast("double").alias("contribution"), F.min("l_shipdate").alias("onset"))
    shifted = F.col("shift") > 20
    w = Window.partitionBy("unit").orderBy(F.asc_nulls_last(F.when(shifted, F.col("onset"))), "variable")
    return v.withColumn("onset_rank", F.when(shifted, F.row_number().over(w)))


def types(spark, sf_dir):
    kinds = F.expr("element_at(array('step', 'random_variation', 'slow_drift', 'valve_sticking'), cast(l_linenumber % 4 + 1 AS int))")
    return table(spark, sf_dir, "lineitem").where("l_suppkey % 2 = 0").groupBy(F.col("l_suppkey").alias("unit"), kinds.alias("kind")).agg((F.avg("l_tax") * 10).cast("double").alias("score"))


@query("guided_roots", f"""WITH {EVIDENCE_SQL}, b AS (SELECT unit, variable, 0.35 * generic / max(generic) OVER w + 0.35 * shift / max(shift) OVER w + 0.2 * CASE WHEN max(contribution) OVER w > 1e-12 THEN contribution / max(contribution) OVER w ELSE 0 END + 0.1 * coalesce(pow(0.82, onset_rank - 1) / max(pow(0.82, onset_rank - 1)) OVER w, 0) AS s FROM o WINDOW w AS (PARTITION BY unit)),
r AS (SELECT *, s / max(s) OVER (PARTITION BY unit) AS n, row_number() OVER (PARTITION BY unit ORDER BY round(s, 12) DESC, variable) AS rank FROM b),
t AS (SELECT l_suppkey AS unit, ['step', 'random_variation', 'slow_drift', 'valve_sticking'][l_linenumber % 4 + 1] AS k, (avg(l_tax) * 10)::DOUBLE AS ks FROM lineitem WHERE l_suppkey % 2 = 0 GROUP BY ALL),
c AS (SELECT fault_id, label, replace(kind, ' ', '_') AS k, roots, affected FROM {catalogue_sql()} WHERE len(roots) > 0),
u AS (SELECT unit, count(*) FILTER (rank <= 12) AS tops FROM r GROUP BY unit),
ro AS (SELECT unit, fault_id, max(coalesce(n, 0)) AS root_score, coalesce(max(n) FILTER (pos = 1), 0) AS first_score, arg_max(root, {{'n': coalesce(n, 0), 'p': -pos}}) AS top_root, arg_max(coalesce(s, 0), {{'n': coalesce(n, 0), 'p': -pos}}) AS top_s, coalesce(max(s) FILTER (pos = 1), 0) AS first_s FROM (SELECT unit, fault_id, unnest(roots) AS root, unnest(range(1, len(roots) + 1)) AS pos FROM u, c) LEFT JOIN (SELECT unit, variable AS root, n, s FROM r) USING (unit, root) GROUP BY ALL),
af AS (SELECT unit, fault_id, avg(coalesce(n, 0)) AS mean, count(*) FILTER (rank <= 12) AS hits FROM (SELECT unit, fault_id, unnest(affected) AS variable FROM u, c) LEFT JOIN r USING (unit, variable) GROUP BY ALL),
f AS (SELECT u.unit, c.*, root_score, CASE WHEN first_score > 0.05 THEN roots[1] ELSE top_root END AS root, CASE WHEN first_score > 0.05 THEN first_s ELSE top_s END AS root_s, hits / greatest(least(len(affected), tops), 1) AS overlap, mean, greatest(coalesce(ks, 0), 0) AS kind_score FROM u JOIN ro USING (unit) JOIN af USING (unit, fault_id) JOIN c USING (fault_id) LEFT JOIN t ON t.unit = u.unit AND t.k = c.k),
g AS (SELECT *, 0.42 * root_score + 0.24 * overlap + 0.14 * mean + 0.2 * kind_score AS catalogue_score FROM f),
h AS (SELECT *, catalogue_score - coalesce(lead(catalogue_score) OVER w, 0) AS margin, row_number() OVER w AS place FROM g WINDOW w AS (PARTITION BY unit ORDER BY round(catalogue_score, 12) DESC, fault_id)),
d AS (SELECT *, CASE WHEN catalogue_score < 0.18 THEN 'catalog_evidence_below_threshold' WHEN root_score < 0.08 AND NOT (overlap >= 0.35 AND kind_score >= 0.45) THEN 'catalog_root_not_directly_supported' WHEN unit % 2 = 0 AND margin < 0.035 THEN 'ambiguous_catalog_fault_id' END AS abstain_reason FROM h WHERE place = 1)
SELECT unit, CASE WHEN abstain_reason IS NULL OR abstain_reason = 'ambiguous_catalog_fault_id' THEN root END AS root_cause, CASE WHEN abstain_reason IS NULL THEN fault_id END AS fault_id, CASE WHEN abstain_reason IS NULL THEN label END AS fault_label, abstain_reason,
greatest(0, least(1, 0.5 * catalogue_score + 0.35 * root_s + 0.15 * greatest(margin, 0))) AS confidence, margin, catalogue_score, root_score, overlap, kind_score FROM d""", "confidence margin catalogue_score root_score overlap kind_score")
def guided_roots(spark, sf_dir):
    """The catalogue's best fault for each plant; even ones have evidence for kinds of faults."""
    return D.guided_roots(evidence(spark, sf_dir), "unit", faults(spark), types(spark, sf_dir))


@query("diagnosed_processes", f"""WITH RECURSIVE {EVIDENCE_SQL}, best AS (SELECT unit, variable AS root, shift / 55 AS s FROM v QUALIFY row_number() OVER (PARTITION BY unit ORDER BY round(shift / 55, 12) DESC, variable DESC) = 1),
ed AS (SELECT DISTINCT l_suppkey AS unit, cause, effect FROM lineitem, (VALUES {TOPOLOGY}) AS tp(cause, effect) WHERE (l_suppkey + length(cause) + length(effect)) % 3 > 0),
re AS (SELECT unit, root AS node, 0 AS h FROM best WHERE EXISTS (SELECT 1 FROM ed WHERE ed.unit = best.unit AND cause = root) UNION SELECT re.unit, effect, h + 1 FROM re JOIN ed ON ed.unit = re.unit AND ed.cause = re.node WHERE h < 5),
n AS (SELECT DISTINCT unit, node FROM re), na AS (SELECT unit, list(node) AS nodes FROM n GROUP BY unit),
m AS (SELECT best.*, coalesce(nodes, []) AS nodes FROM best LEFT JOIN na USING (unit)),
f AS (SELECT m.*, fault_id, label, CASE WHEN len(roots) > 0 AND roots[1] = root THEN 1 ELSE 0 END + CASE WHEN len(affected) > 0 THEN len(list_intersect(affected, nodes)) / len(affected) ELSE 0 END AS fit FROM m, {catalogue_sql()}),
t AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY unit ORDER BY round(fit, 12) DESC, fault_id) = 1),
c AS (SELECT *, CASE WHEN fit > 0 THEN least(1, 0.75 * least(1, s) + 0.25 * least(1, fit / 2)) ELSE least(1, s) END AS confidence FROM t)
SELECT unit, CASE WHEN confidence >= 0.8 THEN root END AS root, CASE WHEN confidence >= 0.8 THEN CASE WHEN fit > 0 THEN label ELSE 'Process anomaly rooted at ' || root END END AS fault_label, confidence, CASE WHEN confidence < 0.8 THEN 'root_cause_evidence_below_threshold' END AS abstain_reason, len(list_filter(nodes, lambda x: x <> root))::INT AS n_affected FROM c""", "confidence")
def diagnosed_processes(spark, sf_dir):
    """A diagnosis for each plant over its own part of the topology."""
    ranking = evidence(spark, sf_dir).select("unit", "variable", (F.col("shift") / 55).alias("score"))
    units = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("unit")).distinct()
    edges = units.crossJoin(F.broadcast(topology(spark))).where("(unit + length(cause) + length(effect)) % 3 > 0")  # 46 edges
    return D.diagnosed(ranking, edges, "unit", faults(spark), threshold=0.8)


@query("life_interval", f"""WITH {SMOOTH_SQL}, q AS (SELECT user_id, event_type, t_idx::DOUBLE AS x, value AS y, smooth AS s, back, lag(t_idx::DOUBLE) OVER (PARTITION BY user_id, event_type ORDER BY t_idx) AS before FROM bk),
g AS (SELECT user_id, event_type, count(*) AS cycles, max(x) AS now, arg_max(s, x) AS level, min(x) FILTER (s <= 4) AS cx, arg_min(before, x) FILTER (s <= 4) AS cb0, min(x) AS x0,
regr_slope(s, x) FILTER (back <= 6) AS m0, regr_intercept(s, x) FILTER (back <= 6) AS c0, regr_slope(s, x) FILTER (back <= 8) AS m1, regr_intercept(s, x) FILTER (back <= 8) AS c1, regr_slope(s, x) FILTER (back <= 12) AS m2, regr_intercept(s, x) FILTER (back <= 12) AS c2, regr_slope(s, x) AS m3, regr_intercept(s, x) AS c3 FROM q GROUP BY ALL),
e AS (SELECT *, (4 - c0) / m0 AS x_, CASE WHEN cx > x0 THEN cb0 END AS cb FROM g),
n AS (SELECT q.user_id, q.event_type, count(*)::DOUBLE AS n, sum(x) AS sx, sum(x * x) AS sxx, sum((y - m0 * x - c0) ** 2) AS rss FROM q JOIN e USING (user_id, event_type) WHERE back <= 6 GROUP BY ALL),
s AS (SELECT e.*, n.n, sx, sxx, rss, CASE WHEN cycles < 8 THEN 'insufficient_history' WHEN level <= 4 AND cb IS NULL THEN 'left_censored_crossing' WHEN level <= 4 THEN 'observed_crossing' WHEN coalesce(m0 >= -1e-5, true) THEN 'non_degrading_or_unstable_slope' WHEN x_ < now OR x_ - now > 60 THEN 'projection_outside_credible_horizon' ELSE 'projected' END AS state FROM e JOIN n USING (user_id, event_type)),
k AS (SELECT *, 1.96 * sqrt(greatest(coalesce(rss / greatest(n - 2, 1) * ((x_ / m0) ** 2 * n - 2 * (x_ / m0) * (1 / m0) * sx + (1 / m0) ** 2 * sxx) / nullif(n * sxx - sx * sx, 0), 0), 0)) AS u, list_filter([CASE WHEN m1 < -1e-5 THEN (4 - c1) / m1 END, CASE WHEN m2 < -1e-5 THEN (4 - c2) / m2 END, CASE WHEN m3 < -1e-5 THEN (4 - c3) / m3 END], lambda v: v >= now AND v - now <= 60) AS others FROM s),
l AS (SELECT *, coalesce(list_min(others), x_) AS lo, coalesce(list_max(others), x_) AS hi, state IN ('observed_crossing', 'left_censored_crossing') AS seen, state = 'projected' AS ahead FROM k),
o AS (SELECT *, CASE WHEN seen THEN cx WHEN ahead THEN x_ END AS eol, CASE WHEN seen THEN coalesce(cb, 0) WHEN ahead THEN greatest(now, least(x_ - u, lo)) END AS eol_low, CASE WHEN seen THEN cx WHEN ahead THEN greatest(x_ + u, hi) END AS eol_high FROM l)
SELECT user_id, event_type, cycles, state, eol, eol_low, eol_high, CASE WHEN seen THEN 0 WHEN ahead THEN eol - now END::DOUBLE AS remaining, CASE WHEN seen THEN eol_high - eol_low WHEN ahead THEN greatest(eol - eol_low, eol_high - eol) END AS uncertainty, CASE WHEN seen THEN 0 WHEN ahead THEN u END::DOUBLE AS line_uncertainty,
CASE WHEN seen THEN 0 WHEN ahead THEN greatest(abs(x_ - lo), abs(hi - x_)) END::DOUBLE AS disagreement, CASE WHEN seen THEN 1 WHEN ahead THEN greatest(0, least(1, 1 - greatest(level - 4, 0) / 36)) END::DOUBLE AS risk FROM o""", "eol eol_low eol_high remaining uncertainty line_uncertainty disagreement risk", digits=3)
def life_interval(spark, sf_dir):
    return D.life_interval(smoothed(spark, sf_dir), SERIES, 4.0, 40.0, least=8, window=6, widths=(8, 12), horizon=60.0)
