"""Metrics over labels (truth) and scores made from document lengths and ids."""

from __future__ import annotations

from pyspark.sql import functions as F

from orebed.operators import metrics as M
from orebed.queries.base import query, table

SCORED = "s AS (SELECT doc_id, quality, toxic, ((doc_id * 37) % 101) / 100.0::DOUBLE * 0.7 + quality * 0.3::DOUBLE AS p FROM labels)"


def scored(spark, sf_dir):
    p = ((F.col("doc_id") * 37) % 101) / F.lit(100.0) * 0.7 + F.col("quality") * F.lit(0.3)
    return table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic", p.alias("p"))


@query("binary_metrics", f"""WITH {SCORED}, c AS (SELECT count(*) FILTER (quality = 1 AND p >= 0.5) AS tp, count(*) FILTER (quality = 0 AND p >= 0.5) AS fp, count(*) FILTER (quality = 1 AND p < 0.5) AS fn, count(*) FILTER (quality = 0 AND p < 0.5) AS tn FROM s)
SELECT *, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, 2 * tp / (2 * tp + fp + fn) AS f1, fp / (fp + tn) AS fpr, fn / (fn + tp) AS fnr FROM c""", "precision recall f1 fpr fnr")
def binary_metrics(spark, sf_dir):
    return M.binary_metrics(scored(spark, sf_dir).withColumn("pred", (F.col("p") >= 0.5).cast("int")), "quality", "pred")


@query("auroc", f"""WITH {SCORED}, g AS (SELECT p, count(*) FILTER (quality = 1) AS pos, count(*) FILTER (quality = 0) AS neg FROM s GROUP BY p), c AS (SELECT *, sum(neg) OVER (ORDER BY p) - neg AS below FROM g)
SELECT sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)) AS auroc FROM c""", "auroc")
def auroc(spark, sf_dir):
    return M.auroc(scored(spark, sf_dir), "quality", "p")


@query("average_precision", f"""WITH {SCORED}, g AS (SELECT p, count(*) FILTER (quality = 1) AS pos, count(*) AS n FROM s GROUP BY p), c AS (SELECT pos, sum(pos) OVER w AS tp, sum(n) OVER w AS seen FROM g WINDOW w AS (ORDER BY p DESC))
SELECT sum(pos * tp / seen) / sum(pos) AS average_precision FROM c""", "average_precision")
def average_precision(spark, sf_dir):
    return M.average_precision(scored(spark, sf_dir), "quality", "p")


@query("ece_bins", f"WITH {SCORED} SELECT least(floor(p * 10), 9)::INT AS bin, count(*) AS n, avg(p) AS confidence, avg(quality)::DOUBLE AS accuracy FROM s GROUP BY 1", "confidence accuracy")
def ece_bins(spark, sf_dir):
    return M.calibration_bins(scored(spark, sf_dir), "quality", "p")


@query("calibration_error", f"WITH {SCORED}, b AS (SELECT count(*) AS n, avg(p) AS c, avg(quality) AS a FROM s GROUP BY least(floor(p * 10), 9)) SELECT (SELECT sum(n * abs(c - a)) / sum(n) FROM b) AS ece, (SELECT avg((p - quality) * (p - quality)) FROM s) AS brier", "ece brier")
def calibration_error(spark, sf_dir):
    return M.calibration_error(scored(spark, sf_dir), "quality", "p")


DECISION = "CASE WHEN p < 0.3 THEN 'release' WHEN p < 0.45 THEN 'review' WHEN p < 0.5 THEN 'abstain' ELSE 'intervene' END"


@query("triage_metrics", f"""WITH {SCORED}, d AS (SELECT *, {DECISION} AS d FROM s),
c AS (SELECT count(*) AS n, count(*) FILTER (d = 'release') AS released, count(*) FILTER (d = 'intervene') AS intervened, count(*) FILTER (d IN ('review', 'abstain')) AS deferred, count(*) FILTER (d = 'release' AND toxic = 1) AS u, count(*) FILTER (d = 'intervene' AND toxic = 1) AS k, count(*) FILTER (toxic = 1) AS bad FROM d)
SELECT n, released, intervened, deferred, (n - deferred) / n AS coverage, u / nullif(released, 0) AS unsafe_rate, k / nullif(intervened, 0) AS precision, k / nullif(bad, 0) AS recall FROM c""", "coverage unsafe_rate precision recall")
def triage_metrics(spark, sf_dir):
    return M.triage(scored(spark, sf_dir).withColumn("d", F.expr(DECISION)), "toxic", "d")


@query("routing_buckets", f"""WITH {SCORED}, r AS (SELECT CASE WHEN p < 0.0308 THEN 'fast' WHEN p < 0.5636 THEN 'lightweight' ELSE 'agentic' END AS route, toxic FROM s)
SELECT route, count(*) AS n, avg(toxic)::DOUBLE AS positive_rate, count(*) / (SELECT count(*) FROM r) AS fraction FROM r GROUP BY route""", "positive_rate fraction")
def routing_buckets(spark, sf_dir):
    return M.routing(scored(spark, sf_dir), "toxic", "p", 0.0308, 0.5636)


@query("threshold_sweep", f"""WITH {SCORED}, g AS (SELECT unnest([0.1, 0.3, 0.5, 0.7, 0.9])::DOUBLE AS threshold)
SELECT threshold, count(*) FILTER (p >= threshold) AS flagged, count(*) FILTER (p >= threshold AND quality = 1) / count(*) FILTER (p >= threshold) AS precision, count(*) FILTER (p >= threshold AND quality = 1) / count(*) FILTER (quality = 1) AS recall FROM g, s GROUP BY threshold HAVING flagged > 0""", "precision recall")
def threshold_sweep(spark, sf_dir):
    return M.threshold_sweep(scored(spark, sf_dir), "quality", "p", [0.1, 0.3, 0.5, 0.7, 0.9])


@query("confusion_cube", f"WITH {SCORED} SELECT quality, pred, count(*) AS n FROM (SELECT quality, (p >= 0.5)::INT AS pred FROM s) GROUP BY CUBE (quality, pred)")
def confusion_cube(spark, sf_dir):
    return M.confusion_cube(scored(spark, sf_dir).withColumn("pred", (F.col("p") >= 0.5).cast("int")), "quality", "pred")


GUESS = "CASE WHEN doc_id % 9 = 0 THEN 'en' ELSE lang END"


@query("macro_f1", f"""WITH d AS (SELECT lang, {GUESS} AS pred FROM documents), l AS (SELECT lang AS label FROM d UNION SELECT pred FROM d),
c AS (SELECT label, (SELECT count(*) FROM d WHERE lang = label) AS t, (SELECT count(*) FROM d WHERE pred = label) AS p, (SELECT count(*) FROM d WHERE pred = label AND lang = label) AS tp FROM l)
SELECT label, coalesce(tp / nullif(p, 0), 0)::DOUBLE AS precision, coalesce(tp / nullif(t, 0), 0)::DOUBLE AS recall, coalesce(2 * tp / nullif(t + p, 0), 0)::DOUBLE AS f1 FROM c""", "precision recall f1")
def macro_f1(spark, sf_dir):
    return M.macro_f1(table(spark, sf_dir, "documents").withColumn("pred", F.expr(GUESS)), "lang", "pred")


@query("stratified_quota", """WITH d AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id::VARCHAR), doc_id) AS r, count(*) OVER (PARTITION BY lang) AS c, count(*) OVER () AS n FROM documents)
SELECT lang, doc_id FROM d WHERE r <= floor(c * 100 / n)""")
def stratified_quota(spark, sf_dir):
    return M.stratified_quota(table(spark, sf_dir, "documents"), "lang", "doc_id", 100, F.md5(F.col("doc_id").cast("string").cast("binary")))


@query("group_kfold", "SELECT source, ((row_number() OVER (ORDER BY source) - 1) % 5)::INT AS fold FROM (SELECT DISTINCT source FROM documents)")
def group_kfold(spark, sf_dir):
    return M.group_folds(table(spark, sf_dir, "documents"), "source", 5)


@query("latency_percentiles", "SELECT event_type, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95, quantile_cont(value, 0.99) AS p99, avg(value) AS mean FROM events GROUP BY event_type", "p50 p95 p99 mean")
def latency_percentiles(spark, sf_dir):
    return M.percentiles(table(spark, sf_dir, "events"), "value", ["event_type"])


CLAIM = "CASE (l_orderkey + l_linenumber) % 11 WHEN 0 THEN 'CONTRADICTED' WHEN 1 THEN 'CONFLICTING' WHEN 2 THEN 'UNKNOWN' WHEN 3 THEN 'WEAK' ELSE 'SUPPORTED' END"


@query("claim_aggregate", f"""SELECT l_orderkey, CASE WHEN bool_or(s = 'CONTRADICTED') THEN 'CONTRADICTED' WHEN bool_or(s = 'CONFLICTING') THEN 'CONFLICTING' WHEN bool_or(s = 'UNKNOWN') THEN 'UNKNOWN' WHEN bool_and(s = 'SUPPORTED') THEN 'SUPPORTED' ELSE 'MIXED' END AS label
FROM (SELECT l_orderkey, {CLAIM} AS s FROM lineitem) GROUP BY l_orderkey""")
def claim_aggregate(spark, sf_dir):
    return M.aggregate_claims(table(spark, sf_dir, "lineitem").withColumn("s", F.expr(CLAIM)), "l_orderkey", "s")


@query("policy_decision", """WITH f AS (SELECT l_orderkey, l_returnflag AS category, 1 + l_linenumber % 4 AS severity, 1 - l_discount * 2 AS confidence FROM lineitem),
r(rule_id, rc, sev, action) AS (VALUES (1, 'R', 2, 'review'), (2, 'A', 4, 'block'), (3, NULL, 4, 'warn'))
SELECT l_orderkey, (['allow', 'warn', 'review', 'block'])[max(coalesce(CASE action WHEN 'warn' THEN 1 WHEN 'review' THEN 2 WHEN 'block' THEN 3 END, 0)) + 1] AS action, count(DISTINCT rule_id) AS matched, max(severity / 4 * confidence) AS risk
FROM f LEFT JOIN r ON (rc IS NULL OR rc = category) AND severity >= sev GROUP BY l_orderkey""", "risk")
def policy_decision(spark, sf_dir):
    f = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_returnflag").alias("category"), (1 + F.col("l_linenumber") % 4).alias("severity"), (1 - F.col("l_discount") * 2).alias("confidence"))
    rules = spark.createDataFrame([(1, "R", 2, "review"), (2, "A", 4, "block"), (3, None, 4, "warn")], "rule_id int, category string, severity_at_least int, action string")
    return M.decide(f, rules, "l_orderkey", "allow", ["allow", "warn", "review", "block"])
