"""Evidence operators over lineitem (measurements), part and supplier (assets) and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from orebed.functions.text import fold
from orebed.operators import evidence as V
from orebed.queries.base import query, table

UNIT_OF = "CASE l_returnflag WHEN 'A' THEN 'kPa' WHEN 'N' THEN 'psi' WHEN 'R' THEN 'furlong' END"


@query("unit_normalize", f"""SELECT l_orderkey, l_linenumber, CASE u WHEN 'kPa' THEN l_quantity * 0.01::DOUBLE WHEN 'psi' THEN l_quantity * 0.0689475729::DOUBLE END AS canonical_value,
CASE WHEN u IN ('kPa', 'psi') THEN 'bar' END AS canonical_unit, CASE WHEN u IS NULL THEN 'UNIT_MISSING' WHEN u IN ('kPa', 'psi') THEN 'OK' ELSE 'UNIT_UNKNOWN' END AS unit_status FROM (SELECT *, {UNIT_OF} AS u FROM lineitem)""", "canonical_value")
def unit_normalize(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumn("unit", F.expr(UNIT_OF))
    return V.normalize_units(li, "l_quantity").select("l_orderkey", "l_linenumber", "canonical_value", "canonical_unit", "unit_status")


RULES = "(VALUES ('A', '<=', 40.0::DOUBLE, NULL::DOUBLE), ('N', 'between', 10.0, 30.0), ('R', '>', 5.0, NULL), ('R', '<', NULL, NULL)) AS r(metric, op, low, high)"
RULE_CASE = "CASE op WHEN '<' THEN value < low WHEN '<=' THEN value <= low WHEN '>' THEN value > low WHEN 'between' THEN value BETWEEN low AND high END"


def _rules(spark):
    return spark.createDataFrame([("A", "<=", 40.0, None), ("N", "between", 10.0, 30.0), ("R", ">", 5.0, None), ("R", "<", None, None)], "metric string, op string, low double, high double")


@query("rule_evaluation", f"""SELECT metric, op, status, count(*) AS n FROM (SELECT metric, op, CASE WHEN ok IS NULL THEN 'UNVERIFIED' WHEN ok THEN 'NORMAL' ELSE 'DEVIATION' END AS status
FROM (SELECT metric, op, {RULE_CASE} AS ok FROM (SELECT l_returnflag AS metric, l_quantity AS value FROM lineitem) JOIN {RULES} USING (metric))) GROUP BY ALL""")
def rule_evaluation(spark, sf_dir):
    m = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("metric"), F.col("l_quantity").alias("value"))
    return V.evaluate_rules(m, _rules(spark)).groupBy("metric", "op", "status").agg(F.count(F.lit(1)).alias("n"))


@query("findings_status", f"""WITH e AS (SELECT l_suppkey, metric, {RULE_CASE} AS ok FROM (SELECT l_suppkey, l_returnflag AS metric, l_quantity AS value FROM lineitem) JOIN {RULES} USING (metric))
SELECT l_suppkey, CASE WHEN count(*) FILTER (NOT ok) > 40 THEN 'CRITICAL' WHEN count(*) FILTER (NOT ok) > 0 THEN 'DEVIATION' WHEN count(ok) = 0 THEN 'UNVERIFIED' ELSE 'NORMAL' END AS status FROM e GROUP BY l_suppkey""")
def findings_status(spark, sf_dir):
    """A ladder over all findings of a supplier."""
    m = table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_returnflag").alias("metric"), F.col("l_quantity").alias("value"))
    g = V.evaluate_rules(m, _rules(spark)).groupBy("l_suppkey").agg(F.count_if(~F.col("result")).alias("bad"), F.count("result").alias("known"))
    return g.select("l_suppkey", fold({"CRITICAL": F.col("bad") > 40, "DEVIATION": F.col("bad") > 0, "UNVERIFIED": F.col("known") == 0}, "NORMAL").alias("status"))


@query("requirement_status", """WITH r(req, p_brand, p_size) AS (VALUES (1, 'Brand#11', NULL::INT), (2, NULL, 7), (3, 'Brand#99', NULL), (4, NULL, NULL), (5, 'Brand#22', 3))
SELECT req, r.p_brand, r.p_size, count(p_partkey) AS n_evidence, count(p_partkey) > 0 AS satisfied FROM r LEFT JOIN part ON (r.p_brand IS NULL OR r.p_brand = part.p_brand) AND (r.p_size IS NULL OR r.p_size = part.p_size) GROUP BY ALL""")
def requirement_status(spark, sf_dir):
    req = spark.createDataFrame([(1, "Brand#11", None), (2, None, 7), (3, "Brand#99", None), (4, None, None), (5, "Brand#22", 3)], "req int, p_brand string, p_size int")
    return V.satisfied_requirements(req, table(spark, sf_dir, "part"), "req", ["p_brand", "p_size"])


@query("measurement_discrepancy", """SELECT l_partkey, min(l_discount) AS low, max(l_discount) AS high, count(DISTINCT l_suppkey) AS sources FROM lineitem GROUP BY l_partkey HAVING count(DISTINCT l_suppkey) > 1 AND max(l_discount) - min(l_discount) > 0.095""", "low high")
def measurement_discrepancy(spark, sf_dir):
    return V.discrepancies(table(spark, sf_dir, "lineitem"), ["l_partkey"], "l_suppkey", "l_discount", 0.095)


@query("rule_conflicts", """SELECT p_brand, count(DISTINCT p_type) AS n_values, count(DISTINCT p_size) AS n_revisions FROM part GROUP BY p_brand HAVING count(DISTINCT p_type) > 1 AND count(DISTINCT p_size) > 1""")
def rule_conflicts(spark, sf_dir):
    return V.conflicts(table(spark, sf_dir, "part"), ["p_brand"], F.col("p_type"), "p_size")


@query("referential_violations", """SELECT 'lineitem.orders' AS reference, key FROM (SELECT DISTINCT l_orderkey AS key FROM lineitem) WHERE key NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 97 <> 0)
UNION ALL SELECT 'orders.customer', key FROM (SELECT DISTINCT o_custkey AS key FROM orders) WHERE key NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 89 <> 0)""")
def referential_violations(spark, sf_dir):
    """Dangling keys against parents from which some rows were taken."""
    t = lambda n: table(spark, sf_dir, n)
    orders = V.dangling(t("lineitem"), "l_orderkey", t("orders").where("o_orderkey % 97 <> 0"), "o_orderkey", "lineitem.orders")
    return orders.unionByName(V.dangling(t("orders"), "o_custkey", t("customer").where("c_custkey % 89 <> 0"), "c_custkey", "orders.customer"))


@query("manifest_diff", """WITH a AS (SELECT doc_id, sha256(text) AS d FROM documents WHERE doc_id % 10 <> 1), b AS (SELECT doc_id, sha256(CASE WHEN doc_id % 10 = 3 THEN text || '!' ELSE text END) AS d FROM documents WHERE doc_id % 10 <> 2)
SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN b.d IS NULL THEN 'MISSING' WHEN a.d IS NULL THEN 'UNEXPECTED' ELSE 'MISMATCH' END AS status FROM a FULL JOIN b USING (doc_id) WHERE a.d IS DISTINCT FROM b.d""")
def manifest_diff(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    a = docs.where("doc_id % 10 <> 1").select("doc_id", F.sha2("text", 256).alias("d"))
    b = docs.where("doc_id % 10 <> 2").select("doc_id", F.sha2(F.expr("CASE WHEN doc_id % 10 = 3 THEN concat(text, '!') ELSE text END"), 256).alias("d"))
    return V.manifest_diff(a, b, "doc_id", "d")


@query("graph_upsert", """SELECT c_custkey, c_name FROM customer WHERE c_custkey % 3 <> 0 UNION ALL SELECT c_custkey, upper(c_name) FROM customer WHERE c_custkey % 3 = 0""")
def graph_upsert(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return V.upsert(c, c.where("c_custkey % 3 = 0").withColumn("c_name", F.upper("c_name")), "c_custkey")


@query("merge_by_id", """SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 2 WHEN c_custkey % 2 = 0 THEN 1 ELSE 0 END AS version FROM customer""")
def merge_by_id(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey")
    return V.latest_by_source([c.withColumn("version", F.lit(0)), c.where("c_custkey % 2 = 0").withColumn("version", F.lit(1)), c.where("c_custkey % 5 = 0").withColumn("version", F.lit(2))], "c_custkey")


@query("content_dedup", "SELECT sha256(coalesce(text, '')) AS checksum, min(doc_id) AS keeper, count(*) AS copies FROM documents GROUP BY 1")
def content_dedup(spark, sf_dir):
    return V.content_dedup(table(spark, sf_dir, "documents"), "text", "doc_id")


NUM = "'^[+-]?[0-9]+(\\.[0-9]+)?([eE][+-]?[0-9]+)?$'"


@query("profile_columns", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS n, count(*) FILTER ({c} IS NULL OR trim({c}::VARCHAR) = '') AS blanks, count(*) FILTER (regexp_matches(trim({c}::VARCHAR), {NUM})) AS numeric FROM customer" for c in ("c_custkey", "c_name", "c_nationkey", "c_mktsegment")))
def profile_columns(spark, sf_dir):
    return V.profile(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment"))


@query("temporal_leakage", """WITH s AS (SELECT user_id, CASE WHEN event_id % 10 < 7 THEN 'dev' ELSE 'eval' END AS split, ts FROM events)
SELECT user_id FROM s GROUP BY user_id HAVING max(ts) FILTER (split = 'dev') >= min(ts) FILTER (split = 'eval')""")
def temporal_leakage(spark, sf_dir):
    s = table(spark, sf_dir, "events").withColumn("split", F.expr("CASE WHEN event_id % 10 < 7 THEN 'dev' ELSE 'eval' END"))
    return V.temporal_leaks(s, "user_id", "split", "ts", "ts")


@query("asset_timeline", """WITH i AS (SELECT 'order' AS kind, o_orderkey AS id, o_custkey AS asset, epoch(o_orderdate) AS x FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) <= 3),
m AS (SELECT 'return' AS kind, l_orderkey AS id, o_custkey AS asset, epoch(max(l_shipdate)) AS x FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' GROUP BY l_orderkey, o_custkey)
SELECT asset, kind, id FROM (SELECT * FROM i UNION ALL SELECT * FROM m) QUALIFY row_number() OVER (PARTITION BY asset ORDER BY x DESC, kind, id) <= 5""")
def asset_timeline(spark, sf_dir):
    """Latest five entries of each customer from two limited histories."""
    from pyspark.sql import Window

    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    i = o.withColumn("_r", F.row_number().over(w)).where("_r <= 3").select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("asset"), F.col("o_orderdate").alias("x"))
    r = li.where("l_returnflag = 'R'").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("x")).join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.lit("return").alias("kind"), F.col("l_orderkey").alias("id"), F.col("o_custkey").alias("asset"), "x")
    best = Window.partitionBy("asset").orderBy(F.desc("x"), "kind", "id")
    return i.unionByName(r).withColumn("_r", F.row_number().over(best)).where("_r <= 5").select("asset", "kind", "id")


@query("split_manifest_overlap", "SELECT user_id FROM events WHERE event_type = 'purchase' INTERSECT SELECT user_id FROM events WHERE event_type = 'signup'")
def split_manifest_overlap(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    return ev.where("event_type = 'purchase'").select("user_id").intersect(ev.where("event_type = 'signup'").select("user_id"))


@query("node_universe", "SELECT DISTINCT * FROM (SELECT 's' || s_suppkey AS node FROM supplier UNION ALL SELECT 'p' || l_partkey FROM lineitem UNION ALL SELECT 's' || l_suppkey FROM lineitem)")
def node_universe(spark, sf_dir):
    li, s = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "supplier")
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string")).alias("node")
    return s.select(name("s", "s_suppkey")).union(li.select(name("p", "l_partkey"))).union(li.select(name("s", "l_suppkey"))).distinct()
