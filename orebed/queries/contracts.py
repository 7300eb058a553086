"""Contract, access and reference operators over orders, lines, parts, suppliers, customers and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from orebed.operators import contracts as K
from orebed.operators import series as S
from orebed.operators.series import seconds
from orebed.queries.base import EVENTS_SQL, SERIES, query, series, table


def t(spark, sf_dir, name):
    return table(spark, sf_dir, name)


@query("payload_violations", """SELECT l_orderkey, l_linenumber, l_partkey, unnest(list_filter([CASE WHEN l_discount * 2 > l_quantity / 50 THEN 'NYQUIST' END, CASE WHEN l_tax > 0.07 THEN 'UNIT' END, CASE WHEN l_quantity < 3 THEN 'TOO_SHORT' END, CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN 'POLICY' END], lambda x: x IS NOT NULL)) AS rule FROM lineitem""")
def payload_violations(spark, sf_dir):
    c = F.col
    return K.violations(t(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber", "l_partkey"], {"NYQUIST": c("l_discount") * 2 > c("l_quantity") / 50, "UNIT": c("l_tax") > 0.07, "TOO_SHORT": c("l_quantity") < 3, "POLICY": (c("l_returnflag") == "R") & (c("l_linestatus") == "O")})


@query("rule_shapes", """SELECT p_partkey, CASE WHEN op = 'between' THEN 'BOUNDS' ELSE 'THRESHOLD' END AS rule FROM (SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'between' ELSE '<=' END AS op, CASE WHEN p_size % 5 > 0 THEN p_retailprice END AS low, CASE WHEN p_size % 7 > 0 THEN p_retailprice + 1 END AS high FROM part) WHERE (op = 'between' AND (low IS NULL OR high IS NULL)) OR (op <> 'between' AND low IS NULL)""")
def rule_shapes(spark, sf_dir):
    """Rules that lack the bounds or the threshold that their operator needs."""
    p = t(spark, sf_dir, "part").select("p_partkey", F.expr("CASE p_size % 3 WHEN 0 THEN 'between' ELSE '<=' END").alias("op"), F.expr("CASE WHEN p_size % 5 > 0 THEN p_retailprice END").alias("low"), F.expr("CASE WHEN p_size % 7 > 0 THEN p_retailprice + 1 END").alias("high"))
    return K.violations(p, ["p_partkey"], {"BOUNDS": (F.col("op") == "between") & (F.col("low").isNull() | F.col("high").isNull()), "THRESHOLD": (F.col("op") != "between") & F.col("low").isNull()})


@query("time_contract", f"""WITH {EVENTS_SQL}, d AS (SELECT user_id, event_type, x, x - lag(x) OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS d FROM ev)
SELECT user_id, event_type, count(*) FILTER (d <= 0) AS backward, max(x) - min(x) >= (count(*) - 1) / 0.0001 AS covered, 1704067200.0 + any_value(user_id) * 3600 < min(x) AS reference_first FROM d GROUP BY ALL""")
def time_contract(spark, sf_dir):
    ev = t(spark, sf_dir, "events")
    return K.time_contract(ev, SERIES, "event_id", seconds("ts"), 0.0001, F.lit(1704067200.0) + F.first("user_id") * 3600)


@query("identity_profile", """SELECT l_suppkey, sha256(string_agg(p, ',' ORDER BY p)) AS profile FROM (SELECT DISTINCT l_suppkey, l_returnflag || '=' || l_linestatus AS p FROM lineitem) GROUP BY l_suppkey""")
def identity_profile(spark, sf_dir):
    return K.identity_profile(t(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_returnflag", "l_linestatus")


@query("development_units", """WITH a AS (SELECT DISTINCT user_id FROM events), d AS (SELECT DISTINCT c_custkey AS user_id FROM customer WHERE c_nationkey < 5) SELECT user_id, 'MISSING' AS side FROM d ANTI JOIN a USING (user_id) UNION ALL SELECT user_id, 'UNDECLARED' FROM a ANTI JOIN d USING (user_id)""")
def development_units(spark, sf_dir):
    """Units of the events against those that a manifest (customers of five nations) declares."""
    return K.set_difference(t(spark, sf_dir, "events"), t(spark, sf_dir, "customer").where("c_nationkey < 5").select(F.col("c_custkey").alias("user_id")), "user_id")


@query("pack_faults", """SELECT 'DUPLICATE' AS fault, 'orders' AS entity, c::VARCHAR AS id FROM (SELECT o_custkey AS c FROM orders GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'DUPLICATE', 'supplier', s_name FROM supplier GROUP BY s_name HAVING count(*) > 1
UNION ALL SELECT 'DANGLING', 'orders.o_orderkey', k::VARCHAR FROM (SELECT DISTINCT o_orderkey AS k FROM orders) WHERE k NOT IN (SELECT o_custkey FROM orders)""")
def pack_faults(spark, sf_dir):
    """A pack whose orders are named by customer and refer to each other by order key."""
    return K.pack_faults({"orders": t(spark, sf_dir, "orders"), "supplier": t(spark, sf_dir, "supplier")}, {"orders": "o_custkey", "supplier": "s_name"}, [("orders", "o_orderkey", "orders")])


@query("scope_overlap", """SELECT p_partkey, list_has_any(['small', 'internal'], CASE WHEN p_size % 4 = 0 THEN ['internal'] ELSE [lower(trim(p_type)), lower(p_brand)] END) AS allowed FROM part""")
def scope_overlap(spark, sf_dir):
    own = F.when(F.col("p_size") % 4 != 0, F.array(F.concat(F.lit(" "), "p_type"), F.col("p_brand")))
    return t(spark, sf_dir, "part").select("p_partkey", K.scopes_overlap(F.array(F.lit("Small "), F.lit("INTERNAL")), own).alias("allowed"))


@query("access_decision", """WITH j AS (SELECT o_orderkey, c_mktsegment <> 'MACHINERY' AS permitted, CASE WHEN c_nationkey % 9 = 0 THEN '*' ELSE (c_nationkey % 3)::VARCHAR END AS org, c_nationkey % 4 AS clearance, CASE WHEN c_nationkey % 5 = 0 THEN '*' ELSE (c_nationkey % 2)::VARCHAR END AS ws, c_custkey % 3 AS dep, c_custkey AS id,
(o_orderkey % 3)::VARCHAR AS o_org, o_orderkey % 4 AS cls, (o_orderkey % 2)::VARCHAR AS o_ws, CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey % 3 END AS o_dep, o_orderkey % 100 AS owner, CASE WHEN o_orderkey % 7 = 0 THEN [o_custkey, 1] WHEN o_orderkey % 11 = 0 THEN [1] END AS users FROM orders JOIN customer ON o_custkey = c_custkey),
g AS (SELECT *, coalesce(list_contains(users, id), false) OR owner = id AS granted FROM j)
SELECT o_orderkey, CASE WHEN NOT permitted THEN 'ACCESS_DENIED' WHEN NOT (o_org = org OR org = '*') THEN 'ACCESS_DENIED' WHEN NOT clearance >= cls THEN 'INSUFFICIENT_CLEARANCE' WHEN NOT (o_ws = ws OR ws = '*') THEN 'WORKSPACE_SCOPE_MISMATCH'
WHEN NOT (o_dep IS NULL OR o_dep = dep OR granted) THEN 'DEPARTMENT_SCOPE_MISMATCH' WHEN coalesce(len(users), 0) > 0 AND NOT granted THEN 'ACCESS_DENIED' ELSE 'ACCESS_ALLOWED' END AS reason FROM g""")
def access_decision(spark, sf_dir):
    """Whether each order's customer may read it."""
    j = t(spark, sf_dir, "orders").join(t(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    who = {"permitted": "c_mktsegment <> 'MACHINERY'", "org": "CASE WHEN c_nationkey % 9 = 0 THEN '*' ELSE string(c_nationkey % 3) END", "clearance": "c_nationkey % 4", "workspace": "CASE WHEN c_nationkey % 5 = 0 THEN '*' ELSE string(c_nationkey % 2) END", "department": "c_custkey % 3", "id": "c_custkey"}
    what = {"org": "string(o_orderkey % 3)", "classification": "o_orderkey % 4", "workspace": "string(o_orderkey % 2)", "department": "CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey % 3 END", "owner": "o_orderkey % 100", "users": "CASE WHEN o_orderkey % 7 = 0 THEN array(o_custkey, 1L) WHEN o_orderkey % 11 = 0 THEN array(1L) END"}
    return j.select("o_orderkey", K.access_reason({k: F.expr(v) for k, v in who.items()}, {k: F.expr(v) for k, v in what.items()}).alias("reason"))


@query("asset_resolution", """WITH r AS (SELECT DISTINCT p_name || CASE WHEN p_size % 10 = 0 THEN ' x' ELSE '' END AS ref FROM part), k AS (SELECT lower(p_name) AS k, p_partkey, p_partkey % 4 = 0 AS may FROM part WHERE p_partkey % 10 < 4)
SELECT ref, CASE WHEN count(p_partkey) = 0 THEN 'NOT_FOUND' WHEN count(*) FILTER (may) = 0 THEN 'DENIED' WHEN count(*) FILTER (may) > 1 THEN 'AMBIGUOUS' ELSE 'RESOLVED' END AS status, CASE WHEN count(*) FILTER (may) = 1 THEN min(p_partkey) FILTER (may) END AS p_partkey FROM r LEFT JOIN k ON lower(ref) = k GROUP BY ref""")
def asset_resolution(spark, sf_dir):
    """Parts' names against a catalogue of some parts, a quarter of which may be read."""
    p = t(spark, sf_dir, "part")
    refs = p.select(F.concat("p_name", F.expr("CASE WHEN p_size % 10 = 0 THEN ' x' ELSE '' END")).alias("ref"))
    return K.resolved(refs, p.where("p_partkey % 10 < 4").withColumn("may", F.col("p_partkey") % 4 == 0), "ref", "p_name", "p_partkey", "may")


@query("entity_resolution", """WITH n AS (SELECT DISTINCT c_custkey, lower(unnest([c_mktsegment, CASE c_nationkey % 3 WHEN 0 THEN 'RED widget' ELSE 'none such' END])) AS l FROM customer), f AS (SELECT lower(p_name) AS l, p_partkey FROM part QUALIFY row_number() OVER (PARTITION BY lower(p_name) ORDER BY p_partkey) <= 3), h AS (SELECT DISTINCT c_custkey, p_partkey FROM n JOIN f USING (l))
SELECT * FROM h UNION ALL SELECT c_custkey, -1 FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM h)""")
def entity_resolution(spark, sf_dir):
    names = t(spark, sf_dir, "customer").select("c_custkey", F.explode(F.array(F.col("c_mktsegment"), F.expr("CASE c_nationkey % 3 WHEN 0 THEN 'RED widget' ELSE 'none such' END"))).alias("name"))
    return K.resolved_entities(names, t(spark, sf_dir, "part"), "c_custkey", "name", "p_name", "p_partkey", -1)


@query("nested_evidence", """SELECT l_orderkey, len(e)::INT AS n, md5(array_to_string(list_transform(e, lambda x: x.k || ':' || x.b), ',')) AS digest FROM (SELECT l_orderkey, list({'k': l_partkey, 'b': p_brand} ORDER BY l_partkey) AS e FROM (SELECT l_orderkey, l_partkey, p_brand FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) JOIN part ON l_partkey = p_partkey QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey) <= 3) GROUP BY l_orderkey)""")
def nested_evidence(spark, sf_dir):
    links = t(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").distinct()
    e = K.nested_evidence(links, t(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_orderkey", "l_partkey", ["p_brand"], 3)
    return e.select("l_orderkey", F.size("evidence").alias("n"), F.md5(F.array_join(F.transform("evidence", lambda x: F.concat_ws(":", x["l_partkey"], x["p_brand"])), ",").cast("binary")).alias("digest"))


@query("linked_or_first", """WITH l AS (SELECT DISTINCT o_orderkey AS claim, l_partkey AS chunk FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_returnflag = 'R'), f AS (SELECT p_size AS grp, p_partkey AS chunk FROM part QUALIFY row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) <= 3)
SELECT claim, chunk, true AS linked FROM l UNION ALL SELECT o_orderkey, chunk, false FROM orders JOIN f ON grp = o_orderkey % 60 WHERE o_orderkey NOT IN (SELECT claim FROM l)""")
def linked_or_first(spark, sf_dir):
    claims = t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("claim"), (F.col("o_orderkey") % 60).alias("grp"))
    links = t(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("claim"), F.col("l_partkey").alias("chunk")).distinct()
    return K.linked_or_first(claims, links, t(spark, sf_dir, "part").select(F.col("p_size").cast("long").alias("grp"), F.col("p_partkey").alias("chunk")), "claim", "grp", "chunk")


CATALOG = [(1, "A", ["A", "N"]), (2, "R", ["R", "N", "A"]), (3, "N", ["N"])]


@query("catalog_match", """WITH u AS (SELECT l_suppkey, arg_max(l_returnflag, (l_quantity, l_orderkey, l_linenumber, l_returnflag)) AS root, list_distinct(list(l_returnflag) FILTER (l_quantity >= 50)) AS aff FROM lineitem GROUP BY l_suppkey), c(pattern, root, aff) AS (VALUES (1, 'A', ['A', 'N']), (2, 'R', ['R', 'N', 'A']), (3, 'N', ['N'])),
s AS (SELECT l_suppkey, pattern, CASE WHEN u.root = c.root THEN 0.6 ELSE 0 END + 0.4 * coalesce(len(list_intersect(u.aff, c.aff)), 0) / len(c.aff) AS score FROM u, c) SELECT l_suppkey, pattern, score FROM s QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY round(score, 9) DESC, pattern) = 1""", "score")
def catalog_match(spark, sf_dir):
    """Suppliers' largest line and set of large lines against three patterns."""
    u = t(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.max_by("l_returnflag", F.struct("l_quantity", "l_orderkey", "l_linenumber", "l_returnflag")).alias("root"), F.collect_set(F.when(F.col("l_quantity") >= 50, F.col("l_returnflag"))).alias("affected"))
    return K.catalog_match(u, spark.createDataFrame(CATALOG, "pattern int, root string, affected array<string>"), "l_suppkey")


@query("superseded_claims", """WITH r AS (SELECT l_partkey AS family, l_quantity AS v, l_linestatus = 'O' AS current FROM lineitem) SELECT p_partkey FROM part WHERE (p_partkey, (p_size % 50 + 1)::DOUBLE) IN (SELECT (family, v) FROM r WHERE NOT current) AND (p_partkey, (p_size % 50 + 1)::DOUBLE) NOT IN (SELECT (family, v) FROM r WHERE current)""")
def superseded_claims(spark, sf_dir):
    records = t(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("family"), F.col("l_quantity").alias("v"), (F.col("l_linestatus") == "O").alias("current"))
    asserted = t(spark, sf_dir, "part").select("p_partkey", F.col("p_partkey").alias("family"), (F.col("p_size") % 50 + 1).cast("double").alias("v"))
    return K.superseded_claims(asserted, records, "p_partkey", "family", "v")


@query("split_units", """SELECT event_type, epoch(min(ts)) AS start, epoch(max(ts)) AS "end", count(DISTINCT user_id)::INT AS n_assets, sha256(event_type || '|' || string_agg(DISTINCT user_id::VARCHAR, ',' ORDER BY user_id::VARCHAR)) AS checksum FROM events GROUP BY event_type""", "start", digits=2)
def split_units(spark, sf_dir):
    return K.split_units(t(spark, sf_dir, "events"), ["event_type"], "user_id", seconds("ts"))


@query("asset_context", f"""WITH {EVENTS_SQL}, l AS (SELECT user_id, event_type, arg_max(value, t_idx) AS value, regr_slope(value, t_idx) AS slope FROM ev GROUP BY ALL), r(event_type, low, high) AS (VALUES ('click', 2.0::DOUBLE, 12.0::DOUBLE), ('view', 0.0, 9.0), ('error', 5.0, 30.0))
SELECT user_id, event_type, value, slope, low, high, value BETWEEN low AND high AS within, row_number() OVER (PARTITION BY user_id ORDER BY coalesce(value BETWEEN low AND high, true), round(abs(slope), 9) DESC NULLS LAST, event_type) AS place FROM l LEFT JOIN r USING (event_type) QUALIFY place <= 3""", "value slope")
def asset_context(spark, sf_dir):
    ev = series(spark, sf_dir)
    latest = ev.groupBy(*SERIES).agg(F.max_by("value", "t_idx").alias("value"))
    trends = ev.groupBy(*SERIES).agg(S.slope("value", F.col("t_idx").cast("double")).alias("slope"))
    rules = spark.createDataFrame([("click", 2.0, 12.0), ("view", 0.0, 9.0), ("error", 5.0, 30.0)], "event_type string, low double, high double")
    return K.asset_context(latest, trends, rules, SERIES, 3).select(*SERIES, "value", "slope", "low", "high", "within", "place")


@query("scenario_tallies", """WITH s AS (SELECT o_orderstatus AS g, CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority[1] END AS e, CASE WHEN o_orderkey % 5 > 0 THEN (o_orderkey % 5 + 1)::VARCHAR END AS a FROM orders)
SELECT g, count(*) AS cases, count(*) FILTER (e IS NOT DISTINCT FROM a) AS matched, count(*) FILTER (e IS NOT NULL AND e IS DISTINCT FROM a) AS missed, count(*) FILTER (a IS NOT NULL AND e IS DISTINCT FROM a) AS unexpected FROM s GROUP BY g""")
def scenario_tallies(spark, sf_dir):
    o = t(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("g"), F.expr("CASE WHEN o_orderkey % 3 > 0 THEN substring(o_orderpriority, 1, 1) END").alias("e"), F.expr("CASE WHEN o_orderkey % 5 > 0 THEN string(o_orderkey % 5 + 1) END").alias("a"))
    return K.tallies(o, "e", "a", "g")


@query("sampling_summary", "SELECT quality AS label, count(*) AS n, count(DISTINCT doc_id) AS sources FROM labels GROUP BY quality")
def sampling_summary(spark, sf_dir):
    return t(spark, sf_dir, "labels").groupBy(F.col("quality").alias("label")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("sources"))


@query("timing_rollup", """SELECT l_suppkey, stage, count(*) AS calls, sum(seconds) AS seconds FROM (SELECT l_suppkey, unnest([{'stage': 'tool', 'seconds': l_quantity / 10}, {'stage': 'model', 'seconds': l_discount}, {'stage': 'call', 'seconds': l_tax}], recursive := true) FROM lineitem) GROUP BY ALL""", "seconds")
def timing_rollup(spark, sf_dir):
    pair = lambda n, c: F.struct(F.lit(n).alias("name"), c.alias("seconds"))
    li = t(spark, sf_dir, "lineitem").select("l_suppkey", F.array(pair("tool", F.col("l_quantity") / 10), pair("model", F.col("l_discount")), pair("call", F.col("l_tax"))).alias("stages"))
    return K.timing_rollup(li, "l_suppkey", "stages")


@query("self_consistency", """WITH n AS (SELECT l_partkey, l_returnflag, count(DISTINCT l_suppkey) AS c FROM lineitem GROUP BY ALL) SELECT l_partkey, CASE WHEN sum(c) > 1 THEN sum(c * (c - 1)) / (sum(c) * (sum(c) - 1)) END AS agreement FROM n GROUP BY l_partkey""", "agreement")
def self_consistency(spark, sf_dir):
    """How far suppliers' samples agree on a part's flag."""
    return K.agreement(t(spark, sf_dir, "lineitem"), "l_partkey", "l_suppkey", "l_returnflag")


@query("component_comparison", """WITH s AS (SELECT l_returnflag AS component, l_partkey, avg(l_quantity) AS score FROM lineitem GROUP BY ALL), b AS (SELECT l_partkey, score AS b FROM s WHERE component = 'A')
SELECT component, count(*) AS n, avg(score) AS mean, count(*) FILTER (score > b) AS wins, count(*) FILTER (score < b) AS losses FROM s JOIN b USING (l_partkey) GROUP BY component""", "mean")
def component_comparison(spark, sf_dir):
    s = t(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("component"), "l_partkey").agg(F.avg("l_quantity").alias("score"))
    return K.compared(s, "component", "l_partkey", "score", "A")


@query("span_recall", """WITH e AS (SELECT DISTINCT l_orderkey, l_quantity::INT AS s, l_quantity::INT + 4 AS e FROM lineitem WHERE l_returnflag <> 'N'), f AS (SELECT DISTINCT l_orderkey, l_quantity::INT AS s, l_quantity::INT + 3 AS e FROM lineitem WHERE l_returnflag = 'N'), h AS (SELECT DISTINCT e.* FROM e JOIN f ON e.l_orderkey = f.l_orderkey AND f.s < e.e AND e.s < f.e)
SELECT e.l_orderkey, count(*) AS spans, count(h.s) AS hit FROM e LEFT JOIN h ON e.l_orderkey = h.l_orderkey AND e.s = h.s AND e.e = h.e GROUP BY e.l_orderkey""")
def span_recall(spark, sf_dir):
    li = t(spark, sf_dir, "lineitem").withColumn("start", F.col("l_quantity").cast("int"))
    return K.span_recall(li.where("l_returnflag <> 'N'").withColumn("end", F.col("start") + 4), li.where("l_returnflag = 'N'").withColumn("end", F.col("start") + 3), "l_orderkey")


STANDARD_SQL = "SELECT l_orderkey, l_linenumber, l_partkey, CASE l_returnflag WHEN 'R' THEN 'abstain' WHEN 'A' THEN 'diagnose' ELSE 'monitor' END AS decision, CASE WHEN l_quantity > 2 THEN l_quantity / 45 END AS confidence, CASE WHEN l_linestatus = 'O' THEN 'why' END AS reason FROM lineitem"


@query("standard_result", f"""SELECT l_orderkey, l_linenumber, l_partkey, greatest(0, least(1, coalesce(confidence, 0))) AS confidence, CASE WHEN confidence IS NULL OR confidence < 0 OR confidence > 1 THEN 'OUT_OF_RANGE' WHEN decision = 'abstain' AND reason IS NULL THEN 'ABSTAINED_WITHOUT_REASON' WHEN decision <> 'abstain' AND reason IS NOT NULL THEN 'REASON_WITHOUT_ABSTENTION' END AS issue FROM ({STANDARD_SQL})""", "confidence")
def standard_result(spark, sf_dir):
    li = t(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_partkey", "CASE l_returnflag WHEN 'R' THEN 'abstain' WHEN 'A' THEN 'diagnose' ELSE 'monitor' END AS decision", "CASE WHEN l_quantity > 2 THEN l_quantity / 45 END AS confidence", "CASE WHEN l_linestatus = 'O' THEN 'why' END AS reason")
    return K.standard_result(li, "decision", "confidence", "reason").select("l_orderkey", "l_linenumber", "l_partkey", "confidence", "issue")


@query("domain_decisions", """WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, (['bearing', 'process', 'wind', 'battery'])[(l_partkey % 4 + 1)::INT] AS d, l_quantity > 35 AS det, l_quantity > 25 AS warn, l_tax > 0.02 AS meta, CASE WHEN l_discount > 0.09 THEN 'gap' END AS reason FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN reason IS NOT NULL THEN 'abstain' WHEN d = 'bearing' AND NOT meta THEN 'abstain' WHEN det THEN 'diagnose' WHEN d = 'process' AND warn THEN 'early_action' ELSE 'monitor' END AS decision FROM s""")
def domain_decisions(spark, sf_dir):
    domain = F.get(F.array(*[F.lit(d) for d in ("bearing", "process", "wind", "battery")]), (F.col("l_partkey") % 4).cast("int"))
    flags = {"detected": F.col("l_quantity") > 35, "warning": F.col("l_quantity") > 25, "metadata": F.col("l_tax") > 0.02, "reason": F.expr("CASE WHEN l_discount > 0.09 THEN 'gap' END")}
    return t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", K.domain_decision(domain, flags).alias("decision"))
