"""Claim operators over documents, conversations, benchmark items and statements made from line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from orebed.operators import claims as C
from orebed.queries.base import query, table


def q(pattern: str) -> str:
    return pattern.replace("'", "''")


FACTOR = "CASE regexp_extract(r, '(thousand|million|billion|crore|lakh|bn|mn|k|m)$', 1) WHEN 'k' THEN 1e3 WHEN 'thousand' THEN 1e3 WHEN 'm' THEN 1e6 WHEN 'mn' THEN 1e6 WHEN 'million' THEN 1e6 WHEN 'bn' THEN 1e9 WHEN 'billion' THEN 1e9 WHEN 'lakh' THEN 1e5 WHEN 'crore' THEN 1e7 ELSE 1 END"


@query("number_facts", f"""WITH n AS (SELECT doc_id, replace(lower(trim(unnest(regexp_extract_all(text, '{q(C.NUMBER)}', 1)))), ',', '') AS r FROM documents)
SELECT DISTINCT doc_id, regexp_extract(r, '([+-]?[0-9]+(?:\\.[0-9]+)?)', 1)::DOUBLE * {FACTOR} AS value, CASE WHEN regexp_matches(r, '(%|percent)$') THEN 'percent' WHEN regexp_matches(r, '^[$€£₹]') THEN 'currency' ELSE 'number' END AS kind FROM n""", "value")
def number_facts(spark, sf_dir):
    """Numbers in every whole text, with their kind."""
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(C.numbers(F.col("text"))).alias("n")).select("doc_id", "n.value", "n.kind")


MONTHS = "date_part('month', {0})"
WORDS = "(['jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec'])"
SENTENCES = "(['It ran on ' || strftime(o_orderdate, '%B %d, %Y') || ' and ended ' || strftime(o_orderdate + INTERVAL 3 DAY, '%Y-%m-%d') || '.', 'On ' || strftime(o_orderdate, '%d %b %Y') || ' it stopped; see 2031/02/30.', 'No day is named here.'])[(o_orderkey % 3 + 1)::INT]"


def _sentence():
    d, e = F.col("o_orderdate"), F.col("o_orderdate") + F.expr("INTERVAL 3 DAYS")
    long = F.concat(F.lit("It ran on "), F.date_format(d, "MMMM dd, yyyy"), F.lit(" and ended "), F.date_format(e, "yyyy-MM-dd"), F.lit("."))
    short = F.concat(F.lit("On "), F.date_format(d, "dd MMM yyyy"), F.lit(" it stopped; see 2031/02/30."))
    return F.get(F.array(long, short, F.lit("No day is named here.")), (F.col("o_orderkey") % 3).cast("int"))


@query("date_facts", """SELECT DISTINCT o_orderkey, d AS day FROM (SELECT o_orderkey, unnest(CASE o_orderkey % 3 WHEN 0 THEN [o_orderdate::DATE, (o_orderdate + INTERVAL 3 DAY)::DATE] WHEN 1 THEN [o_orderdate::DATE] ELSE [] END) AS d FROM orders)""")
def date_facts(spark, sf_dir):
    """Dates read back from sentences that each order's dates were written into, in three formats."""
    return table(spark, sf_dir, "orders").select("o_orderkey", F.explode(C.dates(_sentence())).alias("day"))


STOP = ", ".join(f"'{w}'" for w in C.NOT_NAMES)


@query("name_facts", f"""SELECT DISTINCT doc_id, name FROM (SELECT doc_id, lower(regexp_replace(unnest(regexp_extract_all(regexp_replace(text, '([^A-Za-z0-9_])', '\\1\\1', 'g'), '{q(C.NAME)}', 1)), '\\s+', ' ', 'g')) AS name FROM documents) WHERE length(name) >= 2 AND name NOT IN ({STOP})""")
def name_facts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(C.names(F.col("text"))).alias("name"))


CLAIMS_SQL = r"""c AS (SELECT doc_id, regexp_replace(regexp_replace(trim(regexp_replace(unnest(string_split(regexp_replace(regexp_replace(text, '([.!?])\s+', '\1' || chr(10), 'g'), ';\s*', chr(10), 'g'), chr(10))), '\s+', ' ', 'g')), '^(?:[-*•]|[0-9]+[.)])\s+', ''), '^(?:However|Therefore|Moreover|Also),?\s+', '') AS claim FROM documents), k AS (SELECT doc_id, claim FROM c WHERE length(claim) >= 12)"""


@query("claim_types", f"""WITH {CLAIMS_SQL} SELECT doc_id, CASE WHEN regexp_matches(claim, '\\[[0-9]+\\]') THEN 'CITATION' WHEN regexp_matches(claim, '{q(C.DATE)}') THEN 'DATE' WHEN regexp_matches(claim, '{q(C.NUMBER)}') THEN 'NUMERIC'
WHEN len(list_filter(list_transform(regexp_extract_all(regexp_replace(claim, '([^A-Za-z0-9_])', '\\1\\1', 'g'), '{q(C.NAME)}', 1), lambda x: lower(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: length(x) >= 2 AND x NOT IN ({STOP}))) > 0 THEN 'ENTITY'
WHEN len(regexp_split_to_array(trim(claim), '\\s+')) >= 4 THEN 'FACTUAL' ELSE 'OTHER' END AS type, count(*) AS n FROM k GROUP BY ALL""")
def claim_types(spark, sf_dir):
    """Statements of every whole text, counted by type."""
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(C.claim_texts(F.col("text"))).alias("claim")).groupBy("doc_id", C.claim_type(F.col("claim")).alias("type")).agg(F.count(F.lit(1)).alias("n"))


@query("value_verification", """WITH ev AS (SELECT l_orderkey, l_linenumber AS sentence, unnest([l_quantity, l_tax]) AS v FROM lineitem), cl AS (SELECT o_orderkey, claim, unnest(CASE claim WHEN 0 THEN [(o_orderkey % 50 + 1)::DOUBLE] ELSE [(o_orderkey % 50 + 1)::DOUBLE, 0.02::DOUBLE] END) AS v, claim + 1 AS need FROM orders, (VALUES (0), (1)) AS t(claim)),
h AS (SELECT o_orderkey, claim, sentence, count(DISTINCT cl.v) >= any_value(need) AS ok FROM cl JOIN (SELECT DISTINCT * FROM ev) e ON o_orderkey = l_orderkey AND cl.v = e.v GROUP BY ALL), g AS (SELECT o_orderkey, claim, bool_or(ok) AS ok FROM h GROUP BY ALL)
SELECT o_orderkey, t.claim, CASE WHEN coalesce(ok, false) THEN 'SUPPORTED' ELSE 'UNKNOWN' END AS status, CASE WHEN coalesce(ok, false) THEN 0.98 ELSE 0 END::DOUBLE AS confidence FROM orders CROSS JOIN (VALUES (0), (1)) AS t(claim) LEFT JOIN g USING (o_orderkey, claim)""")
def value_verification(spark, sf_dir):
    """Two claims of each order against the values of its lines."""
    o = table(spark, sf_dir, "orders")
    n = (F.col("o_orderkey") % 50 + 1).cast("double")
    claims = o.select("o_orderkey", F.posexplode(F.array(F.array(n), F.array(n, F.lit(0.02)))).alias("claim", "values"))
    evidence = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").alias("sentence"), F.array("l_quantity", "l_tax").alias("values"))
    return C.value_verdict(claims, evidence, "o_orderkey", "claim")


@query("scored_verification", """WITH s AS (SELECT l_orderkey AS claim, l_linenumber AS e, max(l_quantity) / 50 AS en, max(l_discount) * 10 AS co, max(l_tax) * 12.5 AS re FROM lineitem GROUP BY ALL),
g AS (SELECT claim, max(en) AS te, arg_max(e, (en, -e)) AS ei, max(co) FILTER (re >= 0.35) AS tc, arg_max(e, (co, -e)) FILTER (re >= 0.35) AS ci, count(*) FILTER (re >= 0.35 AND co >= 0.8) AS n, coalesce(bool_or(re >= 0.999) FILTER (re >= 0.35 AND co >= 0.8), false) AS cited, max(greatest(en, co)) AS top FROM s GROUP BY claim),
d AS (SELECT *, coalesce(tc, 0) AS c, CASE WHEN ci IS NOT NULL AND ci <> ei AND te >= 0.6 AND tc >= 0.6 THEN 'CONFLICTING' WHEN ci IS NOT NULL AND (n >= 2 OR cited) AND tc >= 0.8 AND tc - te >= 0.1 THEN 'CONTRADICTED' WHEN te >= 0.7 AND te - coalesce(tc, 0) >= 0.1 THEN 'SUPPORTED' ELSE 'UNKNOWN' END AS status FROM g)
SELECT claim, status, CASE status WHEN 'CONFLICTING' THEN greatest(te, c) WHEN 'CONTRADICTED' THEN c WHEN 'SUPPORTED' THEN te ELSE top END AS confidence FROM d""", "confidence")
def scored_verification(spark, sf_dir):
    """Orders as claims, lines as evidence whose figures stand for a model's scores."""
    s = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("claim"), F.col("l_linenumber").alias("evidence")).agg((F.max("l_quantity") / 50).alias("entailment"), (F.max("l_discount") * 10).alias("contradiction"), (F.max("l_tax") * 12.5).alias("retrieval"))
    return C.scored_verdict(s, "claim")


LABEL_SQL = "CASE o_orderstatus WHEN 'F' THEN 'SUPPORTED' WHEN 'P' THEN 'HALLUCINATED' ELSE 'MIXED' END"
REMEDY_SQL = f"""cl AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS place, (['Pump ran well', 'pump  RAN well', 'Valve is shut', 'Bolt is loose'])[(l_partkey % 4 + 1)::INT] AS text, l_returnflag = 'A' AND l_discount >= 0.03 AS good FROM lineitem),
o1 AS (SELECT k, lower(regexp_replace(text, '\\s+', ' ', 'g')) AS l, min(place) AS place, arg_min(regexp_replace(text, '\\s+', ' ', 'g'), place) AS t FROM cl WHERE good GROUP BY ALL), kp AS (SELECT k, string_agg(t, ' ' ORDER BY place) AS kept FROM o1 GROUP BY k),
rm AS (SELECT o_orderkey, CASE WHEN {LABEL_SQL} = 'SUPPORTED' THEN 'release' WHEN {LABEL_SQL} = 'HALLUCINATED' THEN 'block' WHEN o_orderpriority = '1-URGENT' THEN 'human_review' WHEN kept IS NOT NULL THEN 'corrected_release' ELSE 'safe_abstain' END AS action, kept AS all_kept FROM orders LEFT JOIN kp ON k = o_orderkey)"""


def remedies(spark, sf_dir):
    from pyspark.sql import Window

    o = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(LABEL_SQL).alias("label"), (F.col("o_orderpriority") == "1-URGENT").alias("consequential"))
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    text = F.get(F.array(*[F.lit(t) for t in ("Pump ran well", "pump  RAN well", "Valve is shut", "Bolt is loose")]), (F.col("l_partkey") % 4).cast("int"))
    c = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.row_number().over(w).alias("place"), text.alias("text"), F.when(F.col("l_returnflag") == "A", "SUPPORTED").otherwise("UNKNOWN").alias("status"), (F.col("l_discount") / 0.06).alias("confidence"))
    return C.remediated(o, c, "o_orderkey")


@query("remediation", f"WITH {REMEDY_SQL} SELECT o_orderkey, action, CASE WHEN action = 'corrected_release' THEN all_kept END AS kept FROM rm")
def remediation(spark, sf_dir):
    return remedies(spark, sf_dir)


@query("remediation_metrics", f"""WITH {REMEDY_SQL}, y AS (SELECT o_orderkey % 3 = 0 AS y, action IN ('release', 'corrected_release') AS useful, action AS a FROM rm)
SELECT count(*) AS n, count(*) FILTER (a <> 'human_review') / count(*) AS automation_rate, count(*) FILTER (useful) / count(*) AS useful_rate, count(*) FILTER (y AND a = 'release') / count(*) FILTER (y) AS unsafe_release_rate, count(*) FILTER (y AND a <> 'release') / count(*) FILTER (y) AS containment,
count(*) FILTER (NOT y AND useful) / count(*) FILTER (NOT y) AS retention, (count(*) FILTER (y AND a <> 'release') + count(*) FILTER (NOT y AND useful)) / count(*) AS safe_handling_rate FROM y""", "automation_rate useful_rate unsafe_release_rate containment retention safe_handling_rate")
def remediation_metrics(spark, sf_dir):
    return C.remediation_metrics(remedies(spark, sf_dir).withColumn("y", (F.col("o_orderkey") % 3 == 0).cast("int")), "y", "action")


BASE = {"A": 0.5, "R": 0.35}


@query("claim_priority", """WITH p AS (SELECT l_orderkey, l_linenumber AS place, l_partkey, least(1, greatest(0, CASE l_returnflag WHEN 'A' THEN 0.5 WHEN 'R' THEN 0.35 ELSE 0.3 END + 0.1 * least(l_partkey % 4, 2) + 0.2 * l_discount * 10))::DOUBLE AS priority FROM lineitem WHERE l_linestatus = 'O')
SELECT l_orderkey, place, priority, row_number() OVER (PARTITION BY l_orderkey ORDER BY round(priority, 9) DESC, place) AS rank FROM (SELECT l_orderkey, place, min(priority) AS priority FROM p GROUP BY ALL) QUALIFY rank <= 2""", "priority")
def claim_priority(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").where("l_linestatus = 'O'").withColumn("p", F.expr("CASE l_returnflag WHEN 'A' THEN 0.5 WHEN 'R' THEN 0.35 ELSE 0.3 END + 0.1 * least(l_partkey % 4, 2) + 2 * l_discount"))
    one = li.groupBy("l_orderkey", F.col("l_linenumber").alias("place")).agg(F.min_by(F.struct(F.col("l_returnflag").alias("type"), (F.col("l_partkey") % 4).alias("n_values"), (F.col("l_discount") * 10).alias("risk")), F.least("p", F.lit(1.0))).alias("_s"))
    return C.claim_priority(one.select("l_orderkey", "place", "_s.*", F.lit("UNKNOWN").alias("status")), "l_orderkey", 2, BASE).select("l_orderkey", "place", "priority", "rank")


GENERIC = ("the", "and", "that", "with", "for", "was", "are")
TERMS_SQL = "list_distinct(list_transform(list_filter(regexp_extract_all(lower({0}), '[a-z0-9]+'), lambda t: length(t) > 2 AND t NOT IN ('the', 'and', 'that', 'with', 'for', 'was', 'are')), lambda t: CASE WHEN length(t) > 4 AND t[-1] = 's' THEN t[:-2] ELSE t END))"


@query("claims_for_query", f"""WITH b AS (SELECT item_id, {TERMS_SQL.format('text')} AS t FROM benchmark), bt AS (SELECT item_id, len(t) AS n, unnest(t) AS term FROM b), p AS (SELECT p_partkey, unnest({TERMS_SQL.format("p_name || ' ' || p_type || ' thed shes ines'")}) AS term FROM part)
SELECT item_id, p_partkey, count(*) / any_value(n) AS score FROM p JOIN bt USING (term) GROUP BY ALL""", "score")
def claims_for_query(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_type", F.lit("thed shes ines")).alias("text"))
    return C.claims_for_query(parts, table(spark, sf_dir, "benchmark"), GENERIC, "p_partkey", "item_id").select("item_id", "p_partkey", "score")


@query("evidence_merge", """WITH s AS (SELECT p_brand, p_partkey, lower(trim(p_name)) AS t, CASE WHEN p_size % 5 = 0 THEN 0 ELSE 1 END AS f FROM part), o AS (SELECT p_brand, t, min((f, p_partkey)) AS o FROM s GROUP BY ALL)
SELECT p_brand, o[2] AS p_partkey, o[1] = 0 AS seed, row_number() OVER (PARTITION BY p_brand ORDER BY o) AS place FROM o QUALIFY place <= 8""".replace("min((f, p_partkey))", "min({'f': f, 'k': p_partkey})").replace("o[2]", "o.k").replace("o[1]", "o.f"))
def evidence_merge(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_name", "p_size")
    return C.merged_evidence(p.where("p_size % 5 = 0").drop("p_size"), p.where("p_size % 5 <> 0").drop("p_size"), "p_brand", "p_name", "p_partkey", 8).select("p_brand", "p_partkey", "seed", "place")


FACTS_SQL = """st AS (SELECT l_orderkey AS doc, l_linenumber, l_suppkey, l_partkey, 'P-' || l_partkey % 300 || ' ' || (['oil pressure', 'flow'])[(l_partkey % 2 + 1)::INT] || ' normal range is ' || (l_partkey % 300 % 7 + CASE WHEN l_orderkey % 97 = 0 THEN 1 ELSE 0 END) || ' to ' || (l_partkey % 300 % 7 + 5) || ' bar' || CASE WHEN l_linenumber % 3 = 0 THEN ' always' ELSE '' END || '.' AS text FROM lineitem),
fa AS (SELECT *, 'p-' || l_partkey % 300 AS asset, (['oil pressure', 'flow'])[(l_partkey % 2 + 1)::INT] AS metric, (l_partkey % 300 % 7 + CASE WHEN doc % 97 = 0 THEN 1 ELSE 0 END)::DOUBLE AS low, (l_partkey % 300 % 7 + 5)::DOUBLE AS high, 'bar' AS unit FROM st WHERE l_linenumber % 3 <> 0)"""


def statements(spark, sf_dir):
    """Sentences that each line states a range with; a third say more than the grammar takes."""
    base = F.expr("l_partkey % 300 % 7")
    low = (base + F.when(F.col("l_orderkey") % 97 == 0, 1).otherwise(0)).cast("string")
    text = F.concat(F.lit("P-"), (F.col("l_partkey") % 300).cast("string"), F.lit(" "), F.get(F.array(F.lit("oil pressure"), F.lit("flow")), (F.col("l_partkey") % 2).cast("int")), F.lit(" normal range is "), low, F.lit(" to "), (base + 5).cast("string"), F.lit(" bar"), F.when(F.col("l_linenumber") % 3 == 0, " always").otherwise(""), F.lit("."))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), "l_linenumber", "l_quantity", text.alias("text"))


@query("range_facts", f"WITH {FACTS_SQL} SELECT doc, asset, metric, low, high, unit FROM fa")
def range_facts(spark, sf_dir):
    return C.range_facts(statements(spark, sf_dir), "doc", "text")


@query("cited_ranges", f"""WITH {FACTS_SQL}, n AS (SELECT asset, metric, unit, count(DISTINCT (low, high)) AS n FROM fa GROUP BY ALL), c AS (SELECT doc, l_linenumber, l_partkey, l_suppkey, asset, metric, unit, low + CASE WHEN l_linenumber = 1 THEN 1 ELSE 0 END AS low, high FROM fa)
SELECT doc AS claim, CASE WHEN n > 1 THEN 'CONFLICTING' ELSE 'SUPPORTED' END AS status, count(*) AS n_claims FROM (SELECT c.* FROM c SEMI JOIN fa ON c.doc = fa.doc AND c.asset = fa.asset AND c.metric = fa.metric AND c.low = fa.low AND c.high = fa.high) JOIN n USING (asset, metric, unit) GROUP BY ALL""")
def cited_ranges(spark, sf_dir):
    """Each statement as a claim that cites its own document, the first line's with another lower bound."""
    st = statements(spark, sf_dir)
    facts = C.range_facts(st, "doc", "text")
    lines = C.range_facts(st.withColumn("k", F.struct("doc", "l_linenumber")), "k", "text").select("k.*", "asset", "metric", "low", "high", "unit")
    claims = lines.withColumn("low", F.col("low") + F.when(F.col("l_linenumber") == 1, 1).otherwise(0)).withColumn("claim", F.col("doc"))
    return C.cited_ranges(claims, facts, "claim").groupBy("claim", "status").agg(F.count(F.lit(1)).alias("n_claims"))


@query("range_support", f"""WITH {FACTS_SQL}, o AS (SELECT asset, metric, unit, min(low) AS low, min(high) AS high, count(DISTINCT doc) AS docs, min(doc) AS d FROM fa GROUP BY ALL HAVING count(DISTINCT (low, high)) = 1)
SELECT p_partkey AS obs, p_size / 5.0 BETWEEN low AND high AS inside FROM part JOIN o ON asset = 'p-' || p_partkey % 300 AND metric = (['oil pressure', 'flow'])[(p_partkey % 2 + 1)::INT] WHERE docs > 1 OR d <> p_partkey""")
def range_support(spark, sf_dir):
    """Parts' sizes as observations against the ranges that the lines' documents state."""
    obs = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("obs"), F.col("p_partkey").alias("doc"), F.concat(F.lit("p-"), (F.col("p_partkey") % 300).cast("string")).alias("asset"), F.get(F.array(F.lit("oil pressure"), F.lit("flow")), (F.col("p_partkey") % 2).cast("int")).alias("metric"), F.lit("bar").alias("unit"), (F.col("p_size") / 5.0).alias("value"))
    return C.range_support(obs, C.range_facts(statements(spark, sf_dir), "doc", "text"))


READINGS = {"vibration": "(?i)vibration (?:was|of) ([0-9.]+) mm/s", "temperature": "(?i)temperature (?:was|of) ([0-9.]+)", "pressure": "(?i)pressure (?:was|of) ([0-9.]+) bar"}


@query("reading_extract", """SELECT l_orderkey, l_linenumber, l_partkey, metric, value FROM (SELECT l_orderkey, l_linenumber, l_partkey, unnest([{'metric': 'vibration', 'value': l_quantity}, {'metric': 'pressure', 'value': l_tax}, {'metric': 'temperature', 'value': CASE WHEN l_linenumber % 2 = 0 THEN l_discount END}], recursive := true) FROM lineitem) WHERE value IS NOT NULL""", "value")
def reading_extract(spark, sf_dir):
    """Readings taken from reports that each line's figures were written into."""
    say = F.concat(F.lit("Vibration was "), F.col("l_quantity").cast("string"), F.lit(" mm/s, PRESSURE of "), F.format_string("%.2f", "l_tax"), F.lit(" bar"), F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit(" and temperature of "), F.format_string("%.2f", "l_discount"), F.lit(" C"))).otherwise("."))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.explode(C.readings(say, READINGS)).alias("r")).select("l_orderkey", "l_linenumber", "l_partkey", "r.metric", "r.value")


ROUTES = {"numeric": "[0-9]{2,}", "question": "\\b(?:que|qui|what|was|wie)\\b|\\?", "long": "^.{600}"}


@query("text_routes", r"""SELECT conv_id, turn, CASE WHEN regexp_matches(lower(text), '[0-9]{2,}') THEN 'numeric' WHEN regexp_matches(lower(text), '\b(?:que|qui|what|was|wie)\b|\?') THEN 'question' WHEN regexp_matches(lower(text), '^.{600}') THEN 'long' ELSE 'chat' END AS route FROM conversations""".replace(r"\b(?:que|qui|what|was|wie)\b|\?", r"(?:^| )(?:que|qui|what|was|wie) |\?"))
def text_routes(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", C.routed(F.col("text"), ROUTES | {"question": "(?:^| )(?:que|qui|what|was|wie) |\\?"}, "chat").alias("route"))


@query("relevant_sentences", r"""WITH s AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(10), 'g'), chr(10))) AS s, generate_subscripts(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(10), 'g'), chr(10)), 1) AS i FROM documents),
k AS (SELECT *, len(list_intersect(list_distinct(regexp_extract_all(lower(s), '[a-z0-9]+')), ['the', 'of', 'der', 'die', 'que', 'la'])) AS a FROM s),
c AS (SELECT * FROM k WHERE a > 0 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY -a, NOT regexp_matches(s, '[0-9]'), i) <= 2)
SELECT d.doc_id, md5(coalesce(t, '')) AS digest FROM documents d LEFT JOIN (SELECT doc_id, string_agg(s, ' ' ORDER BY i) AS t FROM c GROUP BY doc_id) x USING (doc_id) WHERE d.text IS NOT NULL""")
def relevant_sentences(spark, sf_dir):
    """The two sentences of each text that share most with six stated terms."""
    terms = F.array(*[F.lit(t) for t in ("the", "of", "der", "die", "que", "la")])
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    return docs.select("doc_id", F.md5(F.array_join(C.best_sentences(F.col("text"), terms, 2), " ").cast("binary")).alias("digest"))


@query("retry_policy", """WITH v AS (SELECT l_orderkey, count(*) AS total, count(*) FILTER (l_returnflag = 'A') AS supported, count(*) FILTER (l_returnflag = 'R') AS contradicted, count(*) FILTER (l_returnflag = 'N' AND l_tax > 0.06) AS insufficient, avg(l_discount) * 8 AS score FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, l_orderkey % 4 < 2 AND (supported = 0 OR supported / total < 0.6 OR insufficient > 0 OR contradicted > 0) AS retry, supported = 0 OR contradicted > supported OR round(score, 9) < 0.4 AS abstain FROM v""")
def retry_policy(spark, sf_dir):
    n = lambda c: F.count_if(F.expr(c))
    v = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("total"), n("l_returnflag = 'A'").alias("supported"), n("l_returnflag = 'R'").alias("contradicted"), n("l_returnflag = 'N' AND l_tax > 0.06").alias("insufficient"), F.round(F.avg("l_discount") * 8, 9).alias("score"))
    return C.retry_policy(v, F.col("l_orderkey") % 4).select("l_orderkey", "retry", "abstain")


@query("evidence_selection", """WITH e AS (SELECT l_suppkey % 50 AS k, p_partkey, p_size % 9 = 0 AS cited, p_size % 4 = 0 AS superseded, p_retailprice AS score, len(list_intersect(list_distinct(regexp_extract_all(lower(p_name), '[a-z0-9]+')), ['red', 'bolt', 'small'])) AS n FROM part JOIN (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) ON l_partkey = p_partkey),
d AS (SELECT DISTINCT * FROM e WHERE NOT superseded AND (cited OR coalesce(n, 0) >= 1)) SELECT k, p_partkey, row_number() OVER (PARTITION BY k ORDER BY cited DESC, n DESC, round(score, 9) DESC, p_partkey) AS place, greatest(count(*) OVER (PARTITION BY k) - 5, 0) AS omitted FROM d QUALIFY place <= 5""")
def evidence_selection(spark, sf_dir):
    """Parts as evidence for groups of suppliers."""
    links = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 50).alias("k"), F.col("l_partkey").alias("p_partkey")).distinct()
    e = links.join(table(spark, sf_dir, "part"), "p_partkey").select("k", "p_partkey", "p_name", (F.col("p_size") % 9 == 0).alias("cited"), (F.col("p_size") % 4 == 0).alias("superseded"), F.col("p_retailprice").alias("score"))
    return C.selected_evidence(e, "k", "p_partkey", F.array(F.lit("red"), F.lit("bolt"), F.lit("small")), F.col("p_name"), 5)


@query("evidence_quality", """WITH r AS (SELECT l_orderkey, l_suppkey % 4 AS source, l_linestatus = 'O' AS current, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_partkey, l_suppkey, l_linenumber) AS place FROM lineitem), g AS (SELECT l_orderkey, count(*) AS rows, count(DISTINCT source) AS sources, count(*) FILTER (current) AS current FROM r WHERE place <= 4 GROUP BY l_orderkey)
SELECT *, CASE WHEN current = 0 THEN 'NONE' WHEN sources >= 3 THEN 'STRONG' WHEN sources = 1 THEN 'WEAK' ELSE 'MIXED' END AS quality FROM g""")
def evidence_quality(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy(F.desc("l_quantity"), "l_partkey", "l_suppkey", "l_linenumber")
    r = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_suppkey") % 4).alias("source"), (F.col("l_linestatus") == "O").alias("current"), F.row_number().over(w).alias("place"))
    return C.evidence_quality(r, "l_orderkey")


@query("shape_features", f"""WITH d AS (SELECT *, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM documents) SELECT doc_id, {', '.join(f"len(regexp_extract_all(text, '{q(p)}'))::INT AS n_{k}" for k, p in C.SHAPES.items())}, len(w)::INT AS n_words, CASE WHEN len(w) > 0 THEN list_sum(list_transform(w, lambda x: length(x))) / len(w) WHEN w IS NOT NULL THEN 0 END::DOUBLE AS mean_word FROM d""", "mean_word")
def shape_features(spark, sf_dir):
    """Eighteen features of every whole text."""
    return table(spark, sf_dir, "documents").select("doc_id", *[c.alias(n) for n, c in C.shape_features(F.col("text")).items()])


@query("measured_ranges", f"WITH {FACTS_SQL} SELECT doc, (l_partkey % 300 % 7 + CASE WHEN doc % 97 = 0 THEN 1 ELSE 0 END)::DOUBLE AS low, (l_partkey % 300 % 7 + 5)::DOUBLE AS high, 'bar' AS unit FROM st")
def measured_ranges(spark, sf_dir):
    """Ranges with units in all statements, whatever else these say."""
    return statements(spark, sf_dir).select("doc", F.explode(C.measured_ranges(F.col("text"))).alias("r")).select("doc", "r.low", "r.high", "r.unit")
