"""Orders' claims of pressure ranges, and the line items that they have to be held against."""

from __future__ import annotations

from pyspark.sql import functions as F

from orebed.operators import grounding as G
from orebed.queries.base import query, table

CLAIM = "'Pump-' || o_orderkey % 3 || CASE o_orderkey % 4 WHEN 0 THEN ' normal discharge pressure is 3.2 to 4.1 bar [doc-1].' WHEN 1 THEN ' normal discharge pressure is 3.2 to 4.1 bar and operation is safe [doc-2].' WHEN 2 THEN ': historical discharge pressure (bar)' ELSE ' torque [doc-9]' END"
ITEM = "'Pump-' || (l_orderkey + l_linenumber % 2) % 3 || CASE l_partkey % 5 WHEN 0 THEN ' normal discharge pressure is ' || l_suppkey % 7 || '.5 to 60 bar.' WHEN 1 THEN ' discharge pressure was ' || l_suppkey % 7 || ' bar.' WHEN 2 THEN ' normal temperature is 70 to 80 C.' WHEN 3 THEN ' normal discharge pressure is not ' || l_suppkey % 7 || ' to 60 rpm. It was 5 bar.' ELSE ' torque and discharge pressure: normal.' END"
STATUS = "CASE l_returnflag WHEN 'A' THEN 'current' WHEN 'R' THEN 'Superseded' WHEN 'N' THEN CASE WHEN l_linestatus = 'O' THEN 'draft' END END"
PLACED = "l_partkey * 100000 + l_suppkey * 10 + l_linenumber"


@query("claim_evidence", f"""WITH c AS (SELECT o_orderkey AS k, o_orderkey % 4 AS kind, {CLAIM} AS t FROM orders), e AS (SELECT l_orderkey AS k, {PLACED} AS item, l_partkey % 5 AS kind, 'doc-' || l_suppkey % 5 AS doc, {ITEM} AS t, coalesce(max(lower({STATUS})), '') AS status, max(l_discount) AS own FROM lineitem GROUP BY ALL),
w AS (SELECT c.k, item, e.kind AS ek, c.kind AS ck, e.t, own, status, contains(c.t, '[' || doc || ']') AS cited, list_filter(list_distinct(list_transform(regexp_split_to_array(regexp_replace(lower(c.t), '\\[[a-z0-9-]+\\]', '', 'g'), '\\s+'), lambda x: trim(x, '.,:;()[]'))), lambda x: length(x) >= 3 AND x NOT IN ('and', 'was')) AS ct, list_filter(list_distinct(list_transform(regexp_split_to_array(lower(e.t), '\\s+'), lambda x: trim(x, '.,:;()[]'))), lambda x: length(x) >= 3 AND x NOT IN ('and', 'was')) AS et FROM c JOIN e USING (k)),
s AS (SELECT *, len(list_intersect(ct, et)) AS shared FROM w), g AS (SELECT *, shared / len(ct) AS share FROM s WHERE cited OR (shared >= CASE WHEN len(ct) <= 2 THEN 1 ELSE 2 END AND shared / len(ct) >= 0.05 AND (status <> 'superseded' OR ck = 2) AND (ck <> 0 OR (status <> 'draft' AND ek IN (0, 3, 4))))),
p AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY cited DESC, share DESC, own DESC, item) AS place FROM g), o AS (SELECT k, count(*) FILTER (first > 2) AS omitted FROM (SELECT k, t, min(place) AS first FROM p GROUP BY ALL) GROUP BY k)
SELECT k, k AS claim, place, item, cited, CASE WHEN cited THEN 1 ELSE least(0.99::DOUBLE, share) END::DOUBLE AS score, omitted FROM p JOIN o USING (k) WHERE place <= 2""", "score")
def claim_evidence(spark, sf_dir):
    """The two items that each order's claim has to be held against, and how many other texts are left."""
    claims = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderkey").alias("claim"), F.expr(CLAIM).alias("text"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.expr(PLACED).alias("item"), F.expr("'doc-' || l_suppkey % 5").alias("document"), F.expr(ITEM).alias("text"), F.expr(STATUS).alias("status"), "l_discount")
    items = lines.groupBy("k", "item", "document", "text").agg(F.max(F.lower("status")).alias("status"), F.max("l_discount").alias("score"))  # ids tell items apart
    return G.claim_evidence(claims, items, "k", top=2)
