"""Ranges that claims cite from the line items of their order, and unit conversion of prices."""

from __future__ import annotations

from pyspark.sql import functions as F

from orebed.operators import ranges as R
from orebed.queries.base import query, table

PICK = "CASE l_linenumber WHEN 1 THEN ' KPA ' WHEN 2 THEN 'mm/s  r.m.s.' WHEN 3 THEN '°C' WHEN 4 THEN 'rpm' WHEN 5 THEN 'psi' WHEN 6 THEN 'kW' END"
INTO = "CASE l_returnflag WHEN 'A' THEN 'bar' WHEN 'N' THEN 'MM/S' ELSE CASE WHEN l_linenumber = 4 THEN 'Hz' WHEN l_linenumber = 3 THEN 'kelvin' ELSE 'watt' END END"


@query("unit_conversion", f"""WITH t(name, shown, dim, f, s) AS (VALUES ('kpa', 'kPa', 'pressure', 1000::DOUBLE, 0::DOUBLE), ('mm/s rms', 'mm/s', 'velocity', 0.001, 0), ('°c', '°C', 'temperature', 1, 273.15), ('rpm', 'rpm', 'frequency', 1::DOUBLE / 60, 0), ('kw', 'kW', 'power', 1000, 0), ('bar', 'bar', 'pressure', 100000, 0), ('mm/s', 'mm/s', 'velocity', 0.001, 0), ('hz', 'Hz', 'frequency', 1, 0), ('kelvin', 'K', 'temperature', 1, 0), ('watt', 'W', 'power', 1, 0)),
l AS (SELECT *, {PICK} AS u, {INTO} AS w, least(greatest(length(split_part(l_extendedprice::DOUBLE::VARCHAR, '.', 2)) + 2, 1), 6)::INT AS places FROM lineitem),
j AS (SELECT l.*, a.dim, a.f, a.s, b.shown, b.dim AS dim2, b.f AS f2, b.s AS s2 FROM l LEFT JOIN t a ON a.name = replace(regexp_replace(trim(lower(u)), '\\s+', ' ', 'g'), 'r.m.s.', 'rms') LEFT JOIN t b ON b.name = lower(w))
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN dim = dim2 THEN round((l_extendedprice * f + s - s2) / f2, places) END AS converted, CASE WHEN dim = dim2 THEN shown END AS shown_unit, dim AS dimension, CASE WHEN dim IS NULL THEN 'UNIT_AMBIGUOUS' WHEN dim <> dim2 THEN 'INCOMPATIBLE_UNITS' ELSE 'OK' END AS unit_status FROM j""", "converted")
def unit_conversion(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumn("unit", F.expr(PICK)).withColumn("into", F.expr(INTO))
    return R.convert_units(li, "l_extendedprice", "unit", "into").select("l_orderkey", "l_linenumber", "l_partkey", "converted", "shown_unit", "dimension", "unit_status")


@query("proved_ranges", """WITH l AS (SELECT l_orderkey, l_linenumber || '-' || l_partkey || '-' || l_suppkey AS id, l_partkey % 4 AS form, l_suppkey % 2 AS asset, l_quantity::INT % 2 AS low, l_linenumber % 5 <> 0 AND l_tax < 0.08 AND NOT (l_returnflag = 'R' AND l_linenumber % 2 = 0) AS ok, l_linenumber % 4 = 1 AS wrong FROM lineitem),
f AS (SELECT *, CASE form WHEN 1 THEN 'vibration' WHEN 3 THEN 'temperature' ELSE 'pressure' END AS metric FROM l), s AS (SELECT * FROM f WHERE ok AND form <> 2),
c AS (SELECT f.*, low + wrong::INT AS said FROM f JOIN orders ON o_orderkey = l_orderkey WHERE form <> 2 AND (o_orderkey % 3 > 0 OR o_custkey % 2 = asset)),
p AS (SELECT * FROM c WHERE (l_orderkey, id, asset, metric, said) IN (SELECT (l_orderkey, id, asset, metric, low) FROM s) AND (l_orderkey, asset, metric) NOT IN (SELECT (l_orderkey, asset, metric) FROM f WHERE ok AND form = 2)),
n AS (SELECT l_orderkey, asset, metric, count(*) AS total, count(*) FILTER (low = 0) AS zeros FROM s GROUP BY ALL)
SELECT l_orderkey, id AS claim, 'E:' || id AS evidence_id, CASE WHEN total > CASE said WHEN 0 THEN zeros ELSE total - zeros END THEN 'CONFLICTING' ELSE 'SUPPORTED' END AS status, total - CASE said WHEN 0 THEN zeros ELSE total - zeros END + 1 AS n_sources FROM p JOIN n USING (l_orderkey, asset, metric)""")
def proved_ranges(spark, sf_dir):
    """Each line item as a document of its order, and as a claim that cites it; every fourth claim misquotes its lower bound."""
    c, say = F.col, F.concat
    ident = F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey")
    asset, low = say(F.lit("Pump-"), (c("l_suppkey") % 2).cast("string")), c("l_quantity").cast("int") % 2
    high, form = F.lit("7"), c("l_partkey") % 4
    stated = lambda low: F.when(form == 1, say(asset, F.lit(" normal vibration was "), low, F.lit("-"), high, F.lit(" mm/s RMS"))).when(form == 3, say(asset, F.lit(" current normal temperature is "), low, F.lit(" – "), high, F.lit(" °C"))).otherwise(say(asset, F.lit(" normal pressure is "), low, F.lit(" to "), high, F.lit(" bar")))
    own = low.cast("string")
    text = F.when(form == 1, say(F.lit("Look at "), asset, F.lit(" first. Normal vibration was "), own, F.lit("-"), high, F.lit(" mm/s RMS."))).when(form == 2, say(asset, F.lit(" pressure must not leave "), own, F.lit(" to "), high, F.lit(" bar."))).otherwise(say(stated(own), F.lit(".")))
    li = table(spark, sf_dir, "lineitem")
    evidence = li.select("l_orderkey", say(F.lit("E:"), ident).alias("evidence_id"), text.alias("text"), F.when(c("l_linenumber") % 5 == 0, "superseded").otherwise("Current").alias("status"), F.when(c("l_tax") >= 0.08, "UNTRUSTED").alias("trust"), F.when((c("l_returnflag") == "R") & (c("l_linenumber") % 2 == 0), "note").otherwise("SOP").alias("kind"))
    claim = say(stated((low + (c("l_linenumber") % 4 == 1).cast("int")).cast("string")), F.lit(" [E:"), ident, F.lit("]."))
    prompt = table(spark, sf_dir, "orders").select(c("o_orderkey").alias("l_orderkey"), F.when(c("o_orderkey") % 3 == 0, say(F.lit("How is pump-"), (c("o_custkey") % 2).cast("string"), F.lit("?"))).alias("prompt"))
    claims = li.where(form != 2).select("l_orderkey", ident.alias("claim"), claim.alias("text")).join(prompt, "l_orderkey")
    return R.proved_ranges(claims, evidence, "l_orderkey")
