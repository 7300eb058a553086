"""Contracts over payloads that are made of orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from orebed.operators import payloads as P
from orebed.queries.base import query, table


@query("contract_violations", """WITH o AS (SELECT o_orderkey, o_custkey AS c, o_orderkey % 3 AS kind FROM orders),
v AS (SELECT o_orderkey, unnest(CASE kind
WHEN 0 THEN [CASE WHEN 250 + c % 12 < 256 THEN 'too_short' END, CASE WHEN c % 2 = 1 THEN 'nyquist' END, CASE WHEN c % 105 > 100 THEN 'load' END, CASE WHEN c % 3 > 0 THEN 'specimen' END]
WHEN 1 THEN [CASE WHEN c % 4 = 0 THEN 'limit' END, CASE WHEN c % 5 = 0 THEN 'unit' END, CASE WHEN c % 7 = 0 THEN 'missing:battery_id' WHEN c % 3 > 0 THEN 'specimen' END, CASE WHEN c % 11 = 0 THEN 'order' END]
ELSE [CASE WHEN 30 + c % 5 < 32 THEN 'too_short' END, CASE WHEN c % 3 = 0 THEN 'nyquist' END, CASE WHEN c % 13 = 0 THEN 'times' END, CASE WHEN c % 13 = 0 THEN 'interval' END, CASE WHEN c % 6 = 0 THEN 'unknown:note' END] END) AS violation FROM o)
SELECT o_orderkey, violation FROM v WHERE violation IS NOT NULL""")
def contract_violations(spark, sf_dir):
    """Payloads of three workflows for all orders, some with faults."""
    c, key = F.col("o_custkey"), F.col("o_orderkey")
    row = lambda n, f: F.transform(F.sequence(F.lit(0).cast("long"), n - 1), f)
    t = lambda d: F.date_format(F.lit("2026-01-01").cast("timestamp") + F.make_dt_interval(secs=d), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    end = F.when((key % 3 == 2) & (c % 13 == 0), F.lit(0.0)).otherwise(100.0)
    meta = F.struct(*[F.lit(v).alias(n) for n, v in (("asset_id", "a"), ("specimen_id", "s0"), ("dataset_id", "d"), ("dataset_revision", "1"))], t(F.lit(0.0)).alias("observation_timestamp_utc"), t(end).alias("acquisition_end_utc"), F.lit("synthetic").alias("provenance"), F.lit("lab").alias("operating_context"))
    named = F.concat(F.lit("s"), (c % 3).cast("string"))
    bearing = F.struct(
        row(250 + c % 12, lambda i: (i + key) % 7 / 10.0).alias("signal"), F.when(c % 2 == 1, 200.0).otherwise(8000.0).alias("sampling_rate_hz"), F.lit("g").alias("signal_unit"), F.lit("x").alias("channel_name"), F.lit("end").alias("sensor_location"), named.alias("bearing_id"),
        F.lit(1800.0).alias("shaft_speed_rpm"), (c % 105).cast("double").alias("load_percent"), F.struct(F.lit(100.0).alias("BPFO"), F.lit(150.0).alias("BPFI"), F.lit(70.0).alias("BSF"), F.lit(10.0).alias("FTF")).alias("fault_frequencies"),
    )
    cycles = row(F.lit(32), lambda i: F.when((i == 9) & (c % 11 == 0), F.lit(0)).otherwise(i))
    battery = F.struct(cycles.alias("cycle_index"), row(F.lit(32), lambda i: 2 - i / 100.0).alias("capacity_ah"), F.lit(2.0).alias("nominal_capacity_ah"), F.when(c % 4 == 0, 2.0).otherwise(1.4).alias("eol_capacity_ah"), F.when(c % 5 == 0, "mAh").otherwise("Ah").alias("capacity_unit"), F.when(c % 7 > 0, named).alias("battery_id"))
    transformer = F.struct(row(30 + c % 5, lambda i: F.array(i.cast("double"), (i + 1).cast("double"))).alias("signal_matrix"), F.lit(1000.0).alias("sampling_rate_hz"), F.array(F.lit("Ia"), F.lit("Ib")).alias("sensor_positions"), F.array(F.lit("A"), F.lit("A")).alias("channel_units"), F.when(c % 3 == 0, 600.0).otherwise(50.0).alias("fundamental_hz"), F.when(c % 6 == 0, "x").alias("note"))

    def payload(name: str, inputs: F.Column) -> F.Column:
        domain, task, policy, *_ = P.WORKFLOWS[name]
        return F.to_json(F.struct(F.lit(domain).alias("domain"), F.lit(task).alias("task"), F.lit(policy).alias("policy_ref"), inputs.alias("inputs"), F.struct(meta.alias("metadata")).alias("run_context")))

    made = F.when(key % 3 == 0, payload("bearing", bearing)).when(key % 3 == 1, payload("battery_prognosis", battery)).otherwise(payload("transformer", transformer))
    return P.contract_violations(table(spark, sf_dir, "orders").select("o_orderkey", made.alias("payload")), ["o_orderkey"], "payload")
