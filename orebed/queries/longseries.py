"""Kernels over the five series of all events of a type, each dealt over tasks; tests/test_longseries.py compares those without SQL with whole-series kernels."""

from __future__ import annotations

from pyspark.sql import functions as F

from orebed.operators import longseries as L
from orebed.queries.base import query, table
from orebed.queries.streams import cusum_sql

#: Rows of a block here: small, so that the test tables' series have some.
BLOCK = 4096
KEY = ["event_type"]


def typed(spark, sf_dir, *columns):
    """Events in their type's order, with z against the type's moments."""
    ev = table(spark, sf_dir, "events")
    rows = L.placed(ev, KEY, ["ts", "event_id"], ["event_id", "value", *columns])
    stats = ev.groupBy(*KEY).agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    return rows.join(F.broadcast(stats), KEY).withColumn("z", F.coalesce((F.col("value") - F.col("m")) / F.greatest("s", F.lit(1e-12)), F.lit(0.0))).drop("m", "s")  # a row for each of five types


TYPED_SQL = """te AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS i, coalesce((value - avg(value) OVER (PARTITION BY event_type)) / greatest(stddev_pop(value) OVER (PARTITION BY event_type), 1e-12), 0)::DOUBLE AS z FROM events)"""


@query("bounded_criticality", f"""WITH RECURSIVE {TYPED_SQL}, c AS (SELECT DISTINCT event_type, -1::BIGINT AS i, NULL::BIGINT AS event_id, 0::BIGINT AS x FROM te
UNION ALL SELECT te.event_type, te.i, te.event_id, greatest(0, least(20, c.x + CASE WHEN te.user_id % 10 = 0 THEN 0 WHEN abs(te.z) >= 1 THEN 1 ELSE -1 END)) FROM c JOIN te ON te.event_type = c.event_type AND te.i = c.i + 1)
SELECT event_id, x AS criticality FROM c WHERE i >= 0""")
def bounded_criticality(spark, sf_dir):
    """Counter of alarms within 0 .. 20, held on the rows of every tenth user (not normal)."""
    rows = typed(spark, sf_dir, "user_id")
    return L.saturating_counter(rows, KEY, F.abs("z") >= 1, F.col("user_id") % 10 != 0, maximum=20, size=BLOCK).select("event_id", "criticality")


@query("long_cusum", f"""WITH RECURSIVE {TYPED_SQL}, zz AS (SELECT event_type, i, z FROM te), {cusum_sql("zz", "event_type", 0.5, 5.0)}
SELECT event_type, i AS t_idx, pos, neg, alarm FROM r WHERE i >= 0""", "pos neg", digits=4)
def long_cusum(spark, sf_dir):
    return L.cusum(typed(spark, sf_dir), KEY, "z", size=BLOCK)


@query("long_change_points")
def long_change_points(spark, sf_dir):
    return L.change_points(typed(spark, sf_dir), KEY, 12, 2.0, block=BLOCK)


@query("long_wavelet")
def long_wavelet(spark, sf_dir):
    return L.wavelet_denoised(typed(spark, sf_dir), KEY, 3, size=BLOCK)


@query("long_band")
def long_band(spark, sf_dir):
    """Band and envelope of each type's values, a sample for each event."""
    return L.banded(typed(spark, sf_dir), KEY, 1.0, 0.05, 0.25, size=BLOCK)


@query("long_canonical_variates")
def long_canonical_variates(spark, sf_dir):
    """Values and the logarithm of the seconds between events as two channels."""
    rows = typed(spark, sf_dir, "ts")
    gap = rows.select("event_type", (F.col("t_idx") + 1).alias("t_idx"), F.col("ts").alias("before"))
    both = rows.join(gap, ["event_type", "t_idx"], "left").withColumn("wait", F.log1p(F.col("ts").cast("timestamp").cast("double") - F.col("before").cast("timestamp").cast("double")))
    return L.cva_monitoring(both, KEY, ["value", "wait"], 3, 3, size=BLOCK)


@query("series_status", """SELECT user_id, count(*) AS n, count(*) - count(value) AS missing, CASE WHEN count(*) < 16 THEN 'too_short' WHEN min(value) IS NULL THEN 'no_values' WHEN min(value) = max(value) THEN 'constant' ELSE 'ok' END AS status FROM events GROUP BY user_id""")
def series_status(spark, sf_dir):
    """Which users' series the kernels take, and why others not."""
    return L.series_status(table(spark, sf_dir, "events"), ["user_id"], 16)
