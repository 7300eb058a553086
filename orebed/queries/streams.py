"""Streaming queries over events, drained for all rows that are there."""

from __future__ import annotations

from pyspark.sql import functions as F

from orebed.queries.base import query, table
from orebed.streaming import online as O


@query("stream_windowed_counts", "SELECT date_trunc('day', ts) AS \"start\", event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_windowed_counts(spark, sf_dir):
    return O.drained(O.windowed_counts(O.replay(spark, sf_dir, "events"), "ts", ["event_type"], "1 day", "1 hour"), "complete")


@query("stream_threshold_alerts", "SELECT event_id, user_id, value > mean * 1.5 AS alert FROM events JOIN (SELECT event_type, avg(value) AS mean FROM events GROUP BY 1) USING (event_type)")
def stream_threshold_alerts(spark, sf_dir):
    means = table(spark, sf_dir, "events").groupBy("event_type").agg(F.avg("value").alias("mean"))
    return O.drained(O.enriched(O.replay(spark, sf_dir, "events"), means, "event_type", lambda d: d.select("event_id", "user_id", (F.col("value") > F.col("mean") * 1.5).alias("alert"))))


def cusum_sql(z: str, key: str, drift: float, threshold: float) -> str:
    """r: one-sided sums over z (key, i, z) that start again after an alarm, by recursion."""
    pos, neg = (f"greatest(0, CASE WHEN r.alarm THEN 0 ELSE r.{c} END {s} z.z - {drift})" for c, s in (("pos", "+"), ("neg", "-")))
    return f"""r AS (SELECT DISTINCT {key}, -1::BIGINT AS i, 0.0::DOUBLE AS pos, 0.0::DOUBLE AS neg, false AS alarm FROM {z}
UNION ALL SELECT z.{key}, z.i, {pos}, {neg}, {pos} > {threshold} OR {neg} > {threshold} FROM r JOIN {z} z ON z.{key} = r.{key} AND z.i = r.i + 1)"""


@query("stream_online_cusum", f"""WITH RECURSIVE zz AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, coalesce((value - 50) / 25, 0)::DOUBLE AS z FROM events), {cusum_sql("zz", "user_id", 0.5, 5.0)}
SELECT user_id, event_id, pos, neg, alarm FROM r JOIN zz USING (user_id, i)""", "pos neg")
def stream_online_cusum(spark, sf_dir):
    """Each user's one-sided sums, the state kept between batches."""
    return O.drained(O.online_cusum(O.replay(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value", 50.0, 25.0))
