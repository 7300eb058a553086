"""Calibrations over embeddings and events; tests/test_calibration.py compares those without SQL with plain grid searches."""

from __future__ import annotations

from pyspark.sql import functions as F

from orebed.operators import calibration as C
from orebed.operators import longseries as L
from orebed.queries.base import query, rounded, table
from orebed.streaming import online as O


@query("calibrated_monitoring")
def calibrated_monitoring(spark, sf_dir):
    """Limits of component monitoring, with the embeddings in their ids' order as healthy rows."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    fine = vectors.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & (F.size("v") > 0))
    return C.calibrated_monitoring(fine, ["vec_id"], "v")


@query("calibrated_limits")
def calibrated_limits(spark, sf_dir):
    """Alarm limits judged on each user's events as a healthy recording."""
    ev = table(spark, sf_dir, "events")
    stats = ev.groupBy("event_type").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    rows = L.placed(ev, ["user_id"], ["ts", "event_id"], ["event_type", "value"]).join(F.broadcast(stats), "event_type").withColumn("z", (F.col("value") - F.col("m")) / F.greatest("s", F.lit(1e-12)))  # five types
    trials = C.limit_trials(rows, "user_id", "z", (0.5, 1.0, 1.5), (1, 2), (0.25, 0.5), (1.0, 2.0), (0.02, 0.1), least_run=1)
    return C.calibrated_limits(trials, "user_id", C.SETTINGS, "detected", "alarmed", "total", draws=200)


@query("stream_freshness", """WITH e AS (SELECT user_id, epoch(ts) AS t, lead(epoch(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, max(epoch(ts)) OVER () AS w FROM events),
l AS (SELECT user_id, t, coalesce(n, w - 1) AS until, unnest([21600, 86400]) AS lim FROM e)
SELECT user_id, round(t, 3) AS ts, round(t, 3) AS moment, 'FRESH' AS status, false AS late FROM e
UNION ALL SELECT user_id, round(t, 3), round(t + lim, 3), CASE lim WHEN 21600 THEN 'STALE' ELSE 'EXPIRED' END, false FROM l WHERE t + lim < until""", "ts moment", digits=2)
def stream_freshness(spark, sf_dir):
    """When each user's latest event is six hours and a day old, by timers."""
    out = O.drained(O.streamed_freshness(O.replay(spark, sf_dir, "events"), ["user_id"], "ts", "ts", 21600, 86400))
    return out.withColumns({"ts": rounded(F.col("ts"), 3), "moment": rounded(F.col("at"), 3)}).drop("at")


@query("stream_online_variates")
def stream_online_variates(spark, sf_dir):
    """Each event type's values against a model of its first 150 events."""
    first = L.placed(table(spark, sf_dir, "events"), ["event_type"], ["ts", "event_id"], ["value"]).where("t_idx < 150")
    models = O.trained_variates(first, ["event_type"], "t_idx", ["value"], 3, 2)
    return O.drained(O.online_variates(O.replay(spark, sf_dir, "events"), ["event_type"], ["ts", "event_id"], ["value"], models, 3))
