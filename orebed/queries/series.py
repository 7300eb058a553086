"""Series operators over events: series = (user, type), value by time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orebed.operators import series as S
from orebed.queries.base import EVENTS_SQL, PART, SERIES, query, series, table

Z_SQL = f"""{EVENTS_SQL},
ref AS (SELECT user_id, event_type, avg(value) AS ref_mean, stddev_pop(value) AS ref_std FROM ev WHERE t_idx < greatest(5, n // 5) GROUP BY ALL),
z AS (SELECT ev.*, (value - ref_mean) / CASE WHEN ref_std < 1e-12 THEN 1 ELSE ref_std END AS z FROM ev JOIN ref USING (user_id, event_type))"""
RUN_SQL = """runs AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, run ORDER BY t_idx) AS place, count(*) OVER (PARTITION BY user_id, event_type, run) AS run_length, min(t_idx) OVER (PARTITION BY user_id, event_type, run) AS run_start
  FROM (SELECT *, sum((NOT alarm)::INT) OVER (PARTITION BY user_id, event_type ORDER BY t_idx) AS run FROM flagged) WHERE alarm)"""


def zscored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events scored against the first fifth (five at least) of their series."""
    rows = series(spark, sf_dir).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*SERIES)))
    return S.standardize_against(rows, rows.where(F.col("t_idx") < F.greatest(F.lit(5), F.floor(F.col("n") / 5))), SERIES)


def alarmed(spark: SparkSession, sf_dir: str, z: float = 1.0) -> DataFrame:
    return zscored(spark, sf_dir).withColumn("alarm", F.abs("z") >= z)


@query("alarm_episodes", f"""WITH {Z_SQL}, flagged AS (SELECT *, abs(z) >= 1.0 AS alarm FROM z), {RUN_SQL},
episodes AS (SELECT user_id, event_type, run_start, count(*) AS length, max(abs(z)) AS peak FROM runs WHERE run_length >= 3 GROUP BY ALL),
latest AS (SELECT user_id, event_type, arg_max(value, t_idx) AS latest_value FROM ev GROUP BY ALL)
SELECT user_id, event_type, run_start, length, peak, latest_value FROM episodes JOIN latest USING (user_id, event_type)""", "peak latest_value")
def alarm_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of three or more alarms in a row per asset and metric, with their peak and the latest reading."""
    rows = alarmed(spark, sf_dir)
    episodes = S.runs(rows, SERIES, "alarm").where("run_length >= 3").groupBy(*SERIES, "run_start").agg(F.count(F.lit(1)).alias("length"), F.max(F.abs("z")).alias("peak"))
    latest = S.latest_per(table(spark, sf_dir, "events"), SERIES, ["ts", "event_id"], ["value"]).withColumnRenamed("value", "latest_value")
    return episodes.join(latest, SERIES)


@query("data_quality", """SELECT event_type, count(*) AS n, 1 - count(value) / count(*) AS missing_fraction, avg(value) AS mean, stddev_pop(value) AS std,
count(value) < count(*) AS has_missing, coalesce(stddev_pop(value) < 1e-12, false) AS is_constant FROM events GROUP BY event_type""", "missing_fraction mean std")
def data_quality(spark, sf_dir):
    return S.data_quality(table(spark, sf_dir, "events"), ["event_type"])


@query("scada_quality", f"""WITH {EVENTS_SQL}, d AS (SELECT user_id, x - lag(x) OVER ({PART} ORDER BY ts, event_id) AS dt FROM (SELECT *, 0 AS o FROM ev)),
e AS (SELECT user_id, x - lag(x) OVER (PARTITION BY user_id ORDER BY ts) AS dt FROM ev), s AS (SELECT * FROM e WHERE dt IS NOT NULL),
m AS (SELECT user_id, median(dt) AS median_dt FROM s GROUP BY user_id)
SELECT user_id, any_value(median_dt) AS median_dt, avg((abs(dt - median_dt) > greatest(median_dt * 0.05, 1e-9))::INT) AS irregular_fraction,
avg((abs(dt - median_dt) > greatest(median_dt * 0.05, 1e-9))::INT) > 0.01 AS irregular FROM s JOIN m USING (user_id) GROUP BY user_id""".replace(f"d AS (SELECT user_id, x - lag(x) OVER ({PART} ORDER BY ts, event_id) AS dt FROM (SELECT *, 0 AS o FROM ev)),\n", ""), "median_dt irregular_fraction", digits=3)
def scada_quality(spark, sf_dir):
    return S.sampling_irregularity(table(spark, sf_dir, "events"), ["user_id"])


@query("standardize_reference", f"WITH {Z_SQL} SELECT event_id, z FROM z", "z")
def standardize_reference(spark, sf_dir):
    return zscored(spark, sf_dir).select("event_id", "z")


@query("robust_scale", """WITH m AS (SELECT event_type, median(value) AS center, stddev_pop(value) AS std FROM events GROUP BY ALL)
SELECT event_type, any_value(center) AS center, CASE WHEN median(abs(value - center)) * 1.4826 > 1e-12 THEN median(abs(value - center)) * 1.4826 WHEN any_value(std) > 1e-12 THEN any_value(std) ELSE 1 END AS scale
FROM events JOIN m USING (event_type) GROUP BY event_type""", "center scale")
def robust_scale(spark, sf_dir):
    return S.robust_scale(table(spark, sf_dir, "events"), ["event_type"])


@query("time_domain_features", """WITH d AS (SELECT event_type, value - avg(value) OVER (PARTITION BY event_type) AS d FROM events),
m AS (SELECT event_type, count(*) AS n, sqrt(avg(d*d)) AS rms, max(abs(d)) AS peak, avg(d*d) AS m2, avg(d*d*d) AS m3, avg(d*d*d*d) AS m4 FROM d GROUP BY ALL)
SELECT event_type, n, rms, peak, peak / rms AS crest, sqrt(n * (n - 1.0)) / (n - 2) * m3 / pow(m2, 1.5) AS skewness, m4 / (m2 * m2) AS kurtosis FROM m""", "rms peak crest skewness kurtosis")
def time_domain_features(spark, sf_dir):
    return S.time_domain_features(table(spark, sf_dir, "events"), ["event_type"])


@query("alarm_persistence", f"""WITH {Z_SQL}, flagged AS (SELECT *, abs(z) >= 1.0 AS alarm FROM z), {RUN_SQL}
SELECT z.event_id, coalesce(place >= 2, false) AS persistent FROM z LEFT JOIN runs USING (event_id)""")
def alarm_persistence(spark, sf_dir):
    return S.alarm_persistence(alarmed(spark, sf_dir), SERIES, "alarm", 2).select("event_id", "persistent")


@query("longest_run", f"""WITH {Z_SQL}, flagged AS (SELECT *, abs(z) >= 1.0 AS alarm FROM z), {RUN_SQL}
SELECT user_id, event_type, run_length AS longest, run_start AS "start" FROM runs WHERE place = 1 QUALIFY row_number() OVER ({PART} ORDER BY run_length DESC, run_start) = 1""")
def longest_run(spark, sf_dir):
    return S.longest_run(alarmed(spark, sf_dir), SERIES, "alarm")


@query("first_persistent", f"""WITH {Z_SQL}, flagged AS (SELECT *, abs(z) >= 1.0 AS alarm FROM z), {RUN_SQL}
SELECT user_id, event_type, min(run_start) AS onset FROM runs WHERE run_length >= 2 GROUP BY ALL""")
def first_persistent(spark, sf_dir):
    return S.first_persistent(alarmed(spark, sf_dir), SERIES, "alarm", 2)


@query("fault_onset", f"""WITH {EVENTS_SQL}, base AS (SELECT *, greatest(5, n // 5) AS k FROM ev), m AS (SELECT user_id, event_type, median(value) AS c, stddev_pop(value) AS s FROM base WHERE t_idx < k GROUP BY ALL),
d AS (SELECT user_id, event_type, any_value(c) AS c, median(abs(value - c)) * 1.4826 AS mad, any_value(s) AS s FROM base JOIN m USING (user_id, event_type) WHERE t_idx < k GROUP BY ALL),
sc AS (SELECT base.*, (value - c) / CASE WHEN mad > 1e-12 THEN mad WHEN s > 1e-12 THEN s ELSE 1 END AS z FROM base JOIN d USING (user_id, event_type)),
flagged AS (SELECT *, abs(z) >= 1.5 AND t_idx >= k AS alarm FROM sc), {RUN_SQL},
o AS (SELECT user_id, event_type, min(run_start) AS onset FROM runs WHERE run_length >= 2 GROUP BY ALL)
SELECT user_id, event_type, onset, row_number() OVER (PARTITION BY user_id ORDER BY onset, event_type) AS "rank" FROM o""")
def fault_onset(spark, sf_dir):
    """First run of two robust deviations after the base period, channels ranked by onset within an asset."""
    rows = series(spark, sf_dir).withColumn("k", F.greatest(F.lit(5), F.floor(F.count(F.lit(1)).over(Window.partitionBy(*SERIES)) / 5)))
    scale = S.robust_scale(rows.where("t_idx < k"), SERIES)
    scored = rows.join(scale, SERIES).withColumn("alarm", (F.abs((F.col("value") - F.col("center")) / F.col("scale")) >= 1.5) & (F.col("t_idx") >= F.col("k")))
    return S.first_persistent(scored, SERIES, "alarm", 2).withColumn("rank", F.row_number().over(Window.partitionBy("user_id").orderBy("onset", "event_type")).cast("long"))


@query("rolling_stats", f"""WITH {EVENTS_SQL} SELECT event_id,
CASE WHEN count(*) OVER w = 5 THEN avg(value) OVER w END AS roll_mean, CASE WHEN count(*) OVER w = 5 THEN stddev_pop(value) OVER w END AS roll_std, CASE WHEN count(*) OVER w = 5 THEN regr_slope(value, t_idx) OVER w END AS roll_slope
FROM ev WINDOW w AS ({PART} ORDER BY t_idx ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""", "roll_mean roll_std roll_slope", digits=4)
def rolling_stats(spark, sf_dir):
    return S.rolling_statistics(series(spark, sf_dir), SERIES, 5).select("event_id", "roll_mean", "roll_std", "roll_slope")


@query("lagged_matrix", f"WITH {EVENTS_SQL}, l AS (SELECT event_id, t_idx, value AS x0, lag(value) OVER w AS x1, lag(value, 2) OVER w AS x2 FROM ev WINDOW w AS ({PART} ORDER BY t_idx)) SELECT event_id, x0, x1, x2 FROM l WHERE t_idx >= 2")
def lagged_matrix(spark, sf_dir):
    return S.lagged(series(spark, sf_dir), SERIES, 2).select("event_id", "x0", "x1", "x2")


@query("gradient", f"""WITH {EVENTS_SQL}, g AS (SELECT event_id, value, lag(value) OVER w AS b, lead(value) OVER w AS a FROM ev WINDOW w AS ({PART} ORDER BY t_idx))
SELECT event_id, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN (a - b) / 2 ELSE coalesce(a - value, value - b) END AS gradient FROM g""", "gradient")
def gradient(spark, sf_dir):
    return S.gradient(series(spark, sf_dir), SERIES).select("event_id", "gradient")


@query("smooth_median", f"WITH {EVENTS_SQL} SELECT event_id, median(value) OVER ({PART} ORDER BY t_idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS smooth FROM ev", "smooth")
def smooth_median(spark, sf_dir):
    return S.smooth_median(series(spark, sf_dir), SERIES, 2).select("event_id", "smooth")


@query("moving_average", f"WITH {EVENTS_SQL} SELECT event_id, sum(value) OVER ({PART} ORDER BY t_idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5 AS smooth FROM ev", "smooth")
def moving_average(spark, sf_dir):
    return S.moving_average_same(series(spark, sf_dir), SERIES, 5).select("event_id", "smooth")


@query("cusum_unreset", f"""WITH {Z_SQL}, s AS (SELECT event_id, user_id, event_type, t_idx, sum(z - 0.5) OVER w AS p, sum(-z - 0.5) OVER w AS m FROM z WINDOW w AS ({PART} ORDER BY t_idx))
SELECT event_id, p - least(0, min(p) OVER w) AS cusum_pos, m - least(0, min(m) OVER w) AS cusum_neg FROM s WINDOW w AS ({PART} ORDER BY t_idx)""", "cusum_pos cusum_neg", digits=4)
def cusum_unreset(spark, sf_dir):
    return S.cusum_unreset(zscored(spark, sf_dir), SERIES, 0.5).select("event_id", "cusum_pos", "cusum_neg")


@query("criticality_lower_bound", f"""WITH {Z_SQL}, s AS (SELECT event_id, user_id, event_type, t_idx, sum(CASE WHEN abs(z) >= 1 THEN 1 ELSE -1 END) OVER ({PART} ORDER BY t_idx) AS s FROM z)
SELECT event_id, (s - least(0, min(s) OVER ({PART} ORDER BY t_idx)))::BIGINT AS criticality FROM s""")
def criticality_lower_bound(spark, sf_dir):
    return S.criticality(alarmed(spark, sf_dir), SERIES, "alarm").select("event_id", F.col("criticality").cast("long").alias("criticality"))


@query("pre_post_shift", f"""WITH {EVENTS_SQL}, k AS (SELECT *, greatest(10, n // 5) AS k FROM ev),
m AS (SELECT user_id, event_type, median(value) AS c, stddev_pop(value) AS s FROM k WHERE t_idx < k GROUP BY ALL),
b AS (SELECT user_id, event_type, any_value(c) AS c, median(abs(value - c)) * 1.4826 AS mad, any_value(s) AS s FROM k JOIN m USING (user_id, event_type) WHERE t_idx < k GROUP BY ALL),
a AS (SELECT user_id, event_type, median(value) AS pc, stddev_pop(value) AS ps FROM k WHERE t_idx >= k GROUP BY ALL),
f AS (SELECT user_id, event_type, abs(pc - c) / CASE WHEN mad > 1e-12 THEN mad WHEN s > 1e-12 THEN s ELSE 1 END AS shift, abs(ln(greatest(ps, 1e-9) / greatest(s, 1e-9))) AS log_std_ratio FROM a JOIN b USING (user_id, event_type))
SELECT *, shift + 0.25 * log_std_ratio AS score FROM f""", "shift log_std_ratio score")
def pre_post_shift(spark, sf_dir):
    rows = series(spark, sf_dir).withColumn("k", F.greatest(F.lit(10), F.floor(F.count(F.lit(1)).over(Window.partitionBy(*SERIES)) / 5)))
    return S.pre_post_shift(rows, SERIES, "k")


@query("regime_normalize", """SELECT event_id, (value - avg(value) OVER w) / CASE WHEN stddev_pop(value) OVER w < 1e-12 THEN 1 ELSE stddev_pop(value) OVER w END AS z FROM events WINDOW w AS (PARTITION BY event_type, user_id % 3)""", "z")
def regime_normalize(spark, sf_dir):
    ev = table(spark, sf_dir, "events").withColumn("regime", F.col("user_id") % 3)
    return S.regime_normalize(ev, ["event_type", "regime"]).select("event_id", "z")


@query("tumbling_count_windows", f"""WITH {EVENTS_SQL} SELECT user_id, event_type, t_idx // 4 AS win, sum(value) AS total, min(value) AS low, max(value) AS high FROM ev GROUP BY ALL HAVING count(*) = 4""", "total")
def tumbling_count_windows(spark, sf_dir):
    return S.tumbling_by_count(series(spark, sf_dir), SERIES, 4)


@query("sliding_windows", f"""WITH {EVENTS_SQL}, s AS (SELECT a.user_id, a.event_type, a.t_idx AS "start", avg(b.value) AS mean, count(*) AS n FROM ev a JOIN ev b ON a.user_id = b.user_id AND a.event_type = b.event_type AND b.t_idx BETWEEN a.t_idx AND a.t_idx + 5 WHERE a.t_idx % 3 = 0 GROUP BY ALL)
SELECT user_id, event_type, "start", mean FROM s WHERE n = 6""", "mean")
def sliding_windows(spark, sf_dir):
    return S.sliding_by_count(series(spark, sf_dir), SERIES, 6, 3)


@query("trend_analysis", f"""WITH {EVENTS_SQL}, r AS (SELECT *, x - min(x) OVER ({PART}) AS s, lag(value) OVER w AS b, lead(x) OVER w - x AS stay FROM ev WINDOW w AS ({PART} ORDER BY t_idx)),
a AS (SELECT user_id, event_type, count(*) AS n, regr_slope(value, s / 86400) AS slope_per_day, avg(value) AS mean, min(value) AS low, max(value) AS high, arg_max(value, t_idx) AS latest, arg_min(value, t_idx) AS earliest,
  avg(value) FILTER (t_idx >= n - 3) AS tail_mean, count(*) FILTER (value > 50) AS n_over, count(*) FILTER (value > 50 AND b <= 50) AS crossings, coalesce(sum(stay) FILTER (value > 50), 0)::DOUBLE AS seconds_over FROM r GROUP BY user_id, event_type)
SELECT *, latest - earliest AS change, CASE WHEN earliest <> 0 THEN (latest - earliest) / abs(earliest) * 100 END AS pct_change FROM a WHERE n >= 2""", "slope_per_day mean tail_mean seconds_over change pct_change", digits=3)
def trend_analysis(spark, sf_dir):
    return S.trend(table(spark, sf_dir, "events"), SERIES, 50.0)


@query("latest_per_metric", f"SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER ({PART} ORDER BY ts DESC, event_id DESC) = 1")
def latest_per_metric(spark, sf_dir):
    return S.latest_per(table(spark, sf_dir, "events"), SERIES, ["ts", "event_id"], ["event_id", "value"])


@query("freshness_status", """WITH l AS (SELECT user_id, max(epoch(ts)) AS x FROM events GROUP BY user_id)
SELECT user_id, 1706659200 - x AS age_s, CASE WHEN 1706659200 - x < 0 THEN 'FUTURE' WHEN 1706659200 - x <= 3600 THEN 'FRESH' WHEN 1706659200 - x <= 172800 THEN 'STALE' ELSE 'EXPIRED' END AS status FROM l""", "age_s", digits=3)
def freshness_status(spark, sf_dir):
    latest = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max(F.col("ts").cast("timestamp")).alias("ts"))
    return S.freshness(latest, F.lit(1706659200.0), limit_s=3600, expired_s=172800).select("user_id", "age_s", "status")


@query("history_limit_then_range", f"WITH {EVENTS_SQL} SELECT event_id FROM (SELECT * FROM ev QUALIFY row_number() OVER ({PART} ORDER BY ts DESC, event_id DESC) <= 10) WHERE x BETWEEN 1704844800 AND 1706054400")
def history_limit_then_range(spark, sf_dir):
    ev = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return S.limit_then_range(ev, SERIES, 10, F.timestamp_seconds(F.lit(1704844800)), F.timestamp_seconds(F.lit(1706054400))).select("event_id")


@query("conformal_radius", """WITH r AS (SELECT event_type, abs(value - avg(value) OVER (PARTITION BY event_type)) AS a FROM events), k AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY a) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM r)
SELECT event_type, any_value(n) AS n, max(a) FILTER (r = ceil((n + 1) * 0.9)) AS radius FROM k GROUP BY event_type""", "radius")
def conformal_radius(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    return S.conformal_radius(ev.withColumn("residual", F.col("value") - F.avg("value").over(Window.partitionBy("event_type"))), ["event_type"], 0.9)


@query("cross_sensor_corr", """WITH d AS (SELECT event_type, floor(epoch(ts) / 86400)::BIGINT AS day, avg(value) AS v FROM events GROUP BY ALL)
SELECT a.event_type AS channel_a, b.event_type AS channel_b, corr(a.v, b.v) AS r, count(*) AS n FROM d a JOIN d b ON a.day = b.day AND a.event_type < b.event_type GROUP BY ALL""", "r")
def cross_sensor_corr(spark, sf_dir):
    daily = table(spark, sf_dir, "events").groupBy("event_type", F.floor(F.col("ts").cast("timestamp").cast("double") / 86400).alias("day")).agg(F.avg("value").alias("v"))
    return S.pair_correlation(daily, "event_type", "day", "v")


@query("as_of_orders_events", """SELECT o.event_id, e.value AS right_value FROM (SELECT * FROM events WHERE event_type = 'purchase') o ASOF LEFT JOIN (SELECT user_id, ts, value FROM events WHERE event_type = 'click' QUALIFY row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id DESC) = 1) e ON o.user_id = e.user_id AND o.ts >= e.ts""")
def as_of_orders_events(spark, sf_dir):
    """Each purchase with the user's latest click before it."""
    ev = table(spark, sf_dir, "events")
    clicks = ev.where("event_type = 'click'").groupBy("user_id", "ts").agg(F.max_by("value", "event_id").alias("value"))
    return S.as_of_join(ev.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), clicks, ["user_id"], "ts", ["value"]).select("event_id", "right_value")
