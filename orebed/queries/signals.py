"""Signal operators over events' series, lines as three phases, and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from orebed.operators import kernels as K
from orebed.operators import signals as G
from orebed.queries.base import EVENTS_SQL, SERIES, query, series, table

STFT_SQL = f"""{EVENTS_SQL}, w AS (SELECT user_id, event_type, t_idx, value, n, unnest(range(greatest(0, ceil((t_idx - 7) / 4)::BIGINT), least(t_idx // 4, (n - 8) // 4) + 1)) AS win FROM ev WHERE n >= 8),
p AS (SELECT user_id, event_type, win, bin, sum(x * cos(2 * pi() * j * bin / 8)) AS re, sum(x * sin(2 * pi() * j * bin / 8)) AS im FROM (SELECT *, t_idx - win * 4 AS j, value * (0.5 - 0.5 * cos(2 * pi() * (t_idx - win * 4) / 8)) AS x FROM w), (SELECT unnest(range(0, 5)) AS bin) GROUP BY ALL),
pw AS (SELECT user_id, event_type, win::INT AS "window", bin::INT AS bin, re * re + im * im AS power FROM p)"""


def stft(spark, sf_dir):
    return G.short_time_power(series(spark, sf_dir), SERIES, 8, 4)


@query("short_time_power", f"WITH {STFT_SQL} SELECT * FROM pw", "power", digits=4)
def short_time_power(spark, sf_dir):
    return stft(spark, sf_dir)


@query("transients", f"""WITH {STFT_SQL}, m AS (SELECT user_id, event_type, bin, median(power) AS mid FROM pw GROUP BY ALL) SELECT user_id, event_type, bin, "window", power / (mid + 1e-12::DOUBLE) > 6 AS strong FROM pw JOIN m USING (user_id, event_type, bin) WHERE round(power, 4) / round(mid + 1e-12::DOUBLE, 4) > 6 AND power / (mid + 1e-12::DOUBLE) > 6""")
def transients(spark, sf_dir):
    """Windows in which a frequency stands out of its own median."""
    t = G.transients(stft(spark, sf_dir), SERIES)
    return t.select(*SERIES, "bin", "window", (F.col("ratio") > 6).alias("strong"))


@query("spectral_entropy", f"""WITH {STFT_SQL}, m AS (SELECT user_id, event_type, bin, avg(power) AS p FROM pw WHERE bin > 0 GROUP BY ALL), s AS (SELECT user_id, event_type, p / sum(p) OVER (PARTITION BY user_id, event_type) AS s FROM m) SELECT user_id, event_type, -sum(s * ln(s)) / ln(count(*) + 1e-12) AS entropy FROM s WHERE s > 0 GROUP BY ALL""", "entropy")
def spectral_entropy(spark, sf_dir):
    return G.spectral_entropy(stft(spark, sf_dir), SERIES)


PAIR_SQL = f"""{EVENTS_SQL}, w AS (SELECT user_id, t_idx, max(value) FILTER (event_type = 'click') AS a, max(value) FILTER (event_type = 'view') AS b FROM ev GROUP BY ALL)"""


def pairs(spark, sf_dir):
    pick = lambda k: F.max(F.when(F.col("event_type") == k, F.col("value")))
    return series(spark, sf_dir).groupBy("user_id", "t_idx").agg(pick("click").alias("a"), pick("view").alias("b"))


@query("lag_correlation", f"""WITH {PAIR_SQL}, l AS (SELECT user_id, t_idx, a, unnest(range(-3, 4)) AS lag FROM w), r AS (SELECT l.user_id, lag::INT AS lag, count(l.a + w.b) AS n, corr(l.a, w.b) AS r FROM l JOIN w ON w.user_id = l.user_id AND w.t_idx = l.t_idx + lag GROUP BY ALL HAVING count(l.a + w.b) >= 4 AND corr(l.a, w.b) IS NOT NULL AND NOT isnan(corr(l.a, w.b)))
SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(abs(r), 9) DESC, abs(lag), lag) = 1 AS strongest FROM r""", "r")
def lag_correlation(spark, sf_dir):
    """Clicks against later and earlier views of the same user."""
    return G.lag_correlation(pairs(spark, sf_dir), ["user_id"], F.col("a"), F.col("b"), 3)


@query("stationarity", f"""WITH {EVENTS_SQL}, d AS (SELECT *, lag(value) OVER w AS l, value - lag(value) OVER w AS d, value - avg(value) OVER (PARTITION BY user_id, event_type) AS e FROM ev WINDOW w AS (PARTITION BY user_id, event_type ORDER BY t_idx)), s AS (SELECT *, sum(e) OVER (PARTITION BY user_id, event_type ORDER BY t_idx) AS s FROM d),
g AS (SELECT user_id, event_type, count(*) AS n, regr_slope(d, l) AS g, regr_sxx(d, l) AS sxx, regr_syy(d, l) AS syy, regr_sxy(d, l) AS sxy, sum(s * s) AS ss, sum(e * e) AS ee FROM s GROUP BY ALL HAVING count(*) >= 8),
t AS (SELECT user_id, event_type, n, g / sqrt(greatest(syy - g * sxy, 1e-12) / (n - 3) / greatest(sxx, 1e-12)) AS unit_root, ss / (n * greatest(ee, 1e-12)) AS level FROM g) SELECT *, unit_root < -2.86 AND level < 0.463 AS stationary FROM t""", "unit_root level")
def stationarity(spark, sf_dir):
    return G.stationarity(series(spark, sf_dir), SERIES)


@query("resampled", f"""WITH {EVENTS_SQL}, n AS (SELECT user_id, event_type, any_value(n) AS n FROM ev GROUP BY ALL HAVING any_value(n) >= 2), g AS (SELECT *, unnest(range(0, 10)) AS j FROM n), h AS (SELECT *, j * (n - 1) / 9.0 AS pos, least(floor(j * (n - 1) / 9.0 + 1e-9)::BIGINT, n - 2) AS lo FROM g),
x AS (SELECT h.user_id, h.event_type, j, a.value + (b.value - a.value) * (pos - lo) AS x FROM h JOIN ev a ON a.user_id = h.user_id AND a.event_type = h.event_type AND a.t_idx = lo JOIN ev b ON b.user_id = h.user_id AND b.event_type = h.event_type AND b.t_idx = lo + 1)
SELECT user_id, event_type, j::INT AS j, (x - avg(x) OVER w) / CASE WHEN stddev_pop(x) OVER w < 1e-12 THEN 1 ELSE stddev_pop(x) OVER w END AS x FROM x WINDOW w AS (PARTITION BY user_id, event_type)""", "x")
def resampled(spark, sf_dir):
    return G.resampled(series(spark, sf_dir), SERIES, 10)


@query("three_phase_features", """WITH g AS (SELECT l_suppkey, sqrt(avg(l_quantity * l_quantity)) AS rms_a, sqrt(avg(b * b)) AS rms_b, sqrt(avg(c * c)) AS rms_c FROM (SELECT *, l_discount * 500 AS b, l_tax * 600 AS c FROM lineitem) GROUP BY l_suppkey), m AS (SELECT *, (rms_a + rms_b + rms_c) / 3 AS rms FROM g)
SELECT *, greatest(abs(rms_a - rms), abs(rms_b - rms), abs(rms_c - rms)) / (rms + 1e-12::DOUBLE) AS imbalance FROM m""", "rms_a rms_b rms_c rms imbalance")
def three_phase_features(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_quantity").alias("a"), (F.col("l_discount") * 500).alias("b"), (F.col("l_tax") * 600).alias("c"))
    return G.three_phase(li, ["l_suppkey"], ("a", "b", "c"))


PH = ("l_quantity / 10", "l_discount * 10", "-2 + l_tax * 30", "-3 + l_discount * 5", "-2 - l_tax * 10", "3 - l_quantity / 60")
TURN = "0.8660254037844386"


@query("phase_order", f"""WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey, {', '.join(f'{e} AS {n}' for e, n in zip(PH, ('ra', 'ia', 'rb', 'ib', 'rc', 'ic'), strict=True))} FROM lineitem),
s AS (SELECT l_orderkey, l_linenumber, l_partkey, sqrt(pow((ra + (rb * -0.5 - ib * {TURN}) + (rc * -0.5 + ic * {TURN})) / 3, 2) + pow((ia + (rb * {TURN} + ib * -0.5) + (-rc * {TURN} + ic * -0.5)) / 3, 2)) AS positive,
sqrt(pow((ra + (rb * -0.5 + ib * {TURN}) + (rc * -0.5 - ic * {TURN})) / 3, 2) + pow((ia + (-rb * {TURN} + ib * -0.5) + (rc * {TURN} + ic * -0.5)) / 3, 2)) AS negative, sqrt(pow((ra + rb + rc) / 3, 2) + pow((ia + ib + ic) / 3, 2)) AS zero FROM p)
SELECT l_orderkey, l_linenumber, l_partkey, positive, negative / (positive + 1e-12::DOUBLE) AS negative_ratio, zero / (positive + 1e-12::DOUBLE) AS zero_ratio, CASE WHEN negative / (positive + 1e-12::DOUBLE) <= 0.1 THEN 'right' WHEN negative / (positive + 1e-12::DOUBLE) >= 0.5 THEN 'swapped' ELSE 'unclear' END AS "order" FROM s""", "positive negative_ratio zero_ratio", digits=4)
def phase_order(spark, sf_dir):
    """Six figures of each line as three phasors."""
    p = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", *[F.expr(e).alias(n) for e, n in zip(PH, ("ra", "ia", "rb", "ib", "rc", "ic"), strict=True)])
    return G.sequence_ratios(p, ["l_orderkey", "l_linenumber", "l_partkey"])


@query("dynamic_pca_monitoring")
def dynamic_pca_monitoring(spark, sf_dir):
    """Each row of two channels with the two rows before it, against the principal components of the even users' rows."""
    rows = pairs(spark, sf_dir)
    rows = rows.select("user_id", "t_idx", F.coalesce("a", F.lit(0.0)).alias("a"), F.coalesce("b", F.lit(0.0)).alias("b"))
    v = G.lag_vectors(rows, ["user_id"], ["a", "b"], 2).withColumn("id", F.concat_ws("-", "user_id", "t_idx"))
    return K.pca_monitor(v, v.where("user_id % 2 = 0"), "id", "v")
