"""Graph operators over supplier-part edges from lineitem and over events."""

from __future__ import annotations

from pyspark.sql import functions as F

from orebed.operators import graph as G
from orebed.operators import series as S
from orebed.queries.base import query, table

EDGES = "e AS (SELECT l_suppkey AS cause, l_suppkey + l_partkey % 7 + 1 AS effect, min(l_discount) AS p_value FROM lineitem GROUP BY ALL)"


def edges(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_suppkey").alias("cause"), (F.col("l_suppkey") + F.col("l_partkey") % 7 + 1).alias("effect")).agg(F.min("l_discount").alias("p_value"))


@query("edge_filter", f"WITH {EDGES}, t AS (SELECT DISTINCT cause, effect FROM e WHERE (cause + effect) % 3 <> 0) SELECT cause, effect, CASE WHEN p_value > 0.0 THEN 'P_VALUE' WHEN t.cause IS NULL THEN 'NOT_IN_TOPOLOGY' END AS removal_reason FROM e LEFT JOIN t USING (cause, effect)".replace("WHEN t.cause IS NULL", "WHEN (cause + effect) % 3 = 0"))
def edge_filter(spark, sf_dir):
    e = edges(spark, sf_dir)
    return G.filter_edges(e, e.where("(cause + effect) % 3 <> 0"), 0.0).select("cause", "effect", "removal_reason")


@query("degree_scores", f"""WITH {EDGES}, d AS (SELECT node, sum(o)::BIGINT AS n_out, sum(i)::BIGINT AS n_in FROM (SELECT cause AS node, 1 AS o, 0 AS i FROM e UNION ALL SELECT effect, 0, 1 FROM e) GROUP BY node)
SELECT node, n_out, n_in, 0.7 * n_out / (SELECT max(n_out) FROM d) + 0.3 * (1 - n_in / (SELECT max(n_in) FROM d)) AS upstreamness FROM d""", "upstreamness")
def degree_scores(spark, sf_dir):
    return G.degrees(edges(spark, sf_dir))


@query("khop_expand", f"""WITH RECURSIVE {EDGES}, r(node, hop) AS (SELECT s_suppkey, 0 FROM supplier WHERE s_suppkey <= 5 UNION SELECT effect, hop + 1 FROM r JOIN e ON cause = node WHERE hop < 3) SELECT node, min(hop) AS hop FROM r GROUP BY node""")
def khop_expand(spark, sf_dir):
    seeds = table(spark, sf_dir, "supplier").where("s_suppkey <= 5").select(F.col("s_suppkey").alias("node"))
    return G.expand(seeds, edges(spark, sf_dir), 3)


@query("propagation_paths", f"""WITH RECURSIVE {EDGES}, r AS (SELECT s_suppkey AS root, [s_suppkey] AS path FROM supplier WHERE s_suppkey <= 3 UNION ALL SELECT root, list_append(path, effect) FROM r JOIN e ON cause = path[-1] WHERE len(path) < 4 AND NOT list_contains(path, effect))
SELECT root, array_to_string(path, '>') AS path, (len(path) - 1)::INT AS length FROM r WHERE len(path) > 1""")
def propagation_paths(spark, sf_dir):
    roots = table(spark, sf_dir, "supplier").where("s_suppkey <= 3").select(F.col("s_suppkey").alias("node"))
    return G.paths(roots, edges(spark, sf_dir), 3).select("root", F.array_join("path", ">").alias("path"), "length")


@query("dag_levels", """WITH RECURSIVE t AS (SELECT p_partkey // 2 AS cause, p_partkey AS effect FROM part WHERE p_partkey > 1), r AS (SELECT 1::BIGINT AS node, 0 AS level UNION ALL SELECT effect, level + 1 FROM r JOIN t ON cause = node) SELECT node, max(level) AS level FROM r GROUP BY node""")
def dag_levels(spark, sf_dir):
    t = table(spark, sf_dir, "part").where("p_partkey > 1").select(F.floor(F.col("p_partkey") / 2).alias("cause"), F.col("p_partkey").alias("effect"))
    return G.levels(t)


@query("root_cause_rank", """WITH s AS (SELECT user_id, event_type, least(1, greatest(0, avg(value) / 100)) AS shift, least(1, count(*) / 20.0::DOUBLE) AS burden, least(1, stddev_pop(value) / 50) AS spread FROM events GROUP BY ALL),
c AS (SELECT *, shift * 0.5 + burden * 0.3 + spread * 0.2 AS score FROM s), r AS (SELECT user_id, event_type, score, row_number() OVER w AS "rank", score - lead(score) OVER w AS margin FROM c WINDOW w AS (PARTITION BY user_id ORDER BY round(score, 9) DESC, event_type))
SELECT * FROM r WHERE "rank" <= 3""", "score margin")
def root_cause_rank(spark, sf_dir):
    s = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg((F.avg("value") / 100).alias("shift"), (F.count(F.lit(1)) / 20.0).alias("burden"), (F.stddev_pop("value") / 50).alias("spread"))
    ranked = G.weighted_rank(s, ["user_id"], "event_type", {"shift": 0.5, "burden": 0.3, "spread": 0.2})
    return ranked.where("rank <= 3").select("user_id", "event_type", "score", "rank", "margin")


@query("weight_grid", """SELECT a / 4 AS shift, b / 4 AS burden, (4 - a - b) / 4 AS spread FROM (SELECT range AS a FROM range(5)), (SELECT range AS b FROM range(5)) WHERE a + b <= 4""")
def weight_grid(spark, sf_dir):
    return spark.createDataFrame([(g["shift"], g["burden"], g["spread"]) for g in G.weight_grid(4, ["shift", "burden", "spread"])], "shift double, burden double, spread double")


@query("regime_transitions", """WITH e AS (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) SELECT before, event_type, count(*) AS n FROM e WHERE before IS NOT NULL AND before <> event_type GROUP BY ALL""")
def regime_transitions(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select("event_type", F.lag("event_type").over(w).alias("before")).where("before IS NOT NULL AND before <> event_type").groupBy("before", "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("battery_localization", """WITH d AS (SELECT user_id, event_type, value - median(value) OVER (PARTITION BY event_type) AS dev FROM events), c AS (SELECT user_id, median(dev) AS bias, count(*) AS n FROM d GROUP BY user_id)
SELECT user_id, bias, row_number() OVER (ORDER BY round(abs(bias), 9) DESC, user_id) AS "rank" FROM c QUALIFY "rank" <= 20""", "bias")
def battery_localization(spark, sf_dir):
    """Members whose readings lie furthest from their group's median."""
    ev = table(spark, sf_dir, "events")
    dev = ev.join(S.robust_scale(ev, ["event_type"]), "event_type").select("user_id", (F.col("value") - F.col("center")).alias("dev"))
    from pyspark.sql import Window

    bias = dev.groupBy("user_id").agg(F.median("dev").alias("bias"))
    top = bias.orderBy(F.desc(F.round(F.abs("bias"), 9)), "user_id").limit(20)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(F.round(F.abs("bias"), 9)), "user_id")).cast("long"))  # twenty rows
