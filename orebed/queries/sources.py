"""Readers over files that the tables' rows are first written to, in the shared folder; the SQL gives what must come back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orebed.queries.base import EVENTS_SQL, SERIES, query, series, table
from orebed.sources import readers as R
from orebed.streaming.online import shared_folder


def as_text(rows: DataFrame, name: str) -> str:
    path = shared_folder(rows.sparkSession, name)
    rows.write.text(path)
    return path


@query("matrix_text_read", "SELECT o_orderkey, o_totalprice AS a, CASE WHEN o_orderkey % 3 > 0 THEN o_custkey::DOUBLE END AS b FROM orders", "a")
def matrix_text_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of numbers by white space; what is none is null."""
    line = F.concat_ws("  ", F.lit(""), "o_orderkey", "o_totalprice", F.when(F.col("o_orderkey") % 3 > 0, F.col("o_custkey").cast("string")).otherwise(F.lit("nan")))
    x = R.matrix_text(spark, as_text(table(spark, sf_dir, "orders").select(line), "matrix"))
    return x.select(F.get("x", F.lit(0)).cast("long").alias("o_orderkey"), F.get("x", F.lit(1)).alias("a"), F.get("x", F.lit(2)).alias("b"))


@query("trajectories_read", f"""WITH {EVENTS_SQL}, s AS (SELECT user_id AS unit, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS cycle, value FROM ev)
SELECT unit, cycle, value AS first_sensor, true AS in_order, least(count(*) OVER (PARTITION BY unit) - cycle, 20)::DOUBLE AS remaining FROM s""", "first_sensor")
def trajectories_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run-to-failure rows of each unit, with what it had left."""
    from pyspark.sql import Window

    rows = table(spark, sf_dir, "events").withColumn("cycle", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    line = F.concat_ws(" ", "user_id", "cycle", *["value"] * 2, F.lit("100.0"), "value", *[F.lit(str(i)) for i in range(20)])
    dealt = rows.repartition("user_id").sortWithinPartitions("user_id", "cycle").select(line)
    read = R.remaining_life(R.trajectories(spark, as_text(dealt, "trajectories")), 20.0)
    return read.select("unit", "cycle", F.get("sensors", F.lit(0)).alias("first_sensor"), "in_order", "remaining")


def farm_files(spark: SparkSession, sf_dir: str) -> str:
    """Events as a semicolon-separated file of a farm."""
    rows = table(spark, sf_dir, "events").select(
        F.col("ts").cast("timestamp").cast("string").alias("time_stamp"), F.concat(F.lit(" "), F.col("user_id").cast("string"), F.lit(".0")).alias("asset_id"), F.col("event_id").alias("id"),
        F.when(F.col("event_id") % 4 == 0, "prediction").otherwise("train").alias("train_test"), F.when(F.col("event_id") % 5 == 0, "x").otherwise((F.col("event_id") % 3).cast("string")).alias("status_type_id"),
        F.col("value").alias("sensor_1_avg"), F.lit("?").alias("sensor_2_avg"), F.lit(1.5).alias("sensor_1_std"),
    )
    path = shared_folder(spark, "farm")
    rows.write.option("header", True).option("sep", ";").csv(path)
    return path


@query("event_file_read", "SELECT user_id::VARCHAR AS asset_id, event_id::VARCHAR AS id, CASE WHEN event_id % 4 = 0 THEN 'prediction' ELSE 'train' END AS train_test, event_id % 5 > 0 AND event_id % 3 = 0 AS is_normal, value AS sensor_1_avg, NULL::DOUBLE AS sensor_2_avg FROM events", "sensor_1_avg")
def event_file_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata and the averages' columns, with the normal rows marked and the split that each row belongs to."""
    return R.separated_events(spark, farm_files(spark, sf_dir)).select("asset_id", "id", "train_test", "is_normal", "sensor_1_avg", "sensor_2_avg")


@query("asset_ids_read", "SELECT DISTINCT user_id::VARCHAR AS asset_id FROM events UNION SELECT c_custkey::VARCHAR FROM customer WHERE c_nationkey = 3")
def asset_ids_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    info = table(spark, sf_dir, "customer").where("c_nationkey = 3").select(F.col("c_custkey").cast("double").cast("string").alias("asset_id"))
    return R.asset_ids(spark.read.option("header", True).option("sep", ";").csv(farm_files(spark, sf_dir)), info)


@query("event_info_read", "SELECT 'a' AS wind_farm, c_custkey::VARCHAR AS event_id, c_mktsegment AS label, NULL::VARCHAR AS note FROM customer WHERE c_nationkey % 2 = 0 UNION ALL SELECT 'b', c_custkey::VARCHAR, c_mktsegment, 'n' || c_nationkey FROM customer WHERE c_nationkey % 2 = 1")
def event_info_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two farms' event tables, one of which has a column more."""
    c, home = table(spark, sf_dir, "customer"), shared_folder(spark, "info")
    one = c.select(F.col("c_custkey").alias("event_id"), F.col("c_mktsegment").alias("label"), "c_nationkey")
    one.where("c_nationkey % 2 = 0").drop("c_nationkey").write.option("header", True).option("sep", ";").csv(f"{home}/a")
    one.where("c_nationkey % 2 = 1").withColumn("note", F.concat(F.lit("n"), "c_nationkey")).drop("c_nationkey").write.option("header", True).option("sep", ";").csv(f"{home}/b")
    return R.event_info(spark, {"a": f"{home}/a", "b": f"{home}/b"}).select("wind_farm", "event_id", "label", "note")


@query("layout_faults", """WITH f AS (SELECT DISTINCT c_nationkey, unnest(CASE WHEN c_acctbal > 9000 THEN ['data', 'info'] ELSE ['data'] END) AS part FROM customer WHERE c_custkey % 3 = 0),
w AS (SELECT n_nationkey, part FROM nation, (VALUES ('data'), ('info')) AS t(part))
SELECT 'farm=' || n_nationkey AS farm, 'part=' || w.part AS part FROM w LEFT JOIN f ON c_nationkey = n_nationkey AND f.part = w.part WHERE f.part IS NULL""")
def layout_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder for each nation: data of every third customer, info where one of them is rich; what is missing."""
    home = shared_folder(spark, "layout")
    parts = F.when(F.col("c_acctbal") > 9000, F.array(F.lit("data"), F.lit("info"))).otherwise(F.array(F.lit("data")))
    table(spark, sf_dir, "customer").where("c_custkey % 3 = 0").select(F.col("c_name").alias("value"), F.col("c_nationkey").alias("farm"), F.explode(parts).alias("part")).write.partitionBy("farm", "part").text(home)
    farms = [f"farm={r[0]}" for r in table(spark, sf_dir, "nation").select("n_nationkey").collect()]  # 25 rows
    return R.layout_faults(R.listed(spark, home, (".txt",)), farms, ["part=data", "part=info"])


@query("files_listed", "SELECT c_nationkey, sum(strlen(c_name) + 1)::BIGINT AS bytes FROM customer GROUP BY 1")
def files_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of the text files that a listing finds in each nation's folder."""
    home = shared_folder(spark, "listed")
    table(spark, sf_dir, "customer").select(F.col("c_name").alias("value"), "c_nationkey").write.partitionBy("c_nationkey").text(home)
    files = R.listed(spark, home, (".txt",))
    return files.groupBy(F.regexp_extract("path", r"c_nationkey=([0-9]+)/", 1).cast("long").alias("c_nationkey")).agg(F.sum("size").cast("long").alias("bytes"))


@query("files_searched", "SELECT p_name AS text, count(*) AS n FROM part WHERE contains(lower(p_name), 'bolt') GROUP BY p_name")
def files_searched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines that hold a literal, in either case."""
    path = as_text(table(spark, sf_dir, "part").select("p_name"), "searched")
    return R.searched(spark, path, "BOLT").groupBy("text").agg(F.count(F.lit(1)).alias("n"))


@query("lives_reconciled", """WITH u AS (SELECT c_custkey AS unit, row_number() OVER (ORDER BY c_custkey) - 1 AS place FROM customer WHERE c_nationkey < 12), l AS (SELECT s_suppkey AS place, CASE WHEN s_suppkey % 7 = 0 THEN -1 ELSE s_suppkey END AS life FROM supplier)
SELECT unit, life, CASE WHEN unit IS NULL THEN 'EXTRA' WHEN l.place IS NULL THEN 'MISSING' WHEN life < 0 THEN 'NEGATIVE' END AS issue FROM u FULL JOIN l USING (place)""")
def lives_reconciled(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = table(spark, sf_dir, "customer").where("c_nationkey < 12").select(F.col("c_custkey").alias("unit"))
    lives = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("place"), F.expr("CASE WHEN s_suppkey % 7 = 0 THEN -1 ELSE s_suppkey END").alias("life"))
    return R.lives_reconciled(units, lives)


@query("counted_events", f"WITH {EVENTS_SQL} SELECT event_id, t_idx // 5 AS event FROM ev QUALIFY count(*) OVER (PARTITION BY user_id, event_type, t_idx // 5) = 5")
def counted_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.counted_events(series(spark, sf_dir), SERIES, 5).select("event_id", "event")


@query("recording_names", """SELECT p_partkey, (p_size % 20 + 1) * 100 AS speed_rpm, (p_partkey % 30) / 10 AS torque_nm, 1000 AS force_n, CASE WHEN p_size % 2 = 0 THEN 'KA01' ELSE 'KI04' END AS bearing, (p_partkey % 9)::INT AS run, CASE WHEN p_size % 2 = 0 THEN 'outer' ELSE 'inner' END AS label FROM part WHERE p_partkey % 5 > 0 AND p_partkey % 7 > 0""", "torque_nm")
def recording_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditions read from file names; other names and unknown bearings go."""
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    p = table(spark, sf_dir, "part")
    bearing = F.when(F.col("p_partkey") % 7 == 0, "KX99").when(F.col("p_size") % 2 == 0, "KA01").otherwise("KI04")
    name = F.concat(F.lit("d/N"), two(F.col("p_size") % 20 + 1), F.lit("_M"), two(F.col("p_partkey") % 30), F.lit("_F10_"), bearing, F.lit("_"), (F.col("p_partkey") % 9).cast("string"), F.when(F.col("p_partkey") % 5 == 0, ".txt").otherwise(".mat"))
    files = p.select("p_partkey", F.struct("p_partkey", name.alias("n")).alias("f"), name.alias("path"))
    named = R.recording_names(files.select("path").distinct(), {"KA01": "outer", "KI04": "inner"})
    return files.join(named, "path").select("p_partkey", "speed_rpm", "torque_nm", "force_n", "bearing", "run", "label")


@query("answer_pairs_read", "SELECT item_id::VARCHAR AS question, CASE WHEN h THEN 'no ' || item_id ELSE 'yes ' || item_id END AS answer, h AS is_hallucinated FROM benchmark, (VALUES (true), (false)) AS t(h)")
def answer_pairs_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "benchmark").select(F.to_json(F.struct(F.col("item_id").cast("string").alias("question"), F.col("text").alias("knowledge"), F.concat(F.lit("yes "), "item_id").alias("right_answer"), F.concat(F.lit("no "), "item_id").alias("hallucinated_answer"))).alias("value"))
    return R.answer_pairs(spark, as_text(rows, "pairs")).select("question", "answer", "is_hallucinated")


@query("labelled_responses_read", "SELECT o_orderkey AS id, 's' || o_custkey AS source_id, c_mktsegment AS task_type, o_orderkey % 3 = 0 AS is_hallucinated FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F' AND c_nationkey < 20")
def labelled_responses_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses of one quality with the sources that there are."""
    spans = F.when(F.col("o_orderkey") % 3 == 0, F.array(F.struct(F.lit(1).alias("start"), F.lit(4).alias("end")))).otherwise(F.array().cast("array<struct<start:int,end:int>>"))
    r = table(spark, sf_dir, "orders").select(F.to_json(F.struct(F.col("o_orderkey").alias("id"), F.concat(F.lit("s"), "o_custkey").alias("source_id"), F.when(F.col("o_orderstatus") == "F", "good").otherwise("bad").alias("quality"), spans.alias("labels"))).alias("value"))
    s = table(spark, sf_dir, "customer").where("c_nationkey < 20").select(F.to_json(F.struct(F.concat(F.lit("s"), "c_custkey").alias("source_id"), F.col("c_mktsegment").alias("task_type"), F.col("c_name").alias("source_info"))).alias("value"))
    return R.labelled_responses(spark, as_text(r, "responses"), as_text(s, "sources")).select("id", "source_id", "task_type", "is_hallucinated")


@query("scenarios_read", "SELECT CASE o_orderkey % 4 WHEN 0 THEN 'UNREADABLE' WHEN 1 THEN 'action' WHEN 2 THEN 'action,claims' ELSE '' END AS issues, count(*) AS n FROM orders GROUP BY 1")
def scenarios_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines, some of which lack fields or are none."""
    text = F.expr("CASE o_orderkey % 4 WHEN 0 THEN 'no json' WHEN 1 THEN concat('{\"claims\": [', o_orderkey, ']}') WHEN 2 THEN '{}' ELSE '{\"action\": \"block\", \"claims\": []}' END")
    path = as_text(table(spark, sf_dir, "orders").select(text.alias("value")), "scenarios")
    return R.scenarios(spark, path, ("action", "claims")).groupBy(F.concat_ws(",", "issues").alias("issues")).agg(F.count(F.lit(1)).alias("n"))


@query("discharge_cycles", """WITH c AS (SELECT o_custkey, o_orderkey, o_totalprice AS capacity, list(l_quantity ORDER BY l_extendedprice) AS v, list(CASE WHEN l_tax > 0.05 THEN 'NaN'::DOUBLE ELSE l_discount END ORDER BY l_extendedprice) AS i FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderkey % 3 > 0 AND o_totalprice > 20000 GROUP BY ALL),
u AS (SELECT *, len(list_filter(i, lambda x: NOT isnan(x))) AS n FROM c),
k AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS cycle FROM u WHERE n >= 2)
SELECT o_custkey, cycle, capacity, n::INT AS n, min(CASE WHEN capacity <= 100000 THEN cycle END) OVER (PARTITION BY o_custkey) AS end_cycle FROM k""", "capacity")
def discharge_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's orders as a battery's cycles, their line items as samples of two channels; cheap orders have no capacity."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_extendedprice", "l_quantity", F.when(F.col("l_tax") > 0.05, float("nan")).otherwise(F.col("l_discount")).alias("d")))).alias("s"))
    cycles = table(spark, sf_dir, "orders").join(li, F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", "o_orderkey", F.when(F.col("o_totalprice") > 20000, F.col("o_totalprice")).alias("ah"), F.when(F.col("o_orderkey") % 3 > 0, " Discharge").otherwise("charge").alias("kind"), F.transform("s", lambda x: x["l_quantity"]).alias("v"), F.transform("s", lambda x: x["d"]).alias("i"))
    got = R.discharge_cycles(cycles, "o_custkey", "o_orderkey", "kind", "ah", ["v", "i"])
    return got.join(R.first_at_most(got, "o_custkey", 100000.0).withColumnRenamed("cycle", "end_cycle"), "o_custkey").select("o_custkey", "cycle", "capacity", F.size("samples").alias("n"), "end_cycle")
