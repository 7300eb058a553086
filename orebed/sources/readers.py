"""Readers of recordings, event files, answer records and folders, as DataFrames with their checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orebed.operators.longseries import placed


def matrix_text(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, x array<double>): rows of numbers parted by white space; blank lines go, what is no finite number becomes null.

    Lines are numbered within their file. A file is read whole by one task, since its order is the order of time; files are dealt over the cluster.
    """
    rows = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", r"\r?\n")).alias("line", "text")).where(F.trim("text") != "")
    number = lambda s: F.when(s.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), s.cast("double"))
    return rows.select("file", "line", F.transform(F.split(F.trim("text"), r"\s+"), number).alias("x"))


def trajectories(spark: SparkSession, path: str, settings: int = 3, sensors: int = 21) -> DataFrame:
    """(unit, cycle, settings, sensors, in_order): run-to-failure rows; in_order tells whether the cycle is later than the unit's one before it in the file."""
    x = matrix_text(spark, path).where(F.size("x") == 2 + settings + sensors)
    rows = x.select("line", F.get("x", F.lit(0)).cast("long").alias("unit"), F.get("x", F.lit(1)).cast("long").alias("cycle"), F.slice("x", 3, settings).alias("settings"), F.slice("x", 3 + settings, sensors).alias("sensors"))
    return rows.withColumn("in_order", F.coalesce(F.col("cycle") > F.lag("cycle").over(Window.partitionBy("unit").orderBy("line")), F.lit(True))).drop("line")


def remaining_life(rows: DataFrame, cap: float | None = None) -> DataFrame:
    """rows with the cycles that the unit still had to run, at most cap."""
    left = (F.max("cycle").over(Window.partitionBy("unit")) - F.col("cycle")).cast("double")
    return rows.withColumn("remaining", left if cap is None else F.least(left, F.lit(cap)))


def separated_events(spark: SparkSession, path: str, statistics: tuple[str, ...] | None = ("avg",), keep: tuple[str, ...] = ("time_stamp", "asset_id", "id", "train_test", "status_type_id")) -> DataFrame:
    """Semicolon-separated event files: metadata columns, and the sensor columns of the named statistics as numbers (null where they are none).

    is_normal: the status is 0; a status that is no number isn't, and without the column all are.
    """
    raw = spark.read.option("header", True).option("sep", ";").csv(path)
    chosen = [c for c in raw.columns if c not in keep and (statistics is None or c.rsplit("_", 1)[-1] in statistics)]
    kept = [c for c in keep if c in raw.columns]
    normal = F.coalesce(F.expr("try_cast(status_type_id AS DOUBLE)"), F.lit(-1.0)) == 0 if "status_type_id" in kept else F.lit(True)
    typed = [F.expr("try_cast(time_stamp AS TIMESTAMP)").alias(c) if c == "time_stamp" else F.regexp_replace(F.trim(c), r"\.0$", "").alias(c) if c == "asset_id" else F.col(c) for c in kept]
    return raw.select(*typed, normal.alias("is_normal"), *[F.expr(f"try_cast(`{c}` AS DOUBLE)").alias(c) for c in chosen])


def answer_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(question, knowledge, answer, is_hallucinated): each JSON record gives its right and its wrong answer."""
    raw = spark.read.json(path)
    both = F.array(F.struct(F.col("right_answer").alias("answer"), F.lit(False).alias("is_hallucinated")), F.struct(F.col("hallucinated_answer").alias("answer"), F.lit(True).alias("is_hallucinated")))
    return raw.select("question", "knowledge", F.explode(both).alias("a")).select("question", "knowledge", "a.*")


def labelled_responses(spark: SparkSession, responses: str, sources: str, split: str | None = None, quality: str | None = "good") -> DataFrame:
    """Responses joined to their sources by source_id (those without one go); a response with any span is a hallucination."""
    r, s = spark.read.json(responses), spark.read.json(sources)
    wanted = r
    for column, value in (("split", split), ("quality", quality)):
        if value is not None:
            wanted = wanted.where(F.col(column) == value)
    return wanted.join(s.select("source_id", "task_type", "source_info"), "source_id").withColumn("is_hallucinated", F.size("labels") > 0)


def _suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def listed(spark: SparkSession, path: str, suffixes: tuple[str, ...]) -> DataFrame:
    """(path, size, modified) of the files below path with one of the suffixes, in order; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.where(_suffix(F.col("path")).isin(*suffixes)).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified")).orderBy("path")


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, sha256) of the files below path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def searched(spark: SparkSession, path: str, literal: str, most: int | None = None, clip: int | None = None) -> DataFrame:
    """(path, line, text): the lines that hold the literal in either case; a report of the first most by path and number, each cut at clip characters, where these are given."""
    lines = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.input_file_name().alias("path"), F.posexplode(F.split("value", r"\r?\n")).alias("line", "text"))
    hits = lines.where(F.contains(F.lower("text"), F.lit(literal.lower())))
    out = hits.select("path", (F.col("line") + 1).alias("line"), (F.substring("text", 1, clip) if clip else F.col("text")).alias("text"))
    return out.orderBy("path", "line").limit(most) if most else out


def lives_reconciled(units: DataFrame, lives: DataFrame) -> DataFrame:
    """(unit, life, issue): the n-th life of a list (place, life) belongs to the n-th unit; issue is NEGATIVE, MISSING (no life) or EXTRA (no unit)."""
    numbered = placed(units.select("unit").distinct().withColumn("_all", F.lit(0)), ["_all"], ["unit"], ["unit"]).select("unit", F.col("t_idx").alias("place"))
    j = numbered.join(lives.select(F.col("place").cast("long"), "life", F.lit(True).alias("_there")), "place", "full")
    issue = F.when(F.col("unit").isNull(), "EXTRA").when(F.col("_there").isNull(), "MISSING").when(F.col("life") < 0, "NEGATIVE")
    return j.select("unit", "life", issue.alias("issue"))


def event_info(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Each farm's semicolon-separated event table with wind_farm; columns that a farm lacks are null."""
    out = None
    for farm, path in paths.items():
        one = spark.read.option("header", True).option("sep", ";").csv(path).withColumn("wind_farm", F.lit(farm))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def asset_ids(*tables: DataFrame, column: str = "asset_id") -> DataFrame:
    """Distinct asset ids of all tables, trimmed and without a trailing .0."""
    out = None
    for one in tables:
        ids = one.select(F.regexp_replace(F.trim(column), r"\.0$", "").alias(column))
        out = ids if out is None else out.union(ids)
    return out.where(f"{column} IS NOT NULL AND {column} <> ''").distinct()


def layout_faults(files: DataFrame, farms: list[str], required: list[str]) -> DataFrame:
    """(farm, part) of the required parts below each farm's folder that have no file in a listing (path)."""
    wanted = files.sparkSession.createDataFrame([(f, r) for f in farms for r in required], "farm string, part string")
    there = files.select(F.regexp_extract("path", r"/([^/]+)/[^/]+/[^/]+$", 1).alias("farm"), F.regexp_extract("path", r"/([^/]+)/[^/]+$", 1).alias("part")).distinct()
    return wanted.join(there, ["farm", "part"], "left_anti")


def counted_events(rows: DataFrame, keys: list[str], size: int, index: str = "t_idx") -> DataFrame:
    """rows with event, the number of their full window of size rows; rows of a partial tail go."""
    event = F.floor(F.col(index) / size).cast("long")
    full = F.count(F.lit(1)).over(Window.partitionBy(*keys, "event")) == size
    return rows.withColumn("event", event).withColumn("_full", full).where("_full").drop("_full")


def recording_names(files: DataFrame, labels: dict[str, str], path: str = "path") -> DataFrame:
    """(path, speed_rpm, torque_nm, force_n, bearing, run, label) from names such as N15_M07_F10_KA01_1.mat; other names, and bearings without a label, go."""
    part = lambda i: F.regexp_extract(path, r"N([0-9]{2})_M([0-9]{2})_F([0-9]{2})_([A-Z]+[0-9]{2})_([0-9]+)\.mat$", i)
    label = F.create_map(*[x for k, v in labels.items() for x in (F.lit(k), F.lit(v))])[part(4)]
    out = files.where(part(4) != "").select(path, (part(1).cast("int") * 100).alias("speed_rpm"), (part(2).cast("int") / 10).alias("torque_nm"), (part(3).cast("int") * 100).alias("force_n"), part(4).alias("bearing"), part(5).cast("int").alias("run"), label.alias("label"))
    return out.where("label IS NOT NULL")


def scenarios(spark: SparkSession, path: str, required: tuple[str, ...]) -> DataFrame:
    """JSON lines with issues: the required fields that a record lacks, or UNREADABLE."""
    raw = spark.read.text(path)
    fields = F.json_object_keys("value")
    lacks = F.filter(F.array(*[F.lit(r) for r in required]), lambda r: ~F.coalesce(F.array_contains(fields, r), F.lit(False)))
    return raw.select("value", F.when(fields.isNull(), F.array(F.lit("UNREADABLE"))).otherwise(lacks).alias("issues"))


def discharge_cycles(cycles: DataFrame, battery: str, order: str, kind: str, capacity: str, channels: list[str]) -> DataFrame:
    """(battery, cycle, capacity, samples): the usable discharges of each battery, numbered from 1 in order.

    A cycle is a row with its kind, capacity and one array for each channel. Usable is a discharge with a positive capacity and two samples or more that are finite in all channels, as far as the shortest
    channel goes; samples (array of arrays in the channels' order) are those.
    """
    fine = lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False))
    n = F.least(*[F.coalesce(F.size(c), F.lit(0)) for c in channels], F.lit((1 << 31) - 1))
    rows = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.array(*[F.get(c, i).cast("double") for c in channels]))
    whole = F.when(n > 0, F.filter(rows, lambda r: F.forall(r, fine)))
    usable = cycles.where(F.lower(F.trim(F.col(kind))).contains("discharge") & (F.col(capacity) > 0)).withColumn("samples", whole).where(F.size("samples") >= 2)
    numbered = placed(usable, [battery], [order], [capacity, "samples"])
    return numbered.select(F.col(battery), (F.col("t_idx") + 1).alias("cycle"), F.col(capacity).alias("capacity"), "samples")


def first_at_most(cycles: DataFrame, battery: str, limit: float) -> DataFrame:
    """(battery, cycle): the first numbered cycle whose capacity is at the limit or below; null where none is."""
    return cycles.groupBy(battery).agg(F.min(F.when(F.col("capacity") <= limit, F.col("cycle"))).alias("cycle"))
