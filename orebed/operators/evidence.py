"""Evidence evaluation: units, rules, requirements, conflicts, discrepancies, validation, upserts, profiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Canonical unit, factor and shift of each unit by dimension (canonical = value * factor + shift).
UNITS = (
    ("degC", "degC", 1.0, 0.0), ("degF", "degC", 5 / 9, -160 / 9), ("K", "degC", 1.0, -273.15),
    ("bar", "bar", 1.0, 0.0), ("kPa", "bar", 0.01, 0.0), ("psi", "bar", 0.0689475729, 0.0), ("MPa", "bar", 10.0, 0.0),
    ("mm/s", "mm/s", 1.0, 0.0), ("in/s", "mm/s", 25.4, 0.0), ("s", "s", 1.0, 0.0), ("min", "s", 60.0, 0.0), ("h", "s", 3600.0, 0.0),
)

#: Rules that are broadcast at most.
SENT = 200_000


def normalize_units(rows: DataFrame, value: str = "value", unit: str = "unit") -> DataFrame:
    """rows with canonical_value, canonical_unit and unit_status: OK, UNIT_UNKNOWN or UNIT_MISSING (expressions alone: the table is a literal)."""
    factor = F.create_map(*[x for u, _, f, _ in UNITS for x in (F.lit(u), F.lit(float(f)))])[F.col(unit)]
    shift = F.create_map(*[x for u, _, _, s in UNITS for x in (F.lit(u), F.lit(float(s)))])[F.col(unit)]
    canon = F.create_map(*[x for u, c, _, _ in UNITS for x in (F.lit(u), F.lit(c))])[F.col(unit)]
    status = F.when(F.col(unit).isNull() | (F.trim(unit) == ""), "UNIT_MISSING").when(factor.isNull(), "UNIT_UNKNOWN").otherwise("OK")
    return rows.withColumn("canonical_value", F.col(value) * factor + shift).withColumn("canonical_unit", canon).withColumn("unit_status", status)


def holds(op: Column, value: Column, low: Column, high: Column) -> Column:
    """Whether value meets the rule: < <= == >= > against low, or between low and high."""
    return F.when(op == "<", value < low).when(op == "<=", value <= low).when(op == "==", value == low).when(op == ">=", value >= low).when(op == ">", value > low).when(op == "between", (value >= low) & (value <= high))


def evaluate_rules(measurements: DataFrame, rules: DataFrame, metric: str = "metric", value: str = "value") -> DataFrame:
    """Each measurement with each rule of its metric: result, and NORMAL, DEVIATION or UNVERIFIED (no value or bound). Up to SENT rules are broadcast, so that measurements of one metric are not one task's."""
    rules = F.broadcast(rules) if rules.count() <= SENT else rules
    j = measurements.join(rules, metric)
    ok = holds(F.col("op"), F.col(value), F.col("low"), F.col("high"))
    return j.withColumn("result", ok).withColumn("status", F.when(ok.isNull(), "UNVERIFIED").when(ok, "NORMAL").otherwise("DEVIATION"))


def satisfied_requirements(requirements: DataFrame, evidence: DataFrame, id_col: str, on: list[str]) -> DataFrame:
    """requirements with n_evidence: rows of evidence that equal it in every column of on that it names (null: any).

    Evidence is counted once for each set of columns (grouping sets), so a requirement meets one row, that of the columns it names, by an equal join.
    """
    counted = evidence.cube(*on).agg(F.count(F.lit(1)).alias("_n"), F.grouping_id().alias("_set"))
    named = reduce(lambda s, c: s * 2 + F.col(c).isNull().cast("int"), on, F.lit(0))
    right = counted.select(F.col("_set").alias("_s"), *[F.col(c).alias(f"_{c}") for c in on], "_n")
    hit = reduce(lambda h, c: h & F.col(c).eqNullSafe(F.col(f"_{c}")), on, named == F.col("_s"))
    out = requirements.join(right, hit, "left").groupBy(*requirements.columns).agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n_evidence"))
    return out.withColumn("satisfied", F.col("n_evidence") > 0)


def discrepancies(rows: DataFrame, keys: list[str], source: str, value: str, tolerance: float) -> DataFrame:
    """Keys whose sources differ by more than tolerance: lowest, highest and number of sources (no pairs are made)."""
    spread = rows.groupBy(*keys).agg(F.min(value).alias("low"), F.max(value).alias("high"), F.count_distinct(source).alias("sources"))
    return spread.where((F.col("sources") > 1) & (F.col("high") - F.col("low") > tolerance))


def conflicts(rows: DataFrame, keys: list[str], value: Column, revision: str) -> DataFrame:
    """Keys with more than one distinct value and more than one distinct revision."""
    found = rows.groupBy(*keys).agg(F.count_distinct(value).alias("n_values"), F.count_distinct(revision).alias("n_revisions"))
    return found.where("n_values > 1 AND n_revisions > 1")


def dangling(child: DataFrame, fk: str, parent: DataFrame, pk: str, name: str) -> DataFrame:
    """(reference, key): foreign keys of child without a parent; nulls don't count."""
    missing = child.where(F.col(fk).isNotNull()).select(F.col(fk).alias("key")).distinct().join(parent.select(F.col(pk).alias("key")), "key", "left_anti")
    return missing.select(F.lit(name).alias("reference"), F.col("key").cast("long").alias("key"))


def manifest_diff(expected: DataFrame, actual: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, status) of MISSING, UNEXPECTED and MISMATCH entries (keys unique on each side)."""
    a, b = expected.select(key, F.col(digest).alias("_a"), F.lit(1).alias("_x")), actual.select(key, F.col(digest).alias("_b"), F.lit(1).alias("_y"))
    status = F.when(F.col("_y").isNull(), "MISSING").when(F.col("_x").isNull(), "UNEXPECTED").when(~F.col("_a").eqNullSafe(F.col("_b")), "MISMATCH")
    return a.join(b, key, "full").select(key, status.alias("status")).where("status IS NOT NULL")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old with the rows of new added, which replace those of equal key."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def latest_by_source(parts: list[DataFrame], key: str) -> DataFrame:
    """Union of parts with one row for each key: that of the last part which has it (keys unique within a part)."""
    both = None
    for i, p in enumerate(parts):
        one = p.withColumn("_from", F.lit(i))
        both = one if both is None else both.unionByName(one)
    w = Window.partitionBy(key).orderBy(F.desc("_from"))
    return both.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_from")


def content_dedup(docs: DataFrame, text: str, id_col: str) -> DataFrame:
    """(checksum, keeper, copies): each distinct content with its smallest id; only digests are shuffled."""
    return docs.select(F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("checksum"), id_col).groupBy("checksum").agg(F.min(id_col).alias("keeper"), F.count(F.lit(1)).alias("copies"))


def profile(df: DataFrame) -> DataFrame:
    """(column, n, blanks, numeric): rows, blank or null values and numeric values of each column, in one pass."""
    text = {c: F.trim(F.col(c).cast("string")) for c, t in df.dtypes if not t.startswith(("array", "map", "struct"))}
    aggs = [a for c, x in text.items() for a in (F.count_if(x.isNull() | (x == "")).alias(f"{c}_blank"), F.count_if(x.rlike("^[+-]?[0-9]+(\\.[0-9]+)?([eE][+-]?[0-9]+)?$")).alias(f"{c}_num"))]
    one = df.agg(F.count(F.lit(1)).alias("_n"), *aggs)
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col("_n").alias("n"), F.col(f"{c}_blank").alias("blanks"), F.col(f"{c}_num").alias("numeric")) for c in text])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def temporal_leaks(spans: DataFrame, group: str, split: str, start: str, end: str) -> DataFrame:
    """Groups whose development data do not all end before their evaluation data start (an aggregate, not an interval self-join)."""
    g = spans.groupBy(group).agg(F.max(F.when(F.col(split) == "dev", F.col(end))).alias("dev_end"), F.min(F.when(F.col(split) == "eval", F.col(start))).alias("eval_start"))
    return g.where("dev_end >= eval_start").select(group)
