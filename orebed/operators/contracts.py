"""Contracts, access and reference data: violations, decisions by ladder, resolution of names, and records put together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orebed.operators.diagnosis import clip, ladder


def violations(df: DataFrame, key: list[str], checks: dict[str, Column]) -> DataFrame:
    """(key, rule) of each row that breaks a rule; checks say when it does (null: it doesn't). One pass, however many rules."""
    found = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks.items()]), lambda r: r.isNotNull())
    return df.select(*key, F.explode(found).alias("rule"))


def time_contract(df: DataFrame, keys: list[str], order: str, ts: Column, rate: float, reference_end: Column) -> DataFrame:
    """Per key: steps that don't move forward, whether the span covers the samples at rate, and whether reference precedes all readings."""
    w = Window.partitionBy(*keys).orderBy(order)
    g = df.withColumn("_t", ts).withColumn("_d", F.col("_t") - F.lag("_t").over(w))
    g = g.groupBy(*keys).agg(F.count_if(F.col("_d") <= 0).alias("backward"), (F.max("_t") - F.min("_t") >= (F.count(F.lit(1)) - 1) / rate).alias("covered"), (reference_end < F.min("_t")).alias("reference_first"))
    return g


def identity_profile(df: DataFrame, keys: list[str], channel: str, unit: str) -> DataFrame:
    """Per key: digest of its channels and units in order, so that inputs of one shape meet by an equal join."""
    pairs = df.select(*keys, F.concat_ws("=", channel, unit).alias("_p")).distinct()
    return pairs.groupBy(*keys).agg(F.sha2(F.concat_ws(",", F.array_sort(F.collect_list("_p"))), 256).alias("profile"))  # the channels of one input


def set_difference(actual: DataFrame, declared: DataFrame, key: str) -> DataFrame:
    """(key, side): members of only one of two sets, MISSING from actual or UNDECLARED."""
    a, d = actual.select(key).distinct(), declared.select(key).distinct()
    return d.join(a, key, "left_anti").withColumn("side", F.lit("MISSING")).unionByName(a.join(d, key, "left_anti").withColumn("side", F.lit("UNDECLARED")))


def pack_faults(tables: dict[str, DataFrame], ids: dict[str, str], references: list[tuple[str, str, str]]) -> DataFrame:
    """(fault, entity, id): DUPLICATE ids of each table, and DANGLING references (table, column, referred table), nulls aside."""
    out = None
    for name, df in tables.items():
        part = df.groupBy(F.col(ids[name]).alias("id")).count().where("count > 1").select(F.lit("DUPLICATE").alias("fault"), F.lit(name).alias("entity"), F.col("id").cast("string").alias("id"))
        out = part if out is None else out.unionByName(part)
    for name, column, to in references:
        keys = tables[to].select(F.col(ids[to]).alias("id")).distinct()
        part = tables[name].where(F.col(column).isNotNull()).select(F.col(column).alias("id")).distinct().join(keys, "id", "left_anti")
        out = out.unionByName(part.select(F.lit("DANGLING").alias("fault"), F.lit(f"{name}.{column}").alias("entity"), F.col("id").cast("string").alias("id")))
    return out


def scopes_overlap(requested: Column, own: Column, default: str = "internal") -> Column:
    """Whether two lists of scopes share one, trimmed and lower-cased; a record without any has the default one."""
    clean = lambda a: F.transform(a, lambda s: F.lower(F.trim(s)))
    return F.arrays_overlap(clean(requested), F.when(F.coalesce(F.size(own), F.lit(0)) > 0, clean(own)).otherwise(F.array(F.lit(default))))


def access_reason(who: dict[str, Column], what: dict[str, Column]) -> Column:
    """The reason code of the first rule that denies, or ACCESS_ALLOWED.

    who: permitted, org, clearance, workspace, department, id; what: org, classification, workspace, department, owner, users (array). Nulls deny, but for a department and a list of users, which may be absent.
    """
    no = lambda c: ~F.coalesce(c, F.lit(False))
    granted = F.coalesce(F.array_contains(what["users"], who["id"]), F.lit(False)) | F.coalesce(what["owner"] == who["id"], F.lit(False))
    near = what["department"].isNull() | F.coalesce(what["department"] == who["department"], F.lit(False)) | granted
    return ladder(
        "ACCESS_ALLOWED",
        (no(who["permitted"]), "ACCESS_DENIED"),
        (no((what["org"] == who["org"]) | (who["org"] == "*")), "ACCESS_DENIED"),
        (no(who["clearance"] >= what["classification"]), "INSUFFICIENT_CLEARANCE"),
        (no((what["workspace"] == who["workspace"]) | (who["workspace"] == "*")), "WORKSPACE_SCOPE_MISMATCH"),
        (~near, "DEPARTMENT_SCOPE_MISMATCH"),
        ((F.coalesce(F.size(what["users"]), F.lit(0)) > 0) & ~granted, "ACCESS_DENIED"),
    )


def resolved(references: DataFrame, catalog: DataFrame, ref: str, name: str, id_col: str, may_read: str) -> DataFrame:
    """(ref, status, id): exact names, case aside: NOT_FOUND, DENIED, AMBIGUOUS or RESOLVED with the one readable id."""
    known = catalog.select(F.lower(name).alias("_k"), id_col, may_read).distinct()
    g = references.select(ref).distinct().join(known, F.lower(ref) == F.col("_k"), "left").groupBy(ref).agg(F.count(id_col).alias("_all"), F.count_if(F.col(may_read)).alias("_may"), F.min(F.when(F.col(may_read), F.col(id_col))).alias("_id"))
    status = ladder("RESOLVED", (F.col("_all") == 0, "NOT_FOUND"), (F.col("_may") == 0, "DENIED"), (F.col("_may") > 1, "AMBIGUOUS"))
    return g.withColumn("status", status).select(ref, "status", F.when(F.col("status") == "RESOLVED", F.col("_id")).alias(id_col))


def resolved_entities(names: DataFrame, labels: DataFrame, key: str, name: str, label: str, id_col: str, fallback: int, most: int = 3) -> DataFrame:
    """(key, id): each key's names looked up by label, case aside, most for each name, smallest ids first; keys without a hit get fallback."""
    few = labels.select(F.lower(label).alias("_l"), id_col).withColumn("_r", F.row_number().over(Window.partitionBy("_l").orderBy(id_col))).where(F.col("_r") <= most)
    hits = names.select(key, F.lower(name).alias("_l")).distinct().join(few, "_l").select(key, id_col).distinct()
    none = names.select(key).distinct().join(hits, key, "left_anti").select(key, F.lit(fallback).cast(labels.schema[id_col].dataType).alias(id_col))
    return hits.unionByName(none)


def nested_evidence(links: DataFrame, claims: DataFrame, chunk: str, claim: str, payload: list[str], most: int) -> DataFrame:
    """(chunk, evidence): each chunk's first most claims as an array of structs in claim order."""
    j = links.join(claims, claim).withColumn("_r", F.row_number().over(Window.partitionBy(chunk).orderBy(claim))).where(F.col("_r") <= most)
    return j.groupBy(chunk).agg(F.array_sort(F.collect_list(F.struct(claim, *payload))).alias("evidence"))


def linked_or_first(claims: DataFrame, links: DataFrame, chunks: DataFrame, claim: str, group: str, chunk: str, most: int = 3) -> DataFrame:
    """(claim, chunk, linked): a claim's linked chunks, or the first most of its group where it has none."""
    own = claims.select(claim).join(links, claim).select(claim, chunk, F.lit(True).alias("linked"))
    first = chunks.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(chunk))).where(F.col("_r") <= most).select(group, chunk)
    rest = claims.join(links.select(claim).distinct(), claim, "left_anti").join(first, group).select(claim, chunk, F.lit(False).alias("linked"))
    return own.unionByName(rest)


def catalog_match(units: DataFrame, catalog: DataFrame, unit: str) -> DataFrame:
    """(unit, pattern, score): the best of a few patterns (root, affected) for a unit's (root, affected): .6 for an equal root, .4 for the share of the pattern's set."""
    share = F.size(F.array_intersect("affected", "_affected")) / F.greatest(F.size("_affected"), F.lit(1))
    score = F.when(F.col("root") == F.col("_root"), 0.6).otherwise(0.0) + 0.4 * share
    few = F.broadcast(catalog.select("pattern", F.col("root").alias("_root"), F.col("affected").alias("_affected")))  # a static catalogue
    j = units.join(few).withColumn("score", score)
    return j.groupBy(unit).agg(F.max_by(F.struct("pattern", "score"), F.struct(F.round("score", 9), (-F.col("pattern")).alias("p"))).alias("_b")).select(unit, "_b.pattern", "_b.score")


def superseded_claims(asserted: DataFrame, records: DataFrame, key: str, family: str, value: str) -> DataFrame:
    """(key): asserted values that only superseded records of the family have; where a current one says so too they stand."""
    old = records.where("NOT current").select(family, value).distinct()
    now = records.where("current").select(family, value).distinct()
    return asserted.join(old, [family, value], "left_semi").join(now, [family, value], "left_anti").select(key)


def split_units(df: DataFrame, keys: list[str], asset: str, ts: Column) -> DataFrame:
    """Per unit: time bounds, its assets and a digest of all three."""
    g = df.groupBy(*keys).agg(F.min(ts).alias("start"), F.max(ts).alias("end"), F.array_sort(F.collect_set(F.col(asset).cast("string"))).alias("_a"))
    return g.select(*keys, "start", "end", F.size("_a").alias("n_assets"), F.sha2(F.concat_ws("|", *keys, F.concat_ws(",", "_a")), 256).alias("checksum"))


def asset_context(latest: DataFrame, trends: DataFrame, rules: DataFrame, keys: list[str], most: int = 8) -> DataFrame:
    """Per asset and metric: latest value, slope and whether it keeps the metric's rule; the first most metrics of an asset that break or move most."""
    j = latest.join(trends, keys, "left").join(F.broadcast(rules), keys[1], "left")  # a rule for each metric
    j = j.withColumn("within", F.col("value").between(F.col("low"), F.col("high")))
    w = Window.partitionBy(keys[0]).orderBy(F.coalesce("within", F.lit(True)), F.desc(F.round(F.abs("slope"), 9)), keys[1])
    return j.withColumn("place", F.row_number().over(w).cast("long")).where(F.col("place") <= most)


def tallies(df: DataFrame, expected: str, actual: str, group: str) -> DataFrame:
    """Per group: cases, matches, and what was expected but didn't come, and the other way round."""
    e, a = F.col(expected), F.col(actual)
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("cases"), F.count_if(e.eqNullSafe(a)).alias("matched"), F.count_if(e.isNotNull() & ~e.eqNullSafe(a)).alias("missed"), F.count_if(a.isNotNull() & ~e.eqNullSafe(a)).alias("unexpected"))


def timing_rollup(df: DataFrame, key: str, stages: str) -> DataFrame:
    """Per key: calls and seconds of each stage, from an array of (name, seconds)."""
    return df.select(key, F.explode(stages).alias("s")).groupBy(key, F.col("s.name").alias("stage")).agg(F.count(F.lit(1)).alias("calls"), F.sum("s.seconds").alias("seconds"))


def agreement(samples: DataFrame, claim: str, source: str, value: str) -> DataFrame:
    """(claim, agreement): share of pairs of a claim's samples that agree, from counts of each value (no pairs are made); null for one sample."""
    n = samples.groupBy(claim, value).agg(F.count_distinct(source).alias("_c")).groupBy(claim).agg(F.sum("_c").alias("_n"), F.sum(F.col("_c") * (F.col("_c") - 1)).alias("_p"))
    return n.select(claim, F.when(F.col("_n") > 1, F.col("_p") / (F.col("_n") * (F.col("_n") - 1))).alias("agreement"))


def compared(df: DataFrame, component: str, record: str, score: str, baseline: str) -> DataFrame:
    """Per component: mean score, and wins and losses against the baseline component on the same records."""
    base = df.where(F.col(component) == baseline).select(record, F.col(score).alias("_b"))
    return df.join(base, record).groupBy(component).agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean"), F.count_if(F.col(score) > F.col("_b")).alias("wins"), F.count_if(F.col(score) < F.col("_b")).alias("losses"))


def span_recall(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Per key: expected spans (start, end), and how many any found span of the key overlaps."""
    e = expected.select(key, F.col("start").alias("_s"), F.col("end").alias("_e")).distinct()
    hit = e.join(found.select(key, "start", "end"), key).where((F.col("start") < F.col("_e")) & (F.col("_s") < F.col("end"))).select(key, "_s", "_e").distinct().groupBy(key).agg(F.count(F.lit(1)).alias("hit"))
    return e.groupBy(key).agg(F.count(F.lit(1)).alias("spans")).join(hit, key, "left").select(key, "spans", F.coalesce("hit", F.lit(0)).cast("long").alias("hit"))


def standard_result(df: DataFrame, decision: str, confidence: str, reason: str) -> DataFrame:
    """df with confidence held in 0 to 1 and issue: OUT_OF_RANGE, ABSTAINED_WITHOUT_REASON, REASON_WITHOUT_ABSTENTION or null."""
    c, d, r = F.col(confidence), F.col(decision), F.col(reason)
    issue = ladder(None, (c.isNull() | (c < 0) | (c > 1), "OUT_OF_RANGE"), ((d == "abstain") & r.isNull(), "ABSTAINED_WITHOUT_REASON"), ((d != "abstain") & r.isNotNull(), "REASON_WITHOUT_ABSTENTION"))
    return df.withColumn("issue", issue).withColumn(confidence, clip(F.coalesce(c, F.lit(0.0)), 0.0, 1.0))


def domain_decision(domain: Column, flags: dict[str, Column]) -> Column:
    """diagnose, early_action, monitor or abstain of a domain's policy.

    flags: detected, reason (why it must abstain), warning, metadata. A reason rules; bearings without fault metadata abstain, process alarms that
    only warn ask for early action.
    """
    detected, warned, known = flags["detected"], flags["warning"], flags["metadata"]
    return ladder("monitor", (flags["reason"].isNotNull(), "abstain"), ((domain == "bearing") & ~known, "abstain"), (detected, "diagnose"), ((domain == "process") & warned, "early_action"))
