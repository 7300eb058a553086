"""Claims against sentences that speak of the same things, and the bearing domain's decision policy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orebed.operators.claims import dates, numbers
from orebed.operators.diagnosis import clip, ladder
from orebed.operators.longseries import settled

# Words that anchor nothing, and comparisons with limits.
STOP = ("a", "an", "the", "is", "was", "were", "are", "be", "been", "being", "of", "to", "in", "on", "at", "for", "from", "by", "with", "and", "or", "that", "this", "it", "its", "as", "has", "have", "had", "will", "would", "percent", "thousand", "million", "billion", "crore", "lakh", "bn", "mn")
COMPARISON = r"(?i)\b(?:within|outside|above|below|exceeds?|higher|lower)\b.{0,100}\b(?:range|band|threshold|limit)\b"
FATAL_QUALITY = ("nan_or_inf", "too_short", "invalid_sampling_rate", "no_finite_samples", "possible_clipping", "severe_clipping")
COMPONENTS = {"BPFO": "outer_race", "BPFI": "inner_race", "BSF": "rolling_element", "FTF": "cage"}


def anchors(text: Column) -> Column:
    """The words of a text that tell what it speaks of, none twice: values, stop words and words of under three letters are left out."""
    plain = F.regexp_replace(F.lower(text), r"[0-9]+(?:[.,:/-][0-9]+)*", " ")
    return F.array_distinct(F.filter(F.regexp_extract_all(plain, F.lit(r"([a-z][a-z'-]*)"), F.lit(1)), lambda w: (F.length(w) > 2) & ~w.isin(*STOP)))


def anchored_verdict(claims: DataFrame, evidence: DataFrame, key: str, claim: str = "claim", text: str = "text", order: str = "sentence", least: float = 0.45, confidence: float = 0.98) -> DataFrame:
    """(key, claim, status, confidence, method, evidence): each claim's dates, or else its numbers, against the sentences of its key that share `least` of its anchors.

    A sentence with all of the values supports the claim; one with other values only is a candidate for a conflict, which stays UNKNOWN for a later judge; of several the best anchored one is taken, the
    first of equals. Comparisons with limits need both values and stay open. Claims (key, claim, text) meet sentences (key, order, text) by anchor words, so pairs without a common word are never made; a claim without anchors meets none.
    Claims are parsed once; sentences are parsed for dates and numbers where they have met a claim; before, only those without a digit, which have neither, are left out.
    """
    t = F.col(text)
    stated = settled(claims.select(key, claim, anchors(t).alias("_a"), dates(t).alias("_d"), numbers(t).alias("_v"), F.coalesce(t.rlike(COMPARISON), F.lit(False)).alias("_cmp")))
    open_ = stated.where(~F.col("_cmp") & ((F.size("_d") > 0) | (F.size("_v") > 0)))
    said = evidence.select(key, order, F.col(text).alias("_s")).where(F.col("_s").rlike("[0-9]"))
    words = said.select(key, order, F.explode(anchors(F.col("_s"))).alias("_w"))
    shared = stated.select(key, claim, F.size("_a").alias("_n"), F.explode("_a").alias("_w")).join(words, [key, "_w"]).groupBy(key, claim, order, "_n").agg((F.count(F.lit(1)) / F.col("_n")).alias("_share")).where(F.col("_share") >= least)
    met = shared.join(open_.select(key, claim, "_d", "_v"), [key, claim]).join(said, [key, order]).withColumns({"_sd": dates(F.col("_s")), "_sv": numbers(F.col("_s"))})
    dated = F.size("_d") > 0
    has = F.when(dated, F.size(F.array_except("_d", "_sd")) == 0).otherwise(F.size(F.array_except("_v", "_sv")) == 0)
    apart = F.when(dated, (F.size("_sd") > 0) & ~F.arrays_overlap("_d", "_sd")).otherwise((F.size("_sv") > 0) & ~F.arrays_overlap("_v", "_sv"))
    ranked = met.withColumn("_kind", F.when(has, 2).when(apart, 1))
    first = Window.partitionBy(key, claim).orderBy(F.desc("_kind"), F.desc("_share"), order)
    best = ranked.withColumn("_r", F.row_number().over(first)).where("_r = 1 AND _kind IS NOT NULL").select(key, claim, "_kind", F.col("_s").alias("evidence"))
    out = stated.join(best, [key, claim], "left")
    kind = F.when(F.size("_d") > 0, "date").when(F.size("_v") > 0, "numeric")
    method = F.when(F.col("_cmp"), "comparison_requires_context").when(kind.isNull(), "unresolved").otherwise(F.concat(kind, F.when(F.col("_kind") == 2, "_exact").when(F.col("_kind") == 1, "_conflict_candidate").otherwise("_unresolved")))
    ok = F.coalesce(F.col("_kind") == 2, F.lit(False))
    return out.select(key, claim, F.when(ok, "SUPPORTED").otherwise("UNKNOWN").alias("status"), F.when(ok, confidence).otherwise(0.0).alias("confidence"), method.alias("method"), "evidence")


def bearing_policy(df: DataFrame, ids: list[str], least_confidence: float = 0.45, least_harmonics: int = 2) -> DataFrame:
    """(ids, decision, abnormal, score, confidence, uncertainty, component, abstain_reason) from a bearing's evidence.

    Columns: quality_flags (array), kurtosis, crest, band (whether a resonance band was found), frequencies (whether fault frequencies are known), best_fault and harmonics of the first in the ranking (null if it is empty), and of the
    fusion strength, separation, fused_confidence, label and fused_reason. Bad signals, missing bands and missing frequencies abstain in this order, then too few harmonics and too little confidence; without frequencies impulsiveness alone still tells whether something is abnormal.
    """
    of = lambda c, d: F.coalesce(F.col(c), F.lit(d))
    impulsive = clip(F.greatest(of("kurtosis", 3.0) - 3.0, F.lit(0.0)) / 7.0, 0.0, 1.0)
    stage = ladder(
        "fused",
        (F.arrays_overlap(F.coalesce("quality_flags", F.array().cast("array<string>")), F.array(*[F.lit(f) for f in FATAL_QUALITY])), "signal_quality"),
        (~F.coalesce(F.col("band"), F.lit(False)), "no_resonance_band"),
        (~F.coalesce(F.col("frequencies"), F.lit(False)), "no_fault_frequencies"),
    )
    rows = df.withColumn("_stage", stage)
    fused = F.col("_stage") == "fused"
    reason = F.when(~fused, F.col("_stage")).when(F.col("best_fault").isNotNull() & (of("harmonics", 0) < least_harmonics), "too_few_harmonics").when(F.col("fused_reason").isNotNull(), F.col("fused_reason")).when(of("fused_confidence", 0.0) < least_confidence, "low_confidence")
    score = F.when(fused, clip(F.greatest(of("strength", 0.0), impulsive), 0.0, 1.0)).when(F.col("_stage") == "no_fault_frequencies", impulsive)
    rows = rows.withColumns({"abstain_reason": reason, "score": score})
    abnormal = F.when(fused, F.col("score") >= 0.35).when(F.col("_stage") == "no_fault_frequencies", (of("kurtosis", 0.0) > 3.5) | (of("crest", 0.0) > 4.0))
    sure = F.when(fused, of("fused_confidence", 0.0)).otherwise(F.create_map(*[F.lit(x) for pair in (("signal_quality", 0.0), ("no_resonance_band", 0.1), ("no_fault_frequencies", 0.2)) for x in pair])[F.col("_stage")])
    named = F.create_map(*[F.lit(x) for pair in COMPONENTS.items() for x in pair])[F.upper("label")]
    component = F.when(F.col("abstain_reason").isNull(), F.coalesce(named, F.lower("label")))
    return rows.select(*ids, F.when(F.col("abstain_reason").isNull(), "diagnose").otherwise("abstain").alias("decision"), abnormal.alias("abnormal"), "score", sure.alias("confidence"), F.when(fused & F.col("best_fault").isNotNull(), 1 - clip(of("separation", 0.0), 0.0, 1.0)).alias("uncertainty"), component.alias("component"), "abstain_reason")


def battery_verdict(cells: DataFrame, decisions: DataFrame, unit: str, cell: str = "cell") -> DataFrame:
    """(unit, status, bounds_hold, dominant_cell): whether physics bears out each unit's decision (unit, top_cell, abnormal).

    cells (unit, cell, voltage, temperature, delta_voltage, delta_temperature) are readings with their distances from the pack. Readings outside 1.5 .. 5.5 V or -50 .. 120 degrees contradict. An anomaly is
    supported if the cell with the largest median distance, in shares of the largest of each kind, is the one that was named (the first of equals, by name).
    """
    inside = F.col("voltage").between(1.5, 5.5) & F.col("temperature").between(-50.0, 120.0)
    each = cells.groupBy(unit, cell).agg(F.bool_and(F.coalesce(inside, F.lit(False))).alias("_in"), F.median(F.abs("delta_voltage")).alias("_v"), F.median(F.abs("delta_temperature")).alias("_t"))
    top = Window.partitionBy(unit)
    share = F.greatest(*[F.coalesce(F.col(c), F.lit(0.0)) / F.greatest(F.max(c).over(top), F.lit(1e-12)) for c in ("_v", "_t")])
    best = each.withColumn("_share", F.round(share, 9)).groupBy(unit).agg(F.bool_and("_in").alias("bounds_hold"), F.min_by(cell, F.struct((-F.col("_share")).alias("s"), F.col(cell).alias("c"))).alias("dominant_cell"))
    out = decisions.join(best, unit)
    status = ladder("INSUFFICIENT", (~F.col("bounds_hold"), "CONTRADICTED"), (F.col("abnormal") & (F.col("dominant_cell") == F.col("top_cell")), "SUPPORTED"))
    return out.select(unit, status.alias("status"), "bounds_hold", "dominant_cell")


def turbofan_verdict(health: DataFrame, decisions: DataFrame, unit: str) -> DataFrame:
    """(unit, status, correlation): a negative life contradicts; a degraded state is supported by a rising health index that goes with the cycles (correlation over .25).

    health (unit, cycle, health); decisions (unit, slope, rul, abnormal), rul null where there is none.
    """
    r = health.groupBy(unit).agg(F.count("health").alias("_n"), F.stddev_pop("health").alias("_s"), F.try_divide(F.covar_pop("cycle", "health"), F.stddev_pop("cycle") * F.stddev_pop("health")).alias("_r"))
    out = decisions.join(r, unit).withColumn("correlation", F.when((F.col("_n") > 2) & (F.col("_s") > 1e-12), F.coalesce("_r", F.lit(0.0))).otherwise(0.0))
    status = ladder("INSUFFICIENT", (F.col("rul") < 0, "CONTRADICTED"), (F.col("abnormal") & (F.col("slope") > 0) & (F.col("correlation") > 0.25), "SUPPORTED"))
    return out.select(unit, status.alias("status"), "correlation")


def transformer_verdict(df: DataFrame, ids: list[str], threshold: float = 0.25) -> DataFrame:
    """(ids, status, several_sensors): a class without an anomaly contradicts; an anomaly is supported by impulsive structure in two sensors or more (all, if there are fewer).

    Columns: anomaly_score, kurtosis, weights and deviations (arrays, one for each sensor), label (null where none was given), abnormal.
    """
    at_least_two = lambda a, c: F.size(F.filter(a, c)) >= F.least(F.lit(2), F.size(a))
    several = at_least_two("deviations", lambda s: s > 1e-9) & at_least_two("weights", lambda w: w > 0.05)
    rows = df.withColumn("several_sensors", several)
    signal = (F.col("anomaly_score") >= threshold) & (F.col("kurtosis") > 3)
    status = ladder("INSUFFICIENT", (F.col("label").isNotNull() & ~F.col("abnormal"), "CONTRADICTED"), (F.col("abnormal") & signal & F.col("several_sensors"), "SUPPORTED"))
    return rows.select(*ids, status.alias("status"), "several_sensors")
