"""Evidence that a claim has to be held against: what it cites, what shares its words, and which ranges may conflict with one that it states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orebed.operators.longseries import few
from orebed.operators.risk import found, sentences

# Citations, words that tell nothing, words of history, quantities and units, and the form of a claim that states a normal range and nothing else.
CITED = "\\[([A-Za-z0-9][A-Za-z0-9:_-]{2,127})\\]"
COMMON = "and are as at been for from has have into its per that the their these this those was were with".split()
HISTORY = "(?i)\\b(?:historical|superseded|archived|formerly|previous|obsolete)\\b"
QUANTITY, UNIT = "discharge\\s+pressure|pressure|vibration|temperature|speed|load", "(?:bar|mm/s(?:\\s+RMS)?|rpm|percent|%|°?C)"
LITERAL = f"(?i)^[A-Za-z]+-[0-9]+\\s+(?:current\\s+)?normal\\s+(?:{QUANTITY})\\s+(?:is|was)\\s+[0-9]+(?:\\.[0-9]+)?\\s+to\\s+[0-9]+(?:\\.[0-9]+)?\\s*{UNIT}\\.?$"
VALUE = f"[0-9]+(?:\\.[0-9]+)?\\s*{UNIT}(?=\\W|$)"
BAND = f"[0-9]+(?:\\.[0-9]+)?\\s*(?:to|[-–])\\s*{VALUE}"
#: Pairs of a case that are all made.
TOGETHER = 10_000
EDGES = ".,:;()[]{}\"'"


def terms(text: Column) -> Column:
    """The distinct words of three characters or more that tell something, without what stands at their edges."""
    bare = F.transform(F.split(F.lower(text), "\\s+"), lambda w: F.btrim(w, F.lit(EDGES)))
    return F.array_distinct(F.filter(bare, lambda w: (F.length(w) >= 3) & ~w.isin(COMMON)))


def competes(text: Column, topic: Column) -> Column:
    """Whether a text may conflict with a range of a quantity: it speaks of it in a range, or without any value; single readings are another relation."""
    word = lambda x: F.concat(F.lit("(?i)\\b"), x, F.lit("\\b"))
    about = F.filter(sentences(text), lambda s: F.regexp_like(s, word(topic)))
    band = F.exists(about, lambda s: s.rlike(f"(?i){BAND}"))
    return F.regexp_like(text, word(F.element_at(F.split(topic, "\\s+"), -1))) & (band | ~F.exists(about, lambda s: s.rlike(f"(?i){VALUE}")))


def _together(c: DataFrame, e: DataFrame, case: str) -> DataFrame:
    """Pairs of claims and items that share a term or an id, met by case."""
    met = c.join(e.withColumn("_words", terms(F.col("_text"))), case)
    met = met.withColumns({"_shared": F.size(F.array_intersect("_terms", "_words")).cast("long"), "cited": F.coalesce(F.array_contains("_ids", F.col("_id")), F.lit(False)) | F.coalesce(F.array_contains("_ids", F.col("_doc")), F.lit(False))})
    return met.where((F.col("_shared") > 0) | F.col("cited")).drop("_terms", "_ids", "_words")


def _apart(c: DataFrame, e: DataFrame, case: str) -> DataFrame:
    """Pairs of claims and items that share a term or an id, met by it."""
    shared = c.select(case, "claim", F.explode("_terms").alias("_t")).join(e.select(case, "item", F.explode(terms(F.col("_text"))).alias("_t")), [case, "_t"]).groupBy(case, "claim", "item").agg(F.count(F.lit(1)).alias("_shared"))
    ids = e.select(case, "item", F.explode(F.array_distinct(F.array("_id", "_doc"))).alias("_t"))
    cited = c.select(case, "claim", F.explode("_ids").alias("_t")).join(ids, [case, "_t"]).select(case, "claim", "item").distinct().withColumn("_cited", F.lit(True))
    pairs = shared.join(cited, [case, "claim", "item"], "full").withColumns({"_shared": F.coalesce("_shared", F.lit(0)), "cited": F.coalesce("_cited", F.lit(False))}).drop("_cited")
    return pairs.join(c.drop("_terms", "_ids"), [case, "claim"]).join(e, [case, "item"])


def claim_evidence(claims: DataFrame, items: DataFrame, case: str, top: int = 3, least: float = 0.05) -> DataFrame:
    """(case, claim, place, item, cited, score, omitted): the top items of each claim: cited ones, then by the share of its terms, then by their own score, ties by item.

    claims: case, claim, text. items: case, item, document, text, status, own score. An item is cited by its id or its document's. Uncited ones are out if
    they share fewer than two terms (one, where the claim has two or fewer) or under least, if superseded (unless the claim speaks of history), and, for
    a claim that states a normal range and nothing else, if draft or unverified or no competing range. omitted counts distinct texts beyond top that no chosen item has.
    In a case of TOGETHER pairs at most, claims and items meet by case; in larger ones by (case, term) and (case, id), never all of them. Ids tell rows apart. Null texts have no terms, null statuses are current,
    null scores are 0. A claim without evidence has no row.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    bare = F.trim(F.regexp_replace(text, CITED, ""))
    c = claims.select(case, "claim", text.alias("_claim"), F.rtrim(F.regexp_replace(bare, "\\.+$", "")).alias("_bare"), terms(F.regexp_replace(text, CITED, " ")).alias("_terms"))
    topic = F.get(found(F.col("_claim"), f"(?i)\\b(?:{QUANTITY})\\b"), F.lit(0))
    c = c.select(case, "claim", "_terms", F.size("_terms").alias("_n"), F.array_distinct(F.regexp_extract_all("_claim", F.lit(CITED), F.lit(1))).alias("_ids"), F.col("_claim").rlike(HISTORY).alias("_past"), F.col("_bare").rlike(LITERAL).alias("_literal"), topic.alias("_topic"))
    e = items.select(case, "item", F.col("item").cast("string").alias("_id"), F.col("document").cast("string").alias("_doc"), F.trim(text).alias("_text"), F.lower(F.coalesce("status", F.lit(""))).alias("_status"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("_own"))
    sizes = c.groupBy(case).agg(F.count(F.lit(1)).alias("_c")).join(e.groupBy(case).agg(F.count(F.lit(1)).alias("_e")), case)
    large = few(sizes.where(F.col("_c") * F.col("_e") > TOGETHER).select(case))
    if large.isEmpty():
        rows = _together(c, e, case)
    else:
        rows = _together(c.join(large, case, "left_anti"), e.join(large, case, "left_anti"), case).unionByName(_apart(c.join(large, case, "left_semi"), e.join(large, case, "left_semi"), case))
    rows = rows.withColumn("_share", F.col("_shared") / F.greatest(F.lit(1), F.col("_n")))
    enough = (F.col("_shared") >= F.when(F.col("_n") <= 2, 1).otherwise(2)) & (F.col("_share") >= least)
    current = (F.col("_status") != "superseded") | F.col("_past")
    rival = ~F.col("_literal") | (~F.col("_status").isin("draft", "unverified") & competes(F.col("_text"), F.col("_topic")))
    rows = rows.where(F.col("cited") | (enough & current & rival))
    order = Window.partitionBy(case, "claim").orderBy(F.desc("cited"), F.desc("_share"), F.desc("_own"), "item")
    rows = rows.select(case, "claim", "item", "cited", F.when(F.col("cited"), 1.0).otherwise(F.least(F.lit(0.99), F.col("_share"))).alias("score"), F.sha2("_text", 256).alias("_text"), F.row_number().over(order).cast("long").alias("place"))
    first = F.min("place").over(Window.partitionBy(case, "claim", "_text"))
    rows = rows.withColumn("_first", first).withColumn("omitted", F.count_if((F.col("_first") > top) & (F.col("place") == F.col("_first"))).over(Window.partitionBy(case, "claim")))
    return rows.where(F.col("place") <= top).select(case, "claim", "place", "item", "cited", "score", "omitted")
