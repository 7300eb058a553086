"""Claims: facts in prose, verification by values and by scores, remediation, selection of evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orebed.functions.text import MULTIPLIERS
from orebed.operators.diagnosis import clip, ladder
from orebed.operators.longseries import settled

# Shapes of numbers, dates and names, and the words that are no names.
NUMBER = "(?i)(?:^|[^\\w-])((?:[$€£₹]\\s*)?[+-]?(?:[0-9]{1,3}(?:,[0-9]{3})+|[0-9]+)(?:\\.[0-9]+)?(?:\\s*(?:%|(?:percent|bn|billion|mn|million|m|k|thousand|crore|lakh)\\b)|\\b))"
MONTH = "(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sep(?:t(?:ember)?)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
DATE = f"(?i)\\b(?:{MONTH}\\s+[0-9]{{1,2}}(?:st|nd|rd|th)?,?\\s+(?:18|19|20|21)[0-9]{{2}}|[0-9]{{1,2}}(?:st|nd|rd|th)?\\s+{MONTH}\\s+(?:18|19|20|21)[0-9]{{2}}|(?:18|19|20|21)[0-9]{{2}}[-/][0-9]{{1,2}}[-/][0-9]{{1,2}})\\b"
NAME = "(?:^|[^A-Za-z0-9_])([A-Z][a-z]+(?:\\s+[A-Z][a-z]+){0,4}|[A-Z]{2,}(?:\\s+[A-Z]{2,})*)(?:$|[^A-Za-z0-9_])"
NOT_NAMES = ("a", "an", "how", "i", "it", "its", "our", "she", "that", "the", "their", "there", "these", "they", "this", "those", "we", "what", "when", "where", "which", "who", "why", "you", "your")
#: Rows of ranges and of queries' terms that are broadcast at most, and claims of a task.
SENT, PART_CLAIMS = 200_000, 10_000
RANGE_FACT = "(?i)^([A-Za-z]+-[0-9]+) ([a-z ]+?) normal range is ([0-9.]+) to ([0-9.]+) ([a-z/]+)$"


def numbers(text: Column) -> Column:
    """array<struct<value, kind>>: numbers in prose, none twice; digits that belong to an identifier are none."""
    raw = F.transform(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(1)), lambda r: F.regexp_replace(F.lower(F.trim(r)), ",", ""))
    factor = F.create_map(*[x for k, v in MULTIPLIERS.items() for x in (F.lit(k), F.lit(v))])

    def one(r: Column) -> Column:
        unit = F.regexp_extract(r, "(thousand|million|billion|crore|lakh|bn|mn|k|m)$", 1)
        value = F.regexp_extract(r, "([+-]?[0-9]+(?:\\.[0-9]+)?)", 1).cast("double") * F.coalesce(factor[unit], F.lit(1.0))
        kind = F.when(r.rlike("(%|percent)$"), "percent").when(r.rlike("^[$€£₹]"), "currency").otherwise("number")
        return F.struct(value.alias("value"), kind.alias("kind"))

    return F.array_distinct(F.transform(raw, one))


def dates(text: Column) -> Column:
    """array<date>: written and numeric dates, none twice; what is no day of the calendar is left out."""
    months = F.create_map(*[x for i, m in enumerate(("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"), 1) for x in (F.lit(m), F.lit(i))])

    def one(r: Column) -> Column:
        word = F.lower(F.regexp_extract(r, "([A-Za-z]{3})[A-Za-z]*\\s+[0-9]{1,4}", 1))
        year = F.regexp_extract(r, "((?:18|19|20|21)[0-9]{2})", 1)
        numeric = F.split(F.regexp_replace(r, "/", "-"), "-")
        day = F.regexp_extract(r, "(?:^|[^0-9])([0-9]{1,2})(?:st|nd|rd|th)?(?:,|\\s|$)", 1)
        text_date = F.concat_ws("-", year, F.lpad(months[word].cast("string"), 2, "0"), F.lpad(day, 2, "0"))
        plain = F.concat_ws("-", F.get(numeric, F.lit(0)), F.lpad(F.get(numeric, F.lit(1)), 2, "0"), F.lpad(F.get(numeric, F.lit(2)), 2, "0"))
        return F.when(r.rlike("[A-Za-z]{3}"), text_date).otherwise(plain).try_cast("date")

    found = F.array_distinct(F.filter(F.transform(F.regexp_extract_all(text, F.lit(DATE), F.lit(0)), one), lambda d: d.isNotNull()))
    return F.when(text.isNull() | text.rlike("(?:18|19|20|21)[0-9]{2}"), found).otherwise(F.array().cast("array<date>"))  # every date has a year


def names(text: Column) -> Column:
    """Lower-cased proper names, none twice: runs of capitalised words or of capitals, but for common openers."""
    twice = F.regexp_replace(text, "([^A-Za-z0-9_])", "$1$1")  # so that each name has its own borders
    raw = F.transform(F.regexp_extract_all(twice, F.lit(NAME), F.lit(1)), lambda r: F.lower(F.regexp_replace(r, "\\s+", " ")))
    return F.array_distinct(F.filter(raw, lambda r: (F.length(r) >= 2) & ~r.isin(*NOT_NAMES)))


def claim_texts(text: Column, least: int = 12) -> Column:
    """Atomic statements: sentences and clauses without list marks, of least characters or more."""
    parts = F.split(F.regexp_replace(F.regexp_replace(text, "([.!?])\\s+", "$1\n"), ";\\s*", "\n"), "\n")
    clean = F.transform(parts, lambda p: F.regexp_replace(F.regexp_replace(F.trim(F.regexp_replace(p, "\\s+", " ")), "^(?:[-*•]|[0-9]+[.)])\\s+", ""), "^(?:However|Therefore|Moreover|Also),?\\s+", ""))
    return F.filter(clean, lambda p: F.length(p) >= least)


def claim_type(text: Column) -> Column:
    """CITATION, DATE, NUMERIC, ENTITY, FACTUAL (four words or more) or OTHER, by the first that fits."""
    return ladder("OTHER", (text.rlike("\\[[0-9]+\\]"), "CITATION"), (text.rlike(DATE), "DATE"), (text.rlike(NUMBER), "NUMERIC"), (F.size(names(text)) > 0, "ENTITY"), (F.size(F.split(F.trim(text), "\\s+")) >= 4, "FACTUAL"))


def value_verdict(claims: DataFrame, evidence: DataFrame, key: str, claim: str, confidence: float = 0.98) -> DataFrame:
    """(key, claim, status, confidence): SUPPORTED if one sentence of the key's evidence has all of a claim's values, else UNKNOWN.

    claims: (key, claim, values); evidence: (key, sentence, values). Values are joined one by one, so no sentence is compared with every claim.
    """
    wanted = claims.withColumn("_need", F.size("values")).select(key, claim, "_need", F.explode_outer("values").alias("v"))
    hits = wanted.join(evidence.select(key, "sentence", F.explode("values").alias("v")).distinct(), [key, "v"]).groupBy(key, claim, "_need", "sentence").agg(F.count(F.lit(1)).alias("_have"))
    best = hits.groupBy(key, claim).agg(F.bool_or(F.col("_have") >= F.col("_need")).alias("_ok"))
    out = claims.select(key, claim).join(best, [key, claim], "left")
    ok = F.coalesce("_ok", F.lit(False))
    return out.select(key, claim, F.when(ok, "SUPPORTED").otherwise("UNKNOWN").alias("status"), F.when(ok, confidence).otherwise(0.0).alias("confidence"))


def scored_verdict(scores: DataFrame, claim: str, supports: float = 0.7, contradicts: float = 0.8, conflict: float = 0.6, retrieval: float = 0.35, corroborating: int = 2, margin: float = 0.1) -> DataFrame:
    """(claim, status, confidence) from (claim, evidence, entailment, contradiction, retrieval), by precedence CONFLICTING, CONTRADICTED, SUPPORTED, UNKNOWN.

    Only evidence retrieved well enough contradicts, and only if corroborated: by several or by a cited one.
    """
    near = F.col("retrieval") >= retrieval
    strong = near & (F.col("contradiction") >= contradicts)
    key = lambda c: F.struct(F.col(c), (-F.col("evidence")).alias("e"))
    g = scores.groupBy(claim).agg(
        F.max(key("entailment")).alias("_e"),
        F.max(F.when(near, key("contradiction"))).alias("_c"),
        F.count_if(strong).alias("_n"),
        F.bool_or(strong & (F.col("retrieval") >= 0.999)).alias("_cited"),
        F.max(F.greatest("entailment", "contradiction")).alias("_top"),
    )
    e, c = F.col("_e.entailment"), F.coalesce(F.col("_c.contradiction"), F.lit(0.0))
    other = F.col("_c").isNotNull() & (F.col("_c.e") != F.col("_e.e"))
    backed = (F.col("_n") >= corroborating) | F.col("_cited")
    status = ladder("UNKNOWN", (other & (e >= conflict) & (c >= conflict), "CONFLICTING"), (F.col("_c").isNotNull() & backed & (c >= contradicts) & (c - e >= margin), "CONTRADICTED"), ((e >= supports) & (e - c >= margin), "SUPPORTED"))
    g = g.withColumn("status", status)
    sure = F.when(F.col("status") == "CONFLICTING", F.greatest(e, c)).when(F.col("status") == "CONTRADICTED", c).when(F.col("status") == "SUPPORTED", e).otherwise(F.col("_top"))
    return g.select(claim, "status", sure.alias("confidence"))


def remediated(responses: DataFrame, claims: DataFrame, key: str, least: float = 0.5) -> DataFrame:
    """(key, action, kept): release, block, review, a correction of its supported claims (each text once, in order), or abstain.

    responses: (key, label, consequential); claims: (key, place, text, status, confidence).
    """
    good = claims.where((F.col("status") == "SUPPORTED") & (F.coalesce("confidence", F.lit(0.0)) >= least)).withColumn("_t", F.trim(F.regexp_replace("text", "\\s+", " "))).where("_t <> ''")
    once = good.groupBy(key, F.lower("_t").alias("_l")).agg(F.min(F.struct("place", "_t")).alias("_f"))
    kept = once.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list("_f")), lambda f: f["_t"]), " ").alias("_kept"))  # the claims of one response
    j = responses.join(kept, key, "left")
    action = ladder("safe_abstain", (F.col("label") == "SUPPORTED", "release"), (F.col("label") == "HALLUCINATED", "block"), (F.col("consequential"), "human_review"), (F.col("_kept").isNotNull(), "corrected_release"))
    return j.withColumn("action", action).select(key, "action", F.when(F.col("action") == "corrected_release", F.col("_kept")).alias("kept"))


def remediation_metrics(df: DataFrame, truth: str, action: str) -> DataFrame:
    """Shares of automatic, useful and safe handling, and containment and retention (null without such responses)."""
    y, a = F.col(truth) == 1, F.col(action)
    useful = a.isin("release", "corrected_release")
    n = F.count(F.lit(1))
    r = lambda x, of: F.when(of > 0, x / of)
    return df.agg(
        n.alias("n"),
        r(F.count_if(a != "human_review"), n).alias("automation_rate"),
        r(F.count_if(useful), n).alias("useful_rate"),
        r(F.count_if(y & (a == "release")), F.count_if(y)).alias("unsafe_release_rate"),
        r(F.count_if(y & (a != "release")), F.count_if(y)).alias("containment"),
        r(F.count_if(~y & useful), F.count_if(~y)).alias("retention"),
        r(F.count_if(y & (a != "release")) + F.count_if(~y & useful), n).alias("safe_handling_rate"),
    )


def claim_priority(df: DataFrame, key: str, top: int, base: dict[str, float]) -> DataFrame:
    """Each key's top UNKNOWN claims by priority: its type's base, a bonus for values, and the response's risk, up to 1; ties by place."""
    p = clip(F.coalesce(F.create_map(*[x for k, v in base.items() for x in (F.lit(k), F.lit(v))])[F.col("type")], F.lit(0.3)) + 0.1 * F.least(F.col("n_values"), F.lit(2)) + 0.2 * F.col("risk"), 0.0, 1.0)
    ranked = df.where("status = 'UNKNOWN'").withColumn("priority", p)
    w = Window.partitionBy(key).orderBy(F.desc(F.round("priority", 9)), "place")
    return ranked.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= top)


def claims_for_query(claims: DataFrame, queries: DataFrame, generic: tuple[str, ...], claim: str, query: str, text: str = "text") -> DataFrame:
    """(query, claim, score): share of a query's meaningful terms that a claim has; terms are joined, and pairs without any never made. Claims are dealt over tasks, PART_CLAIMS to one, where their pairs are also counted."""

    def terms(c: Column) -> Column:
        found = F.filter(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0)), lambda t: (F.length(t) > 2) & ~t.isin(*generic))
        return F.array_distinct(F.transform(found, lambda t: F.when((F.length(t) > 4) & t.endswith("s"), F.substring(t, F.lit(1), F.length(t) - 1)).otherwise(t)))

    q = queries.select(query, terms(F.col(text)).alias("_t")).select(query, F.size("_t").alias("_n"), F.explode("_t").alias("term"))
    parts = max(int(claims.sparkSession.conf.get("spark.sql.shuffle.partitions")), claims.count() // PART_CLAIMS)
    c = claims.select(claim, text).repartition(parts, claim).select(claim, F.explode(terms(F.col(text))).alias("term"))
    q = F.broadcast(q) if q.count() <= SENT else q
    return c.join(q, "term").groupBy(query, claim, "_n").agg(F.count(F.lit(1)).alias("_m")).select(query, claim, (F.col("_m") / F.col("_n")).alias("score"))


def merged_evidence(seeds: DataFrame, found: DataFrame, key: str, text: str, order: str, top: int) -> DataFrame:
    """Each key's seeds, then what was found, by order; of equal texts (lower-cased, white space collapsed) the first stays; top rows."""
    both = seeds.withColumn("_from", F.lit(0)).unionByName(found.withColumn("_from", F.lit(1)))
    both = both.withColumn("_t", F.lower(F.trim(F.regexp_replace(text, "\\s+", " "))))
    first = both.groupBy(key, "_t").agg(F.min(F.struct("_from", order)).alias("_o"))
    w = Window.partitionBy(key).orderBy("_o")
    return first.withColumn("place", F.row_number().over(w).cast("long")).where(F.col("place") <= top).select(key, F.col(f"_o.{order}").alias(order), (F.col("_o._from") == 0).alias("seed"), "place")


def range_facts(statements: DataFrame, key: str, text: str) -> DataFrame:
    """(key, asset, metric, low, high, unit) of texts that state one normal range and nothing else."""
    # One match for all parts, behind explode, so that no filter repeats it; the mark that parts them is taken out of the text first, where it matches nothing either.
    bare = F.translate(F.regexp_replace(F.trim(text), "\\.$", ""), "\x01", "\x02")
    parts = F.split(F.regexp_replace(bare, RANGE_FACT, "$1\x01$2\x01$3\x01$4\x01$5\x01"), "\x01")
    found = statements.select(key, F.explode(F.filter(F.array(parts), lambda p: F.size(p) == 6)).alias("p"))
    facts = found.select(key, F.lower(F.col("p")[0]).alias("asset"), F.lower(F.col("p")[1]).alias("metric"), F.col("p")[2].try_cast("double").alias("low"), F.col("p")[3].try_cast("double").alias("high"), F.lower(F.col("p")[4]).alias("unit"))
    return facts.where("low IS NOT NULL AND high IS NOT NULL AND low <= high")


def cited_ranges(claims: DataFrame, witnesses: DataFrame, claim: str) -> DataFrame:
    """(claim, status): claims (claim, doc, asset, metric, low, high, unit) whose cited document states the same range: SUPPORTED, or CONFLICTING where another differs.

    Claims whose document doesn't say so are left out.
    """
    fact = ["asset", "metric", "unit"]
    said = claims.join(witnesses.select("doc", *fact, "low", "high"), ["doc", *fact, "low", "high"], "left_semi")
    ranges = settled(witnesses.groupBy(*fact).agg(F.count_distinct("low", "high").alias("_n")))
    if ranges.count() <= SENT:
        ranges = F.broadcast(ranges)  # claims stay where they lie, however many speak of one fact
    return said.join(ranges, fact).select(claim, F.when(F.col("_n") > 1, "CONFLICTING").otherwise("SUPPORTED").alias("status"))


def range_support(observations: DataFrame, witnesses: DataFrame) -> DataFrame:
    """(obs, inside): observations (obs, doc, asset, metric, unit, value) against the only range that other documents state for them; without one they are left out."""
    fact = ["asset", "metric", "unit"]
    one = witnesses.groupBy(*fact).agg(F.count_distinct("low", "high").alias("_n"), F.min("low").alias("low"), F.min("high").alias("high"), F.collect_set("doc").alias("_docs")).where("_n = 1")
    j = observations.join(one, fact).where(F.exists("_docs", lambda d: d != F.col("doc")))
    return j.select("obs", F.col("value").between(F.col("low"), F.col("high")).alias("inside"))


def readings(text: Column, patterns: dict[str, str]) -> Column:
    """array<struct<metric, value>>: the first match of each metric's pattern."""
    each = [F.struct(F.lit(m).alias("metric"), F.regexp_extract(text, p, 1).try_cast("double").alias("value")) for m, p in patterns.items()]
    return F.filter(F.array(*each), lambda r: r["value"].isNotNull())


def routed(text: Column, routes: dict[str, str], default: str) -> Column:
    """The first route of which a key phrase stands in the text."""
    return ladder(default, *[(F.lower(text).rlike(p), name) for name, p in routes.items()])


def best_sentences(text: Column, terms: Column, top: int) -> Column:
    """The top sentences by shared terms, then by holding a digit, then by place, in their own order."""
    parts = F.split(F.regexp_replace(text, "([.!?])\\s+", "$1\n"), "\n")
    scored = F.transform(parts, lambda s, i: F.struct((-F.size(F.array_intersect(F.array_distinct(F.regexp_extract_all(F.lower(s), F.lit("[a-z0-9]+"), F.lit(0))), terms))).alias("a"), (~s.rlike("[0-9]")).alias("b"), i.alias("i"), s.alias("s")))
    chosen = F.slice(F.array_sort(F.filter(scored, lambda x: x["a"] < 0)), 1, top)
    return F.transform(F.array_sort(F.transform(chosen, lambda x: F.struct(x["i"].alias("i"), x["s"].alias("s")))), lambda x: x["s"])


def retry_policy(df: DataFrame, retries: Column, most: int = 2) -> DataFrame:
    """df (total, supported, contradicted, insufficient, score) with retry and abstain."""
    some = F.col("total") > 0
    weak = (F.col("supported") == 0) | (F.try_divide("supported", "total") < 0.6) | (F.col("insufficient") > 0) | (F.col("contradicted") > 0)
    lost = (F.col("supported") == 0) | (F.col("contradicted") > F.col("supported")) | (F.col("score") < 0.4)
    return df.withColumn("retry", some & (retries < most) & weak).withColumn("abstain", some & lost)


def selected_evidence(df: DataFrame, key: str, item: str, terms: Column, text: Column, top: int, shared: int = 1) -> DataFrame:
    """(key, item, place, omitted): current evidence by whether it is cited, shared terms, then score, top of each key; what shares too little is out unless cited.

    df: key, item, cited, superseded, score. omitted counts the key's eligible rows beyond top.
    """
    n = F.size(F.array_intersect(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))), terms))
    rows = df.withColumn("_n", n).where(~F.col("superseded") & (F.col("cited") | (F.col("_n") >= shared)))
    w = Window.partitionBy(key).orderBy(F.desc("cited"), F.desc("_n"), F.desc(F.round("score", 9)), item)
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_all"))
    placed = rows.withColumn("place", F.row_number().over(w).cast("long")).where(F.col("place") <= top)
    return placed.join(counts, key).select(key, item, "place", F.greatest(F.col("_all") - top, F.lit(0)).alias("omitted"))


def evidence_quality(ranked: DataFrame, key: str, top: int = 4) -> DataFrame:
    """Per key: sources among its top rows and a class: STRONG (three or more, one of them current), MIXED, WEAK (one source) or NONE current."""
    g = ranked.where(F.col("place") <= top).groupBy(key).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("source").alias("sources"), F.count_if("current").alias("current"))
    return g.withColumn("quality", ladder("MIXED", (F.col("current") == 0, "NONE"), (F.col("sources") >= 3, "STRONG"), (F.col("sources") == 1, "WEAK")))


# Words that hedge and words that leave no doubt.
HEDGES, ABSOLUTES = "(?i)\\b(?:maybe|perhaps|might|could|possibly|likely|about)\\b", "(?i)\\b(?:always|never|all|none|every|must|certainly)\\b"
SHAPES = {"numbers": "[0-9]+", "percents": "[0-9]%", "currencies": "[$€£]", "questions": "\\?", "exclaims": "!", "quotes": "\"", "lines": "\\n", "links": "https?://", "citations": "\\[[0-9]+\\]", "brackets": "[()]", "commas": ",", "hedges": HEDGES, "absolutes": ABSOLUTES, "capitals": "[A-Z]", "digits": "[0-9]", "codes": "[A-Z]{2,}[0-9]+"}


def shape_features(text: Column) -> dict[str, Column]:
    """Counts of what a text's risk is read from, and mean word length."""
    words = F.filter(F.split(text, "\\s+"), lambda w: w != "")
    out = {f"n_{k}": F.regexp_count(text, F.lit(p)) for k, p in SHAPES.items()}
    mean = F.when(F.size(words) > 0, F.aggregate(words, F.lit(0), lambda s, w: s + F.length(w)) / F.size(words)).otherwise(0.0)
    return out | {"n_words": F.size(words), "mean_word": mean}


def measured_ranges(text: Column) -> Column:
    """array<struct<low, high, unit>>: all ranges with a unit in a text."""
    p = "(?i)([0-9]+(?:\\.[0-9]+)?)\\s*(?:to|-|–)\\s*([0-9]+(?:\\.[0-9]+)?)\\s*(bar|mm/s|kpa|psi|c)\\b"
    parts = F.arrays_zip(*[F.regexp_extract_all(text, F.lit(p), F.lit(i)).alias(n) for i, n in ((1, "low"), (2, "high"), (3, "unit"))])
    return F.transform(parts, lambda x: F.struct(x["low"].cast("double").alias("low"), x["high"].cast("double").alias("high"), F.lower(x["unit"]).alias("unit")))
