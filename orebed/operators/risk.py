"""What a response's risk is read from: counts, support by its context, instructions of physical work and claims of work done.

All of it is text expressions over a row, but for claims of work, which meet their evidence by an equal join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A place that is no inside of a word, before and after it, whatever its script.
BEFORE, AFTER = "(?<![\\p{L}\\p{N}_])", "(?![\\p{L}\\p{N}_])"
WORD = "[\\p{L}\\p{N}_](?:[\\p{L}\\p{N}_'-]*[\\p{L}\\p{N}_])?"
# What counts as a number, a percentage, an amount, a year, a date, a link, a name and a citation, and words that hedge, assure, date or cite.
NUMBER = f"{BEFORE}[+-]?(?:[0-9]{{1,3}}(?:,[0-9]{{3}})+|[0-9]+)(?:\\.[0-9]+)?%?"
PERCENT = f"{BEFORE}[0-9]+(?:\\.[0-9]+)?\\s*%"
AMOUNT = f"(?i)(?:[$€£₹]|{BEFORE}(?:USD|EUR|GBP|INR))\\s*[0-9][0-9,]*(?:\\.[0-9]+)?"
YEAR = f"{BEFORE}(?:18|19|20|21)[0-9]{{2}}{AFTER}"
MONTHS = "Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?"
DATE = f"(?i){BEFORE}(?:[0-9]{{1,2}}[/-][0-9]{{1,2}}[/-](?:[0-9]{{2}}|[0-9]{{4}})|(?:{MONTHS})\\s+[0-9]{{1,2}}(?:,\\s*[0-9]{{4}})?){AFTER}"
LINK = "(?i)https?://\\S+|www\\.\\S+"
NAME = f"{BEFORE}(?:[A-Z][a-z]+(?:\\s+[A-Z][a-z]+){{0,4}}|[A-Z]{{2,}}){AFTER}"
CITATION = "\\[[0-9]{1,3}\\]|\\([A-Z][A-Za-z-]+(?:\\s+et\\s+al\\.)?,?\\s*[0-9]{4}\\)"
HEDGES = ["maybe", "perhaps", "possibly", "likely", "probably", "appears", "seems", "might", "could"]
CERTAINTY = ["definitely", "certainly", "clearly", "always", "never", "undoubtedly", "proven"]
CURRENT = ["current", "currently", "latest", "today", "now", "recent", "recently"]
CITING = ["source", "citation", "cite", "reference", "paper", "doi"]
# Physical work, what obliges to it, what says that it isn't to be done, claims that work was or was not done, and where such claims are recorded.
ACTION = "(?i)\\b(?:controlled\\s+)?shutdown\\b|\\b(?:isolate|isolation|line[- ]break|bearing\\s+replacement)\\b"
OBLIGATION = "(?i)\\b(?:required|must|should|initiate|perform)\\b"
NOT_CURRENT = "(?i)\\b(?:historical|superseded|formerly|used\\s+to|not\\s+valid|do\\s+not|must\\s+not|should\\s+not|cannot)\\b"
WORK_DONE = "(?i)\\b(?:no\\s+)?(?:physical|maintenance|repair)\\s+work\\s+(?:was|has\\s+been)\\s+(?:performed|completed)\\b|\\b(?:no\\s+)?(?:repair|replacement)\\s+(?:was|has\\s+been)\\s+(?:performed|completed)\\b"
UNTRUSTED = ["superseded", "unverified", "draft"]
RECORDS = ["work_order", "maintenance_history", "inspection_report", "operations_log"]
DAY, ASSET = "\\b[0-9]{4}-[0-9]{2}-[0-9]{2}\\b", "\\b[A-Za-z]+-[0-9]+\\b"


def found(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def words(text: Column) -> Column:
    return found(F.lower(text), WORD)


def sentences(text: Column) -> Column:
    """White space collapsed, then cut after ., ! or ? where a capital, digit or quote follows."""
    flat = F.trim(F.regexp_replace(text, "\\s+", " "))
    return F.filter(F.split(flat, "(?<=[.!?]) (?=[A-Z0-9\"'])"), lambda s: s != "")


def chunks(text: Column, size: int) -> Column:
    """Paragraphs (sentences where there are none, or where one is longer than size) packed up to size characters."""
    paragraphs = F.filter(F.transform(F.split(text, "\\n\\s*\\n"), lambda p: F.regexp_replace(p, "^\\s+|\\s+$", "")), lambda p: p != "")
    units = F.flatten(F.transform(paragraphs, lambda p: F.when(F.length(p) > size, sentences(p)).otherwise(F.array(p))))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("held"))

    def add(acc: Column, unit: Column) -> Column:
        full = (acc["held"] != "") & (F.length(acc["held"]) + 1 + F.length(unit) > size)
        done = F.when(full, F.concat(acc["done"], F.array(acc["held"]))).otherwise(acc["done"])
        held = F.when(full | (acc["held"] == ""), unit).otherwise(F.concat(acc["held"], F.lit(" "), unit))
        return F.struct(done.alias("done"), held.alias("held"))

    return F.aggregate(units, start, add, lambda acc: F.when(acc["held"] != "", F.concat(acc["done"], F.array(acc["held"]))).otherwise(acc["done"]))


def _numbers(text: Column) -> Column:
    return F.transform(found(text, NUMBER), lambda n: F.replace(n, F.lit(","), F.lit("")))


def _dates(text: Column) -> Column:
    dates = F.transform(found(text, DATE), lambda d: F.replace(F.lower(d), F.lit(","), F.lit("")))
    return F.array_distinct(F.concat(dates, found(text, YEAR)))


def _share(items: Column, holds) -> Column:
    """The share of items that hold, 1 if there are none."""
    return F.when(F.size(items) > 0, F.size(F.filter(items, holds)) / F.size(items)).otherwise(1.0)


def _contained(inner: Column, outer: Column) -> Column:
    """The share of inner's distinct words that outer has, 0 if there are none."""
    some = F.array_distinct(inner)
    return F.when(F.size(some) > 0, F.size(F.array_intersect(some, outer)) / F.size(some)).otherwise(0.0)


def risk_features(df: DataFrame, keys: list[str], response: str = "response", query: str = "query", context: str = "context", size: int = 800) -> DataFrame:
    """keys and 29 doubles: counts of the response and of the query, and how far the context (in chunks of size) supports the response.

    Nulls count as empty. Texts are taken whole, with all their sentences and chunks.
    """
    base = df.select(*keys, *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for n, c in (("_r", response), ("_q", query), ("_c", context))])
    r, q, c = F.col("_r"), F.col("_q"), F.col("_c")
    base = base.withColumns({"_rw": words(r), "_qw": words(q), "_cw": F.array_distinct(words(c)), "_rs": sentences(r), "_rn": _numbers(r), "_rd": _dates(r), "_re": found(r, NAME), "_cn": _numbers(c), "_cd": _dates(c), "_ch": F.transform(chunks(c, size), lambda x: F.array_distinct(words(x)))})
    support = F.transform("_rs", lambda s: F.coalesce(F.array_max(F.transform("_ch", lambda k: _contained(words(s), k))), F.lit(0.0)))
    base = base.withColumn("_sup", F.when(F.size("_rs") > 0, support).otherwise(F.array(F.lit(0.0))))
    n = lambda x: F.size(x).cast("double")
    among = lambda have, wanted: F.filter(have, lambda w: w.isin(wanted))
    per = F.greatest(F.lit(1), F.size("_rs"))
    out = {
        "response_chars": F.length(r), "response_words": n("_rw"), "response_sentences": n("_rs"), "avg_sentence_words": n("_rw") / per,
        "response_question_ratio": F.regexp_count(r, F.lit("\\?")) / per, "response_number_count": n("_rn"), "response_percent_count": n(found(r, PERCENT)),
        "response_currency_count": n(found(r, AMOUNT)), "response_year_count": n(found(r, YEAR)), "response_date_count": n("_rd"), "response_url_count": n(found(r, LINK)),
        "response_citation_count": n(found(r, CITATION)), "response_entity_count": n("_re"), "response_hedge_count": n(among(F.col("_rw"), HEDGES)), "response_certainty_count": n(among(F.col("_rw"), CERTAINTY)),
        "query_chars": F.length(q), "query_words": n("_qw"), "query_entity_count": n(found(q, NAME)), "query_number_count": n(_numbers(q)), "query_year_count": n(found(q, YEAR)),
        "query_current_flag": (F.size(among(F.col("_qw"), CURRENT)) > 0), "query_citation_flag": (F.size(among(F.col("_qw"), CITING)) > 0),
        "lexical_context_overlap": _contained(F.col("_rw"), F.col("_cw")), "min_sentence_lexical_support": F.array_min("_sup"),
        "mean_sentence_lexical_support": F.aggregate("_sup", F.lit(0.0), lambda a, x: a + x) / F.size("_sup"), "max_sentence_lexical_support": F.array_max("_sup"),
        "entity_support_ratio": _share(F.col("_re"), lambda e: F.lower(c).contains(F.lower(e))),
        "number_support_ratio": _share(F.col("_rn"), lambda x: F.array_contains("_cn", x)), "date_support_ratio": _share(F.col("_rd"), lambda x: F.array_contains("_cd", x)),
    }
    return base.select(*keys, *[x.cast("double").alias(name) for name, x in out.items()])


def consequential_action(response: Column) -> Column:
    """Whether a sentence obliges to physical work and does not say that it is past or not to be done."""
    parts = F.split(F.regexp_replace(response, "([.!?])\\s+", "$1\n"), "\n")
    return F.coalesce(F.exists(parts, lambda s: s.rlike(ACTION) & s.rlike(OBLIGATION) & ~s.rlike(NOT_CURRENT)), F.lit(False))


def claims_work(response: Column) -> Column:
    """Whether a response says that physical work was, or was not, done."""
    return F.coalesce(response.rlike(WORK_DONE), F.lit(False))


def work_records(responses: DataFrame, evidence: DataFrame, key: str) -> DataFrame:
    """(key, claimed, recorded) for each of responses (key, prompt, response): recorded if evidence (key, text, status, kind) of the key proves its claim of work.

    Evidence proves it by a trusted status, a kind of record, the claim's own words (case and white space aside), and the day and asset that the response,
    or else the prompt, names first. Without such a day or asset none is asked for. Null texts, statuses and kinds count as empty; repeated evidence changes nothing.
    """
    flat = lambda t: F.trim(F.regexp_replace(F.lower(t), "\\s+", " "))
    empty = lambda c: F.coalesce(c, F.lit(""))
    named = lambda p: F.coalesce(*[F.get(found(empty(F.col(c)), p), F.lit(0)) for c in ("response", "prompt")])
    said = responses.select(key, claims_work(F.col("response")).alias("claimed"), flat(F.get(found(empty(F.col("response")), WORK_DONE), F.lit(0))).alias("_claim"), named(DAY).alias("_day"), F.lower(named(ASSET)).alias("_asset"))
    text = empty(F.col("text"))
    is_record = F.lit(False)
    for kind in RECORDS:
        is_record = is_record | empty(F.lower("kind")).contains(kind)
    trusted = evidence.where(~empty(F.lower("status")).isin(UNTRUSTED) & is_record).select(key, text.alias("_text"))
    proves = F.contains(flat(F.col("_text")), F.col("_claim"))
    proves = proves & (F.col("_day").isNull() | F.contains("_text", F.col("_day"))) & (F.col("_asset").isNull() | F.array_contains(F.transform(found(F.col("_text"), ASSET), F.lower), F.col("_asset")))
    proved = said.where("claimed").join(trusted, key).where(proves).select(key).distinct().withColumn("recorded", F.lit(True))
    return said.select(key, "claimed").join(proved, key, "left").withColumn("recorded", F.coalesce("recorded", F.lit(False)))
