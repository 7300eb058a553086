"""Text risk and claims over documents, conversations and pages."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from orebed.functions import text as T
from orebed.queries.base import query, table


def _sql(p: str) -> str:
    return p.replace("'", "''")


def counts(patterns, column="text"):
    return ", ".join(f"len(regexp_extract_all({column}, '{_sql(p)}'))::INT AS n_{k}" for k, p in patterns.items())


@query("injection_scan", f"SELECT conv_id, turn, {counts(T.INJECTION)} FROM conversations")
def injection_scan(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", *[F.regexp_count("text", F.lit(T.as_re2(p))).alias(f"n_{k}") for k, p in T.INJECTION.items()])


@query("pii_counts", f"SELECT doc_id, {counts(T.PII)} FROM documents")
def pii_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", *[F.regexp_count("text", F.lit(T.as_re2(p))).alias(f"n_{k}") for k, p in T.PII.items()])


@query("pii_masked", f"""SELECT doc_id, v AS value_masked FROM (SELECT doc_id, unnest(list_transform(regexp_extract_all(text, '{_sql(T.PII['email'])}'), lambda x: CASE WHEN length(x) <= 4 THEN repeat('*', length(x)) ELSE substr(x, 1, 2) || repeat('*', length(x) - 4) || substr(x, -2) END)) AS v FROM documents)""")
def pii_masked(spark, sf_dir):
    found = F.regexp_extract_all("text", F.lit(T.as_re2(T.PII["email"])), F.lit(0))
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(F.transform(found, T.masked)).alias("value_masked"))


PHONES_SQL = r"len(list_filter(regexp_extract_all(text, '\+?[0-9]+'), lambda x: regexp_full_match(x, '\+?[6-9][0-9]{9}') OR regexp_full_match(x, '\+91[6-9][0-9]{9}')))::INT"
GROUPS_SQL = r"len(regexp_extract_all(regexp_replace(text, '([^0-9])', '\1\1', 'g'), '(?:^|[^0-9])([0-9]{4}(?:  |--)?[0-9]{4}(?:  |--)?[0-9]{4})(?:$|[^0-9])', 1))::INT"


@query("pii_bounded_counts", f"SELECT doc_id, {PHONES_SQL} AS n_phone, {GROUPS_SQL} AS n_aadhaar_like FROM documents")
def pii_bounded_counts(spark, sf_dir):
    """Telephone and identity numbers, whose patterns look around; the SQL gives each number borders of its own instead."""
    return table(spark, sf_dir, "documents").select("doc_id", *[F.regexp_count("text", F.lit(p)).alias(f"n_{k}") for k, p in T.PII_BOUNDED.items()])


LUHN_SQL = "list_sum(list_transform(range(1, length(c) + 1), lambda i: CASE WHEN (length(c) - i) % 2 = 1 THEN CASE WHEN c[i]::INT * 2 > 9 THEN c[i]::INT * 2 - 9 ELSE c[i]::INT * 2 END ELSE c[i]::INT END)) % 10 = 0"


@query("luhn_cards", f"""SELECT doc_id, c AS card FROM (SELECT doc_id, unnest(list_transform(regexp_extract_all(text, '{T.CARD}'), lambda x: regexp_replace(x, '[ -]', '', 'g'))) AS c FROM documents) WHERE {LUHN_SQL}""")
def luhn_cards(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(T.cards(F.col("text"))).alias("card"))


@query("number_extract", """SELECT token, CASE WHEN base <> '' THEN replace(base, ',', '')::DOUBLE * CASE unit WHEN 'k' THEN 1e3 WHEN 'm' THEN 1e6 WHEN 'crore' THEN 1e7 WHEN 'bn' THEN 1e9 ELSE 1 END END AS v
FROM (SELECT token, regexp_extract(lower(trim(token)), '([+-]?[0-9][0-9,]*(?:\\.[0-9]+)?)', 1) AS base, regexp_extract(lower(trim(token)), '(thousand|million|billion|crore|lakh|bn|mn|k|m)$', 1) AS unit
FROM (SELECT l_quantity::INT::VARCHAR || (['', ' k', ' m', ' crore', ' bn', ' percent'])[l_linenumber % 6 + 1] AS token FROM lineitem))""", "v")
def number_extract(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    suffix = F.get(F.array(*[F.lit(x) for x in ("", " k", " m", " crore", " bn", " percent")]), F.col("l_linenumber") % 6)
    token = F.concat(F.col("l_quantity").cast("int").cast("string"), suffix)
    return li.select(token.alias("token"), T.number_value(token).alias("v"))


@query("word_window_chunks", """WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM documents), s AS (SELECT doc_id, w, unnest(range(0, greatest(len(w), 1), 500)) AS st FROM w)
SELECT doc_id, st::INT AS "start", least(600, len(w) - st)::INT AS n, md5(array_to_string(w[st + 1:st + 600], ' ')) AS digest FROM s WHERE least(600, len(w) - st) >= 30""")
def word_window_chunks(spark, sf_dir):
    """Windows of 600 words, 100 of them shared, 30 words at least."""
    chunks = table(spark, sf_dir, "documents").select("doc_id", F.explode(T.word_windows(F.col("text"), 600, 100, 30)).alias("c"))
    return chunks.select("doc_id", F.col("c.start").alias("start"), F.col("c.n").alias("n"), F.md5(F.col("c.words").cast("binary")).alias("digest"))


@query("sentence_counts", r"SELECT doc_id, len(list_filter(string_split(regexp_replace(text, '([.!?])\s+([A-Z0-9])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda s: trim(s) <> ''))::INT AS n_sentences FROM documents")
def sentence_counts(spark, sf_dir):
    """Sentences of each document."""
    return table(spark, sf_dir, "documents").select("doc_id", F.size(T.sentences(F.col("text"))).alias("n_sentences"))


@query("page_text", """SELECT page_id, length(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')))::INT AS n_chars, lower(regexp_extract(url, '^[a-z]+://([^/]+)', 1)) AS host FROM pages""")
def page_text(spark, sf_dir):
    """Length of the visible text of raw pages, and their hosts."""
    clean = F.regexp_replace(F.regexp_replace(F.regexp_replace("html", "(?s)<(script|style)[^>]*>.*?</(script|style)>", " "), "<[^>]+>", " "), "\\s+", " ")
    return table(spark, sf_dir, "pages").select("page_id", F.length(F.trim(clean)).alias("n_chars"), F.lower(F.regexp_extract("url", "^[a-z]+://([^/]+)", 1)).alias("host"))


RISK = "length(text) % 10 / 10.0::DOUBLE"


@query("conversation_risk", f"""SELECT conv_id, turn, max(CASE WHEN role = 'user' THEN {RISK} END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior_risk FROM conversations""", "prior_risk")
def conversation_risk(spark, sf_dir):
    """Highest risk among a turn's earlier user turns."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    risk = F.length("text") % 10 / F.lit(10.0)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.max(F.when(F.col("role") == "user", risk)).over(w).alias("prior_risk"))


@query("conversation_counters", "SELECT role, count(*) AS turns, count(DISTINCT conv_id) AS conversations, avg(length(text)) AS mean_chars FROM conversations GROUP BY role", "mean_chars")
def conversation_counters(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("role").agg(F.count(F.lit(1)).alias("turns"), F.count_distinct("conv_id").alias("conversations"), F.avg(F.length("text")).alias("mean_chars"))


@query("risk_features", r"""SELECT doc_id, len(w)::INT AS n_words, len(list_distinct(w)) / greatest(len(w), 1) AS distinct_ratio, length(regexp_replace(text, '[^0-9]', '', 'g'))::INT AS n_digits, length(regexp_replace(text, '[^A-Z]', '', 'g')) / greatest(length(text), 1) AS upper_ratio
FROM (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM documents)""", "distinct_ratio upper_ratio")
def risk_features(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("w", F.filter(F.split("text", "\\s+"), lambda x: x != ""))
    n, chars = F.size("w"), F.length("text")
    return docs.select("doc_id", n.alias("n_words"), (F.size(F.array_distinct("w")) / F.greatest(n, F.lit(1))).alias("distinct_ratio"), F.length(F.regexp_replace("text", "[^0-9]", "")).alias("n_digits"), (F.length(F.regexp_replace("text", "[^A-Z]", "")) / F.greatest(chars, F.lit(1))).alias("upper_ratio"))


@query("reference_normalized", "SELECT DISTINCT upper(regexp_replace(trim(p_type), '\\s+', ' ', 'g')) AS ref FROM part")
def reference_normalized(spark, sf_dir):
    return table(spark, sf_dir, "part").select(T.normal_reference(F.col("p_type")).alias("ref")).distinct()


@query("event_property_json", "SELECT event_id, (json_extract(props, '$.k'))::INT AS k, CASE WHEN (json_extract(props, '$.k'))::INT % 20 = 0 THEN 'BAD' WHEN (json_extract(props, '$.k'))::INT % 10 = 0 THEN 'UNCERTAIN' ELSE 'GOOD' END AS quality FROM events")
def event_property_json(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").select("event_id", k.alias("k"), T.fold({"BAD": k % 20 == 0, "UNCERTAIN": k % 10 == 0}, "GOOD").alias("quality"))
