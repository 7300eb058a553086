"""Features of answers in conversations, and claims of work by orders that line items record."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from orebed.operators import risk as K
from orebed.queries.base import query, table

W = "[\\p{L}\\p{N}_]"
LOOKS = "' It perhaps fell ' || turn || '.5% in ' || (1950 + conv_id % 250) || ', never to $' || (conv_id + 1000) || ',500 [' || turn || ']. See https://ex.org/' || turn || ' on 3/' || (turn + 1) || '/2024 or March 5, 2021 (Smith et al. 2020)?'"
NUM_SQL = "list_transform(regexp_extract_all({t}, '(?:^|[^\\p{{L}}\\p{{N}}_])([+-]?(?:[0-9]{{1,3}}(?:,[0-9]{{3}})+|[0-9]+)(?:\\.[0-9]+)?%?)', 1), lambda n: replace(n, ',', ''))"
YEAR_SQL = "regexp_extract_all({t}, '\\b(?:18|19|20|21)[0-9]{{2}}\\b')"
DATE_SQL = f"list_distinct(list_concat(list_transform(regexp_extract_all({{t}}, '(?i)\\b(?:[0-9]{{{{1,2}}}}[/-][0-9]{{{{1,2}}}}[/-](?:[0-9]{{{{2}}}}|[0-9]{{{{4}}}})|(?:{K.MONTHS})\\s+[0-9]{{{{1,2}}}}(?:,\\s*[0-9]{{{{4}}}})?)\\b'), lambda d: replace(lower(d), ',', '')), {YEAR_SQL}))"
NAME_SQL = f"list_transform(regexp_extract_all(regexp_replace({{t}}, '({W}+)', '«\\1»', 'g'), '«[A-Z][a-z]+»(?:\\s+«[A-Z][a-z]+»){{{{0,4}}}}|«[A-Z]{{{{2,}}}}»'), lambda e: replace(replace(e, '«', ''), '»', ''))".replace(W, W.replace("{", "{{").replace("}", "}}"))
WORDS_SQL = "regexp_extract_all(lower({t}), '" + K.WORD.replace("'", "''").replace("{", "{{").replace("}", "}}") + "')"
SENT_SQL = """list_filter(string_split(regexp_replace(trim(regexp_replace({t}, '\\s+', ' ', 'g')), '([.!?]) ([A-Z0-9"''])', '\\1' || chr(10) || '\\2', 'g'), chr(10)), lambda s: s <> '')"""
HAS = "CASE WHEN len(list_distinct({a})) > 0 THEN len(list_intersect(list_distinct({a}), {b})) / len(list_distinct({a})) ELSE 0 END"


def share_sql(items: str, test: str) -> str:
    return f"CASE WHEN len({items}) > 0 THEN len(list_filter({items}, lambda x: {test})) / len({items}) ELSE 1 END"


FEATURES_SQL = f"""WITH t AS (SELECT conv_id, turn, role, text, lag(text) OVER w AS a, lag(text, 2) OVER w AS b FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
s AS (SELECT conv_id, turn, text || {LOOKS} AS r, coalesce(a, '') AS q, concat_ws(chr(10) || chr(10), b, a, '5 USD in 2021') AS c FROM t WHERE role = 'assistant' AND text IS NOT NULL),
p AS (SELECT conv_id, turn, list_filter(list_transform(regexp_split_to_array(c, '\\n\\s*\\n'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS ps FROM s),
u AS (SELECT conv_id, turn, flatten(list_transform(ps, lambda x: CASE WHEN length(x) > 800 THEN {SENT_SQL.format(t='x')} ELSE [x] END)) AS us FROM p),
k AS (SELECT conv_id, turn, list_transform(list_filter(string_split(list_reduce(us, lambda x, y: CASE WHEN length(string_split(x, chr(1))[-1]) + 1 + length(y) > 800 THEN x || chr(1) || y ELSE x || ' ' || y END), chr(1)), lambda x: x <> ''), lambda x: {WORDS_SQL.format(t='x')}) AS ch FROM u),
f AS (SELECT s.*, {WORDS_SQL.format(t='r')} AS rw, {WORDS_SQL.format(t='q')} AS qw, {WORDS_SQL.format(t='c')} AS cw, {SENT_SQL.format(t='r')} AS rs, {NUM_SQL.format(t='r')} AS rn, {DATE_SQL.format(t='r')} AS rd, {NAME_SQL.format(t='r')} AS re, {NUM_SQL.format(t='c')} AS cn, {DATE_SQL.format(t='c')} AS cd, ch FROM s JOIN k USING (conv_id, turn)),
g AS (SELECT *, greatest(1, len(rs)) AS per, list_transform(list_transform(rs, lambda x: {WORDS_SQL.format(t='x')}), lambda x: coalesce(list_max(list_transform(ch, lambda y: {HAS.format(a='x', b='y')})), 0)::DOUBLE) AS sup FROM f)
SELECT conv_id, turn, length(r)::DOUBLE AS response_chars, len(rw)::DOUBLE AS response_words, len(rs)::DOUBLE AS response_sentences, len(rw) / per AS avg_sentence_words, len(regexp_extract_all(r, '\\?')) / per AS response_question_ratio, len(rn)::DOUBLE AS response_number_count,
len(regexp_extract_all(r, '\\b[0-9]+(?:\\.[0-9]+)?\\s*%'))::DOUBLE AS response_percent_count, len(regexp_extract_all(r, '(?i)(?:[$€£₹]|\\b(?:USD|EUR|GBP|INR))\\s*[0-9][0-9,]*'))::DOUBLE AS response_currency_count, len({YEAR_SQL.format(t='r')})::DOUBLE AS response_year_count, len(rd)::DOUBLE AS response_date_count,
len(regexp_extract_all(r, '(?i)https?://\\S+|www\\.\\S+'))::DOUBLE AS response_url_count, len(regexp_extract_all(r, '{K.CITATION}'))::DOUBLE AS response_citation_count, len(re)::DOUBLE AS response_entity_count, len(list_filter(rw, lambda x: list_contains({K.HEDGES}, x)))::DOUBLE AS response_hedge_count, len(list_filter(rw, lambda x: list_contains({K.CERTAINTY}, x)))::DOUBLE AS response_certainty_count,
length(q)::DOUBLE AS query_chars, len(qw)::DOUBLE AS query_words, len({NAME_SQL.format(t='q')})::DOUBLE AS query_entity_count, len({NUM_SQL.format(t='q')})::DOUBLE AS query_number_count, len({YEAR_SQL.format(t='q')})::DOUBLE AS query_year_count, (list_has_any(qw, {K.CURRENT}))::INT::DOUBLE AS query_current_flag, (list_has_any(qw, {K.CITING}))::INT::DOUBLE AS query_citation_flag,
({HAS.format(a='rw', b='cw')})::DOUBLE AS lexical_context_overlap, list_min(sup) AS min_sentence_lexical_support, list_sum(sup) / len(sup) AS mean_sentence_lexical_support, list_max(sup) AS max_sentence_lexical_support,
({share_sql('re', 'contains(lower(c), lower(x))')})::DOUBLE AS entity_support_ratio, ({share_sql('rn', 'list_contains(cn, x)')})::DOUBLE AS number_support_ratio, ({share_sql('rd', 'list_contains(cd, x)')})::DOUBLE AS date_support_ratio FROM g"""
RATIOS = "avg_sentence_words response_question_ratio lexical_context_overlap min_sentence_lexical_support mean_sentence_lexical_support max_sentence_lexical_support entity_support_ratio number_support_ratio date_support_ratio"


@query("answer_risk_features", FEATURES_SQL, RATIOS)
def answer_risk_features(spark, sf_dir):
    """Twenty-nine features of each answer, against the two turns before it; a stated sentence with figures is appended to each."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    turns = table(spark, sf_dir, "conversations").withColumns({"a": F.lag("text").over(w), "b": F.lag("text", 2).over(w)}).where("role = 'assistant' AND text IS NOT NULL")
    rows = turns.select("conv_id", "turn", F.expr(f"text || {LOOKS}").alias("response"), F.coalesce("a", F.lit("")).alias("query"), F.concat_ws("\n\n", "b", "a", F.lit("5 USD in 2021")).alias("context"))
    return K.risk_features(rows, ["conv_id", "turn"])


SAID = "CASE o_orderkey % 4 WHEN 0 THEN 'No maintenance  work was performed on Pump-' || o_custkey % 3 || '.' WHEN 1 THEN 'Repair has been completed on ' || strftime(o_orderdate, '%Y-%m-%d') || '.' WHEN 2 THEN 'A controlled shutdown is required. It was fine.' ELSE 'You must not isolate it. Bearing replacement is historical.' END"
SEEN = "CASE l_linenumber % 3 WHEN 0 THEN 'Log: no maintenance work was performed on PUMP-' || l_suppkey % 3 WHEN 1 THEN 'repair has  been completed on 1995-01-01 for pump-1' ELSE 'repair has been completed on ' || l_linenumber END"
KIND = "CASE l_returnflag WHEN 'A' THEN 'Work_Order' WHEN 'R' THEN 'operations_log v2' ELSE 'manual' END"


@query("work_records", f"""WITH r AS (SELECT o_orderkey AS k, {SAID} AS response, 'State of Pump-1?' AS prompt FROM orders), e AS (SELECT l_orderkey AS k, {SEEN} AS text, l_linestatus = 'O' AND l_linenumber > 3 AS draft, {KIND} AS kind FROM lineitem),
p AS (SELECT DISTINCT k FROM r JOIN e USING (k) WHERE NOT draft AND kind <> 'manual' AND ((k % 4 = 0 AND contains(lower(e.text), 'no maintenance work was performed') AND regexp_extract(lower(response), 'pump-[0-9]+') = regexp_extract(lower(e.text), 'pump-[0-9]+')) OR (k % 4 = 1 AND contains(regexp_replace(e.text, '\\s+', ' ', 'g'), 'repair has been completed') AND contains(e.text, regexp_extract(response, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}')) AND contains(lower(e.text), 'pump-1'))))
SELECT k, k % 4 < 2 AS claimed, p.k IS NOT NULL AS recorded, k % 4 = 2 AS consequential FROM r LEFT JOIN p USING (k)""")
def work_records(spark, sf_dir):
    """Which orders' statements of work their line items record, and which oblige to physical work."""
    said = F.expr(SAID.replace("strftime(o_orderdate, '%Y-%m-%d')", "date_format(o_orderdate, 'yyyy-MM-dd')"))
    responses = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), said.alias("response"), F.lit("State of Pump-1?").alias("prompt"))
    status = F.when((F.col("l_linestatus") == "O") & (F.col("l_linenumber") > 3), "Draft").otherwise("current")
    evidence = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.expr(SEEN).alias("text"), status.alias("status"), F.expr(KIND).alias("kind"))
    return K.work_records(responses, evidence, "k").join(responses.select("k", K.consequential_action(F.col("response")).alias("consequential")), "k")
