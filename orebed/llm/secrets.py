"""Secrets: patterns, and two character Markov models compared by log-likelihood ratio.

Everything here is DataFrame expressions. Base patterns give spans that always count. Beside them, each long token
is scored by two first-order Markov models over ASCII characters, one of random
strings and one of ordinary identifiers and words; both are counted by Spark from labelled samples.
A token's log-likelihood ratio is the sum of its transitions' table entries (in
thousandths, as integers, so that sums are exact); ratios above the threshold make a span of kind `random`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "random")
ASSIGN = "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
TOKEN = "[A-Za-z0-9+/_=-]{20,}"
#: (kind, pattern, group whose length counts, least length); {16,} and {24,} say the same as a check after
#: the match, as a shorter run has no later start that would do.
PATTERNS = (("assign", ASSIGN, 2, 6), ("access", ACCESS, 0, 20), ("hex", HEX, 0, 24))

#: Labelled samples of each class.
SAMPLES = 4000
#: A token counts as random from this many thousandths of a nat per transition on.
THRESHOLD = 300
SPAN = "array<struct<start:int,kind:int,end:int>>"
#: Elements whose results one inner array gathers; array functions copy what they append to.
BLOCK = 512

# Parts of ordinary identifiers, chosen here.
PARTS = (
    "get set user name id index list map file path read write open close data value key item count size type string number config option test case "
    "module class object field table column row query result error code message request response client server host port session cache buffer "
    "stream event handler manager service factory builder parser token node tree graph edge link page view model controller action state update "
    "delete insert create remove find search sort filter group order start stop init main util helper common base core api http version build "
    "release final report article image photo video chapter section summary draft invoice january march june october "
    "der die und von mit fuer straat eine les des pour avec dans las los para con que una"
).split()


def samples(spark: SparkSession, n: int = SAMPLES) -> DataFrame:
    """(token, label): n random strings (label 1: hex, base64, base62 and letters alone) and n identifiers and words (label 0: parts with and without numbers)."""
    h = F.sha2(F.concat(F.lit("sample"), F.col("id").cast("string")), 256)
    b64 = F.base64(F.unhex(h))
    k = F.col("id")
    size = (24 + k % 17).cast("int")
    letters = F.translate(b64, "+/=0123456789", "xQzKjWvGpYbHf")
    rand = (
        F.when(k % 6 == 0, h)
        .when(k % 6 == 1, F.upper(h))
        .when(k % 6 == 2, b64)
        .when(k % 6 == 3, F.translate(b64, "+/=", "xQ7"))
        .when(k % 6 == 4, letters)
        .otherwise(F.lower(letters))
    )
    parts = F.array(*[F.lit(p) for p in PARTS])
    part = lambda j: F.element_at(parts, (1 + F.pmod(k * (7919 + 2 * j) + 104729 * j + F.floor(k / len(PARTS)) * (31 + j), F.lit(len(PARTS)))).cast("int"))
    number = ((k * 37) % 10000).cast("string")
    words = [part(j) for j in range(5)]
    named = (
        F.when(k % 7 == 0, F.concat_ws("_", *words[:4], number))
        .when(k % 7 == 1, F.concat(words[0], *[F.initcap(w) for w in words[1:4]], number))
        .when(k % 7 == 2, F.concat_ws("-", F.lit("2024"), F.lpad((k % 12 + 1).cast("string"), 2, "0"), *words[:4]))
        .when(k % 7 == 3, F.concat_ws("/", words[0], words[1], number, F.concat(words[2], words[3])))
        .when(k % 7 == 4, F.concat_ws("_", *[F.upper(w) for w in words[:4]], number))
        .when(k % 7 == 5, F.concat(*words))
        .otherwise(F.concat_ws("-", *words))
    )
    base = spark.range(n)
    return base.select(F.substring(rand, F.lit(1), size).alias("token"), F.lit(1).alias("label")).unionAll(base.select(named.alias("token"), F.lit(0).alias("label")))


def transition_ratios(labelled: DataFrame) -> list[int]:
    """128 x 128 table of thousandths of log P(b | a, random) / P(b | a, ordinary), add-one smoothed over 64 characters."""
    pairs = labelled.where(F.length("token") >= 2).select("label", "token", F.explode(F.sequence(F.lit(2), F.length("token"))).alias("i"))
    pairs = pairs.select("label", F.ascii(F.substring("token", F.col("i") - 1, F.lit(1))).alias("a"), F.ascii(F.substring("token", F.col("i"), F.lit(1))).alias("b"))
    n = pairs.where("a < 128 AND b < 128").groupBy("a", "b").agg(*[F.count(F.when(F.col("label") == v, 1)).alias(f"n{v}") for v in (0, 1)])
    got = {(r.a, r.b): (r.n0, r.n1) for r in n.collect()}  # at most 128 x 128 rows
    out = []
    from math import log

    for a in range(128):
        total = [sum(got.get((a, b), (0, 0))[v] for b in range(128)) for v in (0, 1)]
        for b in range(128):
            n0, n1 = got.get((a, b), (0, 0))
            out.append(round(1000 * (log((n1 + 1) / (total[1] + 64)) - log((n0 + 1) / (total[0] + 64)))))
    return out


def _each(items: Column, state: Column, step: Callable[[Column, Column], tuple[Column, Column, Column]]) -> Column:
    """Spans that step gives on its way over items: step(state, item) is (next state, whether there is a span, the span).

    Items are taken in blocks, whose spans are joined at last; one growing array would be copied for each of them.
    """
    none = F.array().cast(SPAN)

    def one(acc: Column, item: Column) -> Column:
        after, there, span = step(acc["s"], item)
        return F.struct(after.alias("s"), F.when(there, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).cast(SPAN).alias("out"))

    def block(all_: Column, acc: Column, b: Column) -> Column:
        part = F.slice(all_, b * BLOCK + 1, F.lit(BLOCK))
        return F.aggregate(part, F.struct(acc["s"].alias("s"), none.alias("out")), one, lambda r: F.struct(r["s"].alias("s"), F.concat(acc["out"], F.array(r["out"])).cast(f"array<{SPAN}>").alias("out")))

    def run(all_: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / BLOCK).cast("int"))
        start = F.struct(state.alias("s"), F.array().cast(f"array<{SPAN}>").alias("out"))
        return F.when(F.size(all_) > 0, F.aggregate(blocks, start, lambda acc, b: block(all_, acc, b), lambda r: F.flatten(r["out"]))).otherwise(none)

    return F.get(F.transform(F.array(items), run), F.lit(0))  # one element: the items are made once


def matches(text: Column, pattern: str, kind: int, group: int, keep: Callable[[Column], Column]) -> Column:
    """Spans of the leftmost non-overlapping matches, in code points, whose group keep accepts.

    Splitting the text by the pattern gives what stands between matches, so lengths add up to positions.
    """
    parts = F.arrays_zip(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)))

    def step(at: Column, e: Column) -> tuple[Column, Column, Column]:
        start = at + F.length(e["0"])
        end = start + F.length(e["1"])
        return F.coalesce(end, at), keep(e["2"]), F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"))

    return F.when(text.rlike(pattern), _each(parts, F.lit(0), step)).otherwise(F.array().cast(SPAN))


def apart(spans: Column, base: Column) -> Column:
    """spans (disjoint) that overlap none of base, in one pass over both by start."""
    last = F.struct(F.lit(2**31 - 1).alias("start"), F.lit(len(KINDS)).alias("kind"), F.lit(2**31 - 1).alias("end"))  # lets the last span out
    items = F.array_sort(F.concat(base, spans, F.array(last)).cast(SPAN))

    def step(s: Column, x: Column) -> tuple[Column, Column, Column]:
        mine = x["kind"] >= len(KINDS) - 1
        waits = s["end"] > 0
        drop = ~mine & waits & (x["start"] < s["end"])
        free = mine & (x["start"] >= s["reach"])
        take = lambda new, old: F.when(free, new).when(mine | drop, F.lit(0)).otherwise(old)
        after = F.struct(F.when(mine, s["reach"]).otherwise(F.greatest(s["reach"], x["end"])).alias("reach"), take(x["start"], s["start"]).alias("start"), take(x["end"], s["end"]).alias("end"))
        return after, mine & waits, F.struct(s["start"].alias("start"), F.lit(len(KINDS) - 1).alias("kind"), s["end"].alias("end"))

    zero = F.struct(F.lit(0).alias("reach"), F.lit(0).alias("start"), F.lit(0).alias("end"))
    return F.when(F.size(spans) > 0, _each(items, zero, step)).otherwise(F.array().cast(SPAN))


def joined(spans: Column) -> Column:
    """kind:start:end by start, then kind, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def found(docs: DataFrame, ratios: list[int], id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """(id, n_assign, n_access, n_hex, base_sha256, spans) of every whole text.

    A null text counts as empty, without spans. Each row gives one row, repeated rows and null ids too; an empty table gives none.
    Spans of different kinds may overlap, and those of one start stand in the kinds' order; a random token that touches a base span
    is left out. Other columns are not read. One pass without joins or shuffles; the ratio table (of fixed size) is a literal of the plan.
    Texts, tokens and matches may be long: each is gone over once.
    """
    table = F.split(F.lit(",".join(map(str, ratios))), ",").cast("array<int>")

    def ratio(token: Column) -> Column:
        def step(s: Column, c: Column) -> Column:
            code = F.ascii(c)
            return F.struct(code.alias("code"), F.when(s["code"] < 0, F.lit(0)).otherwise(s["sum"] + F.get(table, s["code"] * 128 + code)).alias("sum"))

        return F.aggregate(F.split(token, ""), F.struct(F.lit(-1).alias("code"), F.lit(0).alias("sum")), step, lambda s: s["sum"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col), text.alias("_text"))
    long_enough = lambda least: lambda group: F.length(group) >= least
    rows = rows.select(
        id_col,
        *[matches(F.col("_text"), p, KINDS.index(k), g, long_enough(least)).alias(k) for k, p, g, least in PATTERNS],
        matches(F.col("_text"), TOKEN, 3, 0, lambda t: ratio(t) >= threshold * (F.length(t) - 1)).alias("_random"),
    )
    base = F.concat("assign", "access", "hex")
    return rows.select(id_col, *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.concat(base, apart(F.col("_random"), base))).alias("spans"))


def _sql_matches(pattern: str, kind: int, group: int, least: int) -> str:
    p = pattern.replace("'", "''")
    return f"""list_filter(list_transform(range(1, len(string_split_regex(t, '{p}'))), lambda i: {{
        'start': (list_sum(list_transform(string_split_regex(t, '{p}')[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(regexp_extract_all(t, '{p}')[1:i - 1], lambda x: length(x))), 0))::INT,
        'kind': {kind},
        'end': (list_sum(list_transform(string_split_regex(t, '{p}')[1:i], lambda x: length(x))) + list_sum(list_transform(regexp_extract_all(t, '{p}')[1:i], lambda x: length(x))))::INT,
        'least': length(regexp_extract_all(t, '{p}', {group})[i])}}), lambda s: s.least >= {least})"""


def oracle_sql(n: int = SAMPLES, threshold: int = THRESHOLD) -> str:
    """The same rows in DuckDB SQL, sampling and counting included."""
    parts = "[" + ", ".join(f"'{p}'" for p in PARTS) + "]"
    part = lambda j: f"({parts})[(1 + (k * {7919 + 2 * j} + {104729 * j} + (k // {len(PARTS)}) * {31 + j}) % {len(PARTS)})::INT]"
    title = lambda x: f"(upper(substr({x}, 1, 1)) || substr({x}, 2))"
    name = "(['assign', 'access', 'hex', 'random'])[s.kind + 1]"
    text = lambda spans: f"coalesce(list_aggregate(list_transform(list_sort(list_transform({spans}, lambda s: {{'start': s.start, 'kind': s.kind, 'end': s.end}})), lambda s: {name} || ':' || s.start || ':' || s.end), 'string_agg', ','), '')"
    return f"""
WITH ids AS (SELECT range::BIGINT AS k, sha256('sample' || range) AS h FROM range({n})),
b AS (SELECT k, h, base64(unhex(h)) AS b64, (24 + k % 17)::INT AS size, ((k * 37) % 10000)::VARCHAR AS number, {', '.join(f'{part(j)} AS w{j}' for j in range(5))} FROM ids),
labelled AS (
  SELECT substr(CASE k % 6 WHEN 0 THEN h WHEN 1 THEN upper(h) WHEN 2 THEN b64 WHEN 3 THEN translate(b64, '+/=', 'xQ7')
    WHEN 4 THEN translate(b64, '+/=0123456789', 'xQzKjWvGpYbHf') ELSE lower(translate(b64, '+/=0123456789', 'xQzKjWvGpYbHf')) END, 1, size) AS token, 1 AS label FROM b
  UNION ALL
  SELECT CASE k % 7 WHEN 0 THEN concat_ws('_', w0, w1, w2, w3, number)
    WHEN 1 THEN w0 || {title('w1')} || {title('w2')} || {title('w3')} || number
    WHEN 2 THEN concat_ws('-', '2024', lpad((k % 12 + 1)::VARCHAR, 2, '0'), w0, w1, w2, w3)
    WHEN 3 THEN concat_ws('/', w0, w1, number, w2 || w3)
    WHEN 4 THEN concat_ws('_', upper(w0), upper(w1), upper(w2), upper(w3), number)
    WHEN 5 THEN w0 || w1 || w2 || w3 || w4
    ELSE concat_ws('-', w0, w1, w2, w3, w4) END, 0 FROM b),
pairs AS (SELECT label, ascii(token[i - 1]) AS a, ascii(token[i]) AS c FROM (SELECT label, token, unnest(range(2, length(token) + 1)) AS i FROM labelled)),
counts AS (SELECT a, c, count(*) FILTER (label = 0) AS n0, count(*) FILTER (label = 1) AS n1 FROM pairs GROUP BY a, c),
totals AS (SELECT a, sum(n0) AS t0, sum(n1) AS t1 FROM counts GROUP BY a),
grid AS (SELECT x.range::INT AS a, y.range::INT AS c FROM range(128) x, range(128) y),
ratios AS (SELECT list(round(1000 * (ln((coalesce(n1, 0) + 1.0::DOUBLE) / (coalesce(t1, 0) + 64)) - ln((coalesce(n0, 0) + 1.0::DOUBLE) / (coalesce(t0, 0) + 64))))::INT ORDER BY g.a, g.c) AS r
  FROM grid g LEFT JOIN counts USING (a, c) LEFT JOIN totals ON totals.a = g.a),
d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS (SELECT doc_id, t, {', '.join(f'{_sql_matches(p, KINDS.index(k), g, least)} AS {k}' for k, p, g, least in PATTERNS)}, {_sql_matches(TOKEN, 3, 0, 20)} AS tokens FROM d),
u AS (SELECT *, list_concat(list_concat(assign, access), hex) AS base FROM m),
f AS (SELECT *, list_filter(tokens, lambda s: len(list_filter(base, lambda x: x.start < s.end AND s.start < x.end)) = 0
  AND list_sum(list_transform(range(2, s.end - s.start + 1), lambda i: r[(ascii(substr(t, s.start + i - 1, 1)) * 128 + ascii(substr(t, s.start + i, 1)) + 1)::INT])) >= {threshold} * (s.end - s.start - 1)) AS extra FROM u, ratios)
SELECT doc_id, len(assign)::BIGINT AS n_assign, len(access)::BIGINT AS n_access, len(hex)::BIGINT AS n_hex, sha256({text('base')}) AS base_sha256, {text('list_concat(base, extra)')} AS spans FROM f"""
