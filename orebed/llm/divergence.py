"""Source divergence audit: how the words of a language's sources differ from each other and from the language.

Every language keeps the terms of enough of its documents. In a source, and in the language as a
whole, a kept term has a share in billionths, smoothed; f is the distance of two shares. Of each source the terms that lead the language by most
are searched by upper bounds: its terms are filed in buckets of like counts, each with the largest share that its counts
give and the smallest that its terms have in the language, whose difference bounds f. Buckets are evaluated best first, and
no more of them once the bounds of the rest are strictly below the kth value. Distances of pairs of sources come from the
terms' postings: what both sources have is added up term by term, the rest by each source's histogram of counts.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orebed.llm.kernels import cut_lineage

#: Terms are runs of ASCII letters and of anything beyond ASCII.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Documents of a language that a kept term is in, at least.
MIN_DOCS = 30
#: Added to each count.
SMOOTH = 5
#: Shares are whole numbers of this part.
UNIT = 1_000_000_000
#: Leading terms of a source.
TOP = 50
#: Buckets for each doubling of a count (counts have one each while they are small).
PER_OCTAVE = 8
#: Each round evaluates up to this many times the terms of the round before.
WIDEN = 8
#: Sums of terms that a task holds before it passes them on.
HELD = 400_000
#: Pairs of postings that a task adds up at once.
PAIRS = 1 << 20
GROUP = ["lang", "source"]
#: Byte map that lower-cases A-Z and turns what stands between terms into spaces.
_PLAIN = bytes(b + 32 if 65 <= b < 91 else b if 97 <= b < 123 or b >= 128 else 32 for b in range(256))


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term of each group, dealt by lang and term.

    A task adds up what it reads and passes its sums on whenever HELD of them have come together.
    """
    plain = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name) for c, name in ((lang_col, "lang"), (source_col, "source"))), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))
        since = 0

        def passed() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, in_docs) in held.items():
                if n:
                    terms = pa.array(list(n), pa.binary()).view(pa.string())
                    yield pa.RecordBatch.from_arrays([pa.repeat(lang, len(n)), pa.repeat(source, len(n)), terms, pa.array(list(n.values()), pa.int64()), pa.array([in_docs[t] for t in n], pa.int64())], names=["lang", "source", "term", "n", "docs"])
            held.clear()

        for batch in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                terms = text.translate(_PLAIN).split()
                n, in_docs = held[lang, source]
                since -= len(n)
                n.update(terms)
                in_docs.update(set(terms))
                since += len(n)
                if since >= HELD:
                    yield from passed()
                    since = 0
        yield from passed()

    sums = plain.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return sums.repartition("lang", "term").groupBy(*GROUP, "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: str | int, total: str, terms: str) -> F.Column:
    """1 + floor(UNIT * (n + SMOOTH) / (total + SMOOTH * terms)), exactly; 1 where there is nothing to divide by."""
    below = f"CAST({total} AS DECIMAL(20, 0)) + {SMOOTH} * CAST({terms} AS DECIMAL(18, 0))"
    return F.expr(f"1 + coalesce((CAST({UNIT} AS DECIMAL(10, 0)) * CAST({n} + {SMOOTH} AS DECIMAL(20, 0))) div nullif({below}, 0), 0)")


def bucket(n: str) -> F.Column:
    """Counts alike; any mapping is right, as a bucket's bound is made of what is in it."""
    return F.expr(f"CAST(floor({PER_OCTAVE} * log2({n})) AS INT)")


class Audit:
    """The tables of one audit.

    groups: every occurring (lang, source) with total (occurrences of kept terms), own (kept terms that it has), vocabulary (kept terms
    of the language) and zero (share of a term that it lacks). postings: (lang, source, term, n, p, q) of kept terms that occur, q the language's share.
    """

    def __init__(self, docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = MIN_DOCS) -> None:
        counts = term_counts(docs, text_col, lang_col, source_col)
        term = Window.partitionBy("lang", "term")
        kept = counts.withColumns({"of_lang": F.sum("n").over(term), "in_docs": F.sum("docs").over(term)}).where(F.col("in_docs") >= min_docs)
        self.kept = cut_lineage(kept.select(*GROUP, "term", "n", "of_lang"))
        langs = self.kept.groupBy("lang", "term").agg(F.first("of_lang").alias("n")).groupBy("lang").agg(F.count("*").alias("vocabulary"), F.sum("n").alias("of_all"))
        occurring = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name) for c, name in ((lang_col, "lang"), (source_col, "source")))).distinct()
        sums = self.kept.groupBy(*GROUP).agg(F.sum("n").alias("total"), F.count("*").alias("own"))
        groups = occurring.join(sums, GROUP, "left").join(langs, "lang", "left").fillna(0, ["total", "own", "vocabulary", "of_all"])
        self.groups = cut_lineage(groups.withColumn("zero", share(0, "total", "vocabulary")))
        shares = self.kept.join(self.groups, GROUP).select(*GROUP, "term", "n", share("n", "total", "vocabulary").alias("p"), share("of_lang", "of_all", "vocabulary").alias("q"))
        self.postings = cut_lineage(shares.withColumn("bucket", bucket("n")))

    def leading_terms(self, top: int = TOP) -> DataFrame:
        """(lang, source, item, value, rank): the terms of each source whose share is over the language's by most, ties in byte order.

        A round evaluates each source's best buckets, as many as hold the terms still asked for at least, keeps the best terms of this and the
        earlier rounds, and drops the buckets whose bound is strictly below the kth of them, or not over zero. Rounds go on until no bucket is left.
        """
        bounds = self.postings.groupBy(*GROUP, "bucket").agg(F.count("*").alias("terms"), (F.max("p") - F.min("q")).alias("bound")).where("bound > 0")
        order = Window.partitionBy(*GROUP).orderBy(F.desc("bound"), "bucket")
        left = cut_lineage(bounds.withColumn("ahead", F.sum("terms").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("terms")))
        best_first = Window.partitionBy(*GROUP).orderBy(F.desc("value"), "item")
        best, wanted = None, top
        while not left.isEmpty():
            now = left.where(F.col("ahead") < wanted)
            found = self.postings.join(now.select(*GROUP, "bucket"), [*GROUP, "bucket"]).where("p > q").select(*GROUP, F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
            found = found if best is None else found.unionByName(best.drop("rank"))
            best = cut_lineage(found.withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= top))
            kth = best.where(F.col("rank") == top).select(*GROUP, F.col("value").alias("kth"))
            left = cut_lineage(left.where(F.col("ahead") >= wanted).join(kth, GROUP, "left").where("kth IS NULL OR bound >= kth").drop("kth"))
            wanted *= WIDEN
        if best is None:
            return self.groups.where("false").select(*GROUP, F.lit("").alias("item"), F.lit(0).cast("long").alias("value"), F.lit(1).alias("rank"))
        return best

    def pair_distances(self) -> DataFrame:
        """(lang, source, item, value): for each two sources of a language the sum of f over all kept terms, in both directions.

        A term that only one source has counts as if both lacked it, plus what its histogram says; terms of both are mended by met().
        """
        own = self.groups.select("lang", "source", "zero", "own", "vocabulary")
        other = self.groups.select("lang", F.col("source").alias("item"), F.col("zero").alias("other_zero"), F.col("own").alias("other_own"))
        pairs = own.join(other, "lang").where("source <> item")
        # of each source: the sum of abs(p - z) over its terms, z the zero of the other
        histogram = self.postings.groupBy(*GROUP, "p").agg(F.count("*").alias("m"))
        marks = histogram.select(*GROUP, F.lit(None).cast("string").alias("item"), F.col("p").alias("v"), "m")
        asked = pairs.select("lang", "source", "item", F.col("other_zero").alias("v"), F.lit(0).cast("long").alias("m"))
        up_to = Window.partitionBy(*GROUP).orderBy("v").rangeBetween(Window.unboundedPreceding, 0)
        whole = Window.partitionBy(*GROUP)
        sums = marks.unionByName(asked).withColumns({"m0": F.sum("m").over(up_to), "s0": F.sum(F.col("m") * F.col("v")).over(up_to), "m1": F.sum("m").over(whole), "s1": F.sum(F.col("m") * F.col("v")).over(whole)})
        alone = sums.where("item IS NOT NULL").select("lang", "source", "item", F.expr("m0 * v - s0 + (s1 - s0) - (m1 - m0) * v").alias("alone"))
        turned = alone.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), F.col("alone").alias("other_alone"))
        key = ["lang", "source", "item"]
        out = pairs.join(alone, key).join(turned, key).join(self.met(), key, "left")
        neither = (F.col("vocabulary") - F.col("own") - F.col("other_own")) * F.abs(F.col("zero") - F.col("other_zero"))
        value = F.when(F.col("vocabulary") == 0, F.lit(0)).otherwise(F.col("alone") + F.col("other_alone") + neither + F.coalesce("mend", F.lit(0)))
        return out.select(*key, value.cast("long").alias("value"))

    def met(self) -> DataFrame:
        """(lang, source, item, mend): over the terms that both have, abs(p - p') in place of what histograms and zeros count for them.

        A term's postings stand together; a task adds up pairs of sources over a block of terms and passes sums on, never pairs of a term.
        """
        rows = self.postings.join(self.groups.select(*GROUP, "zero"), GROUP).select("lang", "term", "source", "p", "zero")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block in whole_terms(batches):
                lang, source = (block.column(i).combine_chunks().dictionary_encode() for i in (0, 2))
                codes = source.indices.to_numpy().astype(np.int64) + lang.indices.to_numpy().astype(np.int64) * len(source.dictionary)
                p, zero = (block.column(i).to_numpy() for i in (3, 4))
                for left, right in met_pairs(term_ends(block)):
                    mend = np.abs(p[left] - p[right]) - np.abs(p[left] - zero[right]) - np.abs(p[right] - zero[left]) + np.abs(zero[left] - zero[right])
                    keys, first, at = np.unique(codes[left] * len(source.dictionary) + codes[right] % len(source.dictionary), return_index=True, return_inverse=True)
                    sums = np.zeros(len(keys), np.int64)
                    np.add.at(sums, at, mend)
                    of = [block.column(i).take(pa.array(x[first])).combine_chunks() for i, x in ((0, left), (2, left), (2, right))]
                    yield pa.RecordBatch.from_arrays([*of, pa.array(sums)], names=["lang", "source", "item", "mend"])

        sorted_rows = rows.repartition("lang", "term").sortWithinPartitions("lang", "term", "source")
        half = sorted_rows.mapInArrow(run, "lang string, source string, item string, mend long").groupBy("lang", "source", "item").agg(F.sum("mend").alias("mend"))
        return half.unionByName(half.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "mend"))


def term_ends(block: pa.Table) -> np.ndarray:
    """For each row of a block (lang, term, ...) in order, the row after the last one of its term."""
    lang, term = (block.column(i).combine_chunks().dictionary_encode().indices.to_numpy() for i in (0, 1))
    last = np.flatnonzero(np.append((lang[1:] != lang[:-1]) | (term[1:] != term[:-1]), len(lang) > 0))
    return np.repeat(last + 1, np.diff(last, prepend=-1))


def whole_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches in order of (lang, term), cut between terms."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        block = pa.Table.from_batches([*held, batch])
        ends = term_ends(block)
        cut = int(np.searchsorted(ends, len(ends))) if len(ends) else 0
        if cut:
            yield block.slice(0, cut)
            block = block.slice(cut)
        held = block.to_batches()
    if held:
        yield pa.Table.from_batches(held)


def met_pairs(ends: np.ndarray, most: int = PAIRS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows of one term, as positions (earlier, later), about `most` at a time."""
    after = ends - np.arange(len(ends)) - 1
    done = np.concatenate([[0], np.cumsum(after)])
    at = 0
    while at < len(ends):
        to = max(at + 1, int(np.searchsorted(done, done[at] + most, side="right")) - 1)
        left = np.repeat(np.arange(at, to), after[at:to])
        if len(left):
            yield left, left + 1 + np.arange(len(left)) - (done[left] - done[at])
        at = to


def audited(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): part `pair` is every other source by distance, part `term` the leading terms.

    Null texts, languages and sources count as ''; a repeated row is a document of its own; ids play no part, so null ones don't either. Sources without a
    kept term have pairs, all at the zeros' distance, and no terms; a language of one source has no pairs. Ties go by the items' bytes. An empty table gives no rows. Very long texts are
    read whole. Other columns, whatever their names, are left out.
    """
    audit = Audit(docs, text_col, lang_col, source_col, min_docs)
    ranked = Window.partitionBy(*GROUP).orderBy(F.desc("value"), "item")
    pairs = audit.pair_distances().withColumn("rank", F.row_number().over(ranked))
    parts = [df.select(*GROUP, F.lit(part).alias("part"), "item", "value", "rank") for part, df in (("pair", pairs), ("term", audit.leading_terms(top)))]
    return parts[0].unionByName(parts[1])


def oracle_sql(min_docs: int = MIN_DOCS, top: int = TOP) -> str:
    """The same rows by counting every term in every source."""
    p = f"(1 + {UNIT}::HUGEINT * (%s + {SMOOTH}) // (%s + {SMOOTH} * v))::BIGINT"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
w AS (SELECT id, lang, source, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')) AS term FROM d),
v AS (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT id) >= {min_docs}),
l AS (SELECT lang, count(*) AS v, sum(n) AS total FROM v GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM w GROUP BY ALL),
f AS (SELECT lang, source, term, v.n AS of_lang, coalesce(c.n, 0) AS n FROM g JOIN v USING (lang) LEFT JOIN c USING (lang, source, term)),
s AS (SELECT f.*, l.v, l.total AS of_all, sum(f.n) OVER (PARTITION BY lang, source) AS total FROM f JOIN l USING (lang)),
p AS (SELECT lang, source, term, n, {p % ("n", "total")} AS p, {p % ("of_lang", "of_all")} AS q FROM s),
x AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL),
pairs AS (SELECT lang, a.source, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b USING (lang) LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source WHERE a.source <> b.source),
terms AS (SELECT lang, source, term AS item, p - q AS value FROM p WHERE n > 0 AND p > q),
u AS (SELECT 'pair' AS part, * FROM pairs UNION ALL SELECT 'term', * FROM terms)
SELECT lang, source, part, item, value::BIGINT AS value, rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM u) WHERE part = 'pair' OR rank <= {top}"""
