"""Chunks with provenance and claims with carried subjects, over all documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from orebed.operators import provenance as P
from orebed.queries.base import query, table

PAGED_SQL = """t AS (SELECT doc_id, text[:length(text) // 2] AS a, text[length(text) // 2 + 1:] AS b FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, 1 AS page, '# Section 1.2' || chr(10) || a || chr(10) AS part FROM t UNION ALL SELECT doc_id, 2, chr(10) || '## Rest of it' || chr(10) || b FROM t)"""
BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


@query("provenance_chunks", rf"""WITH RECURSIVE {PAGED_SQL},
c AS (SELECT doc_id, page, part, 0 AS start, -1 AS stop, -1 AS k, NULL::VARCHAR AS section, ''::VARCHAR AS chunk FROM p
UNION ALL SELECT doc_id, page, part, start, stop, k + 1, CASE WHEN head IS NULL OR head = '' THEN section WHEN regexp_extract(head, '^[\d.]+') <> '' THEN regexp_extract(head, '^[\d.]+') ELSE head END, chunk FROM (
SELECT *, coalesce(nullif(regexp_extract(h, '(?im)^#{{1,4}}\s+(?:Section\s+)?([\d.]+|.+)$', 1), ''), regexp_extract(h, '(?i)^Section\s+([\d.]+)', 1)) AS head FROM (
SELECT *, regexp_extract(chunk, '(?im)^#{{1,4}}\s+(?:Section\s+)?(?:[\d.]+|.+)$|^Section\s+[\d.]+') AS h FROM (
SELECT *, trim(part[start + 1:stop], {BLANKS}) AS chunk FROM (
SELECT *, CASE WHEN e < length(part) AND line > start + 450 THEN line ELSE e END AS stop FROM (
SELECT *, CASE WHEN strpos(reverse(part[start + 1:e]), chr(10)) > 0 THEN e - strpos(reverse(part[start + 1:e]), chr(10)) ELSE -1 END AS line FROM (
SELECT doc_id, page, part, k, section, start, least(length(part), start + 900) AS e FROM (
SELECT doc_id, page, part, k, section, CASE WHEN k < 0 THEN 0 ELSE greatest(start + 1, stop - 120) END AS start FROM c WHERE stop < length(part))))))) ))
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY page, k) - 1)::INT AS idx, page::INT AS page, section, chunk FROM c WHERE k >= 0 AND chunk <> ''""")
def provenance_chunks(spark, sf_dir):
    """Chunks of all documents, whose halves stand as two pages with a heading each."""
    n = F.floor(F.length("text") / 2).cast("int")
    text = F.concat(F.lit("# Section 1.2\n"), F.substring(F.col("text"), F.lit(1), n), F.lit("\n[PAGE 2]\n## Rest of it\n"), F.substring(F.col("text"), n + 1, F.length("text")))
    return P.chunked(table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", text.alias("text")), "doc_id", "text")


@query("carried_claims")
def carried_claims(spark, sf_dir):
    """Claims of all documents with the subjects that they carry on; tests/test_provenance.py holds them to worked cases."""
    return P.claimed(table(spark, sf_dir, "documents"), "doc_id", "text")
