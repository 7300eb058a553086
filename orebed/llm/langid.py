"""Language identification by language-bitmask n-gram filters.

A bit-sliced Bloom filter holds all languages at once: each slot is a mask with one bit
per language, and an n-gram sets its languages' bits in a few slots. The intersection of an n-gram's slots names
all languages that contain it. A text's n-grams are counted for each language; filter
fill tells how many of them would hit by chance, which is taken off, and the largest share decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orebed.llm.grams import byte_grams, row_sums, slots
from orebed.llm.kernels import blocks, utf8

ORDERS = (3, 4)
BITS = 18
HASHES = 2
#: Documents of each language that the filters learn from, about (a threshold on the id's hash draws them).
DOCS_PER_LANGUAGE = 600
#: An n-gram belongs to a language if this share of its sampled documents have it.
MIN_SHARE = 0.02
WORD = 64


@dataclass
class LanguageFilters:
    """masks: (slots, words) of uint64; languages: names by bit; fill: share of set slots of each bit."""

    languages: list[str]
    masks: np.ndarray
    fill: np.ndarray
    bits: int
    hashes: int


def build(grams: dict[str, np.ndarray], bits: int = BITS, hashes: int = HASHES) -> LanguageFilters:
    """Filters from each language's n-grams."""
    languages = sorted(grams)
    masks = np.zeros((1 << bits, max(1, -(-len(languages) // WORD))), dtype=np.uint64)
    for i, lang in enumerate(languages):
        for k in range(hashes):
            masks[slots(grams[lang], k, bits), i // WORD] |= np.uint64(1 << (i % WORD))
    fill = np.array([((masks[:, i // WORD] >> np.uint64(i % WORD)) & np.uint64(1)).mean() for i in range(len(languages))])
    return LanguageFilters(languages, masks, fill, bits, hashes)


def lowered(column: pa.Array) -> pa.Array:
    return pa.array([t.lower() for t in column.to_pylist()], pa.large_string())


def _grams(raw: np.ndarray, offsets: np.ndarray, orders: tuple[int, ...]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for n in orders:
        yield byte_grams(raw, n) + np.uint64(n << 56), offsets[:-1], np.maximum(offsets[1:] - n + 1, offsets[:-1])


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = DOCS_PER_LANGUAGE, min_share: float = MIN_SHARE, bits: int = BITS, hashes: int = HASHES, orders: tuple[int, ...] = ORDERS) -> LanguageFilters:
    """Learn from rows with a language; about per_language rows of each are drawn by a hash of the id.

    Rows are counted and drawn without moving texts; n-grams are counted by Spark, and those of too few documents go.
    """
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    sizes = {r[0]: r[1] for r in known.groupBy(lang_col).count().collect()}
    if not sizes:
        return build({}, bits, hashes)
    rate = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, per_language / n))])[F.col(lang_col)]
    draw = F.pmod(F.xxhash64(F.col(id_col), F.lit("draw")), F.lit(1 << 20)) / float(1 << 20)
    sample = known.where(draw < rate).select(lang_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, text_col):
            raw, offsets = utf8(lowered(batch.column(1)))
            found = list(_grams(raw, offsets, orders))
            for i in range(batch.num_rows):
                own = np.unique(np.concatenate([g[first[i] : last[i]] for g, first, last in found]))
                own = np.append(own, np.uint64(0))  # 0 counts the documents
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1).take(pa.array(np.zeros(len(own), np.int32))), pa.array(own.view(np.int64))], names=["lang", "gram"])

    counts = sample.mapInArrow(run, "lang string, gram long").groupBy("lang", "gram").count()
    drawn = {r[0]: r[1] for r in counts.where("gram = 0").select("lang", "count").collect()}
    least = F.create_map(*[F.lit(x) for lang, n in drawn.items() for x in (lang, max(2.0, min_share * n) if n > 2 else 1.0)])[F.col("lang")]
    got = counts.where((F.col("gram") != 0) & (F.col("count") >= least)).select("lang", "gram").toArrow()
    lang, gram = np.array(got.column("lang").to_pylist(), dtype=object), got.column("gram").to_numpy().view(np.uint64)
    return build({name: np.sort(gram[lang == name]) for name in drawn}, bits, hashes)


def predicted(docs: DataFrame, filters: LanguageFilters, id_col: str = "doc_id", text_col: str = "text", orders: tuple[int, ...] = ORDERS) -> DataFrame:
    """(id, lang_pred, score): the language with most n-grams beyond chance, and its share of all languages' counts.

    Null texts and texts without a letter are `und` with score 0; so are all if no language was learned. Ties
    go to the language first in order; a text none of whose n-grams is known gets the first language and score 0.
    """
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = shared.value
        chance = f.fill**f.hashes
        for batch in blocks(batches, text_col):
            texts = lowered(batch.column(1))
            raw, offsets = utf8(texts)
            hits, n = np.zeros((batch.num_rows, len(f.languages))), np.zeros(batch.num_rows)
            for gram, first, last in _grams(raw, offsets, orders):
                mask = f.masks[slots(gram, 0, f.bits)]
                for k in range(1, f.hashes):
                    mask &= f.masks[slots(gram, k, f.bits)]
                for i in range(len(f.languages)):
                    hits[:, i] += row_sums((mask[:, i // WORD] >> np.uint64(i % WORD)) & np.uint64(1), first, last)
                n += last - first
            real = np.maximum((hits - n[:, None] * chance) / np.maximum(1 - chance, 1e-9), 0)
            best = real.argmax(axis=1) if len(f.languages) else np.zeros(len(n), int)
            total = real.sum(axis=1)
            lettered = [_has_letter(t) for t in texts.to_pylist()]
            score = np.where(np.array(lettered, dtype=bool) & (total > 0), (real.max(axis=1) if len(f.languages) else total) / np.maximum(total, 1e-12), 0.0)
            names = [f.languages[b] if ok and f.languages else "und" for b, ok in zip(best, lettered, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(np.round(np.clip(score, 0, 1), 9))], names=[id_col, "lang_pred", "score"])

    id_type = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {id_type}, lang_pred string, score double")


def _has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)
