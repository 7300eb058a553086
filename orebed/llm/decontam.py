"""Benchmark decontamination by greedy string tiling.

Runs of five words that a document shares with a benchmark item are seeds: only a pair with
seeds can have tiles, and only the words under them can belong to one. Documents are searched for each item's rarest seeds, as many as a leak can't do without. Tiles are then marked
greedily: matches of a length are found by running Karp-Rabin hashes over unmarked words, the longest are
marked first, matches that overlap marked words are dropped, and the search length falls until the
least tile length. An item is leaked if tiles cover enough of its words, in whatever order they stand in the document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orebed.llm.kernels import SIGNS, Words, blocks, unused, utf8

#: Words in a seed and in the shortest tile.
SEED_WORDS = 5
#: Share of an item's words under tiles from which on it is leaked.
COVERAGE = 0.6
#: Benchmark words up to which it is broadcast (16 MB of hashes); a larger one is joined by seeds.
BROADCAST_WORDS = 2_000_000
FILTER_BITS = 20
#: Parts that texts with one seed are dealt in where the benchmark is joined.
SALTS = 16
_PRIME = (1 << 61) - 1
_BASE = 0x5DEECE66D


def word_hashes(texts: list[str]) -> list[np.ndarray]:
    """The word hashes of each text: lower-cased in A-Z, parted by white space and ASCII signs."""
    raw, offsets = utf8(pa.array(texts, pa.large_string()))
    words = Words(raw, offsets, SIGNS)
    return [words.hash[a:b] for a, b in zip(words.first, words.first[1:], strict=False)]


def tiles(doc: list[int], item: list[int], least: int = SEED_WORDS) -> list[tuple[int, int, int]]:
    """Non-overlapping matches (doc start, item start, length), the longest first, of at least least words."""
    prefix = []
    for words in (doc, item):
        sums = [0]
        for w in words:
            sums.append((sums[-1] * _BASE + w) % _PRIME)
        prefix.append(sums)
    free = [[True] * len(doc), [True] * len(item)]
    out: list[tuple[int, int, int]] = []
    size = max(least, min(len(doc), len(item)))
    while size >= least:
        power = pow(_BASE, size, _PRIME)
        table: dict[int, list[int]] = {}
        for j in _open(free[1], size):
            table.setdefault((prefix[1][j + size] - prefix[1][j] * power) % _PRIME, []).append(j)
        found = []
        for i in _open(free[0], size) if table else ():
            for j in table.get((prefix[0][i + size] - prefix[0][i] * power) % _PRIME, ()):
                if doc[i : i + size] != item[j : j + size] or (i and j and free[0][i - 1] and free[1][j - 1] and doc[i - 1] == item[j - 1]):
                    continue  # not equal, or part of a match that starts before
                k = size
                while i + k < len(doc) and j + k < len(item) and free[0][i + k] and free[1][j + k] and doc[i + k] == item[j + k]:
                    k += 1
                found.append((k, i, j))
        again = False
        for k, i, j in sorted(found, key=lambda m: (-m[0], m[1], m[2])):
            if all(free[0][i : i + k]) and all(free[1][j : j + k]):
                free[0][i : i + k] = free[1][j : j + k] = [False] * k
                out.append((i, j, k))
            else:
                again = True  # what is left of it may still be long enough
        if not again:
            size = size // 2 if size > 2 * least else size - 1 if size > least else 0
    return out


def _open(free: list[bool], size: int) -> Iterator[int]:
    """Starts of size free words in a row."""
    run = 0
    for i, f in enumerate(free):
        run = run + 1 if f else 0
        if run >= size:
            yield i - size + 1


def rare_seeds(places: np.ndarray, often: np.ndarray, n_words: int, size: int, least: float) -> np.ndarray:
    """Which of an item's seeds (their places, and how many items have each) to look for: without any of them the others can't cover enough of it.

    The rarest are taken until what is left covers too little, so that seeds which many items share are seldom looked for.
    """
    order = np.argsort(often, kind="stable")
    left = np.zeros(n_words + 1, dtype=np.int64)
    np.add.at(left, places, 1)
    np.add.at(left, np.minimum(places + size, n_words), -1)
    depth = np.cumsum(left)[:-1]
    covered = int((depth > 0).sum())
    taken = 0
    while taken < len(order) and covered >= least * n_words:
        p = int(places[order[taken]])
        part = depth[p : p + size]
        part -= 1
        covered -= int((part == 0).sum())
        taken += 1
    return order[:taken]


class Benchmark:
    """Items' words and seeds, and the seeds to look for sorted by hash behind a small bit table."""

    def __init__(self, ids: list, texts: list[str | None], size: int = SEED_WORDS, least: float = COVERAGE) -> None:
        self.size, self.least = size, least
        self.ids = ids
        self.words = word_hashes([t or "" for t in texts])
        self.seeds = [seed_hashes(w, size) for w in self.words]
        owner = np.repeat(np.arange(len(ids)), [len(s) for s in self.seeds]) if ids else np.zeros(0, np.int64)
        every = np.concatenate(self.seeds or [np.zeros(0, np.uint64)])
        self.size_all = len(every)
        values, inverse = np.unique(every, return_inverse=True)
        first = np.unique(np.stack([inverse, owner]), axis=1)[0] if len(every) else inverse
        often = np.bincount(first, minlength=len(values))[inverse] if len(every) else inverse
        start = np.concatenate([[0], np.cumsum([len(s) for s in self.seeds])]).astype(np.int64)
        sought = [start[i] + rare_seeds(np.arange(len(s)), often[start[i] : start[i + 1]], len(self.words[i]), size, least) for i, s in enumerate(self.seeds) if len(s)]
        at = np.concatenate(sought or [np.zeros(0, np.int64)]).astype(np.int64)
        order = np.argsort(every[at], kind="stable")
        self.hash, self.owner = every[at][order], owner[at][order].astype(np.int64)
        self.filter = np.zeros(1 << FILTER_BITS, dtype=bool)
        self.filter[(self.hash & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)] = True

    def hits(self, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into seeds, item) of all sought seeds that occur."""
        at = np.flatnonzero(self.filter[(seeds & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)])
        lo, hi = np.searchsorted(self.hash, seeds[at], "left"), np.searchsorted(self.hash, seeds[at], "right")
        n = hi - lo
        rank = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(at, n), self.owner[np.repeat(lo, n) + rank]

    def leaks(self, words: np.ndarray, seeds: np.ndarray, items: np.ndarray) -> Iterator[tuple[int, int, list[tuple[int, int, int]]]]:
        """(item, covered words, tiles) for those of items that a document's words, with their seeds, cover enough."""
        order = np.argsort(seeds, kind="stable")
        known = seeds[order]
        for item in np.unique(items):
            target, own = self.words[item], self.seeds[item]
            if len(target) < self.size:  # too short for seeds: it leaks where it is all there is
                if np.array_equal(words, target):
                    yield int(item), len(target), [(0, 0, len(target))]
                continue
            lo, hi = np.searchsorted(known, own, "left"), np.searchsorted(known, own, "right")
            under = np.zeros(len(target) + 1, dtype=np.int64)
            np.add.at(under, np.flatnonzero(hi > lo), 1)
            np.add.at(under, np.flatnonzero(hi > lo) + self.size, -1)
            if (np.cumsum(under)[:-1] > 0).sum() < self.least * len(target):
                continue  # not even all seeds together cover enough
            starts = np.flatnonzero(np.isin(seeds, own))
            keep = np.unique((starts[:, None] + np.arange(self.size)).ravel())
            gap = np.flatnonzero(np.diff(keep) > 1) + 1
            row = np.insert(words[keep].astype(object), gap, -1)  # no item has this word
            place = np.insert(keep, gap, -1)
            found = tiles(row.tolist(), target.tolist(), self.size)
            covered = sum(k for _, _, k in found)
            if covered >= self.least * len(target):
                yield int(item), covered, sorted((int(place[i]), j, k) for i, j, k in found)


def seed_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of size words; of all words together, if there are fewer (none without words)."""
    n = max(0, len(words) - size + 1)
    if not n and len(words):
        return seed_hashes(words, len(words)) ^ np.uint64(len(words))
    out = np.zeros(n, dtype=np.uint64)
    for j in range(size):
        out = out * np.uint64(0x9E3779B97F4A7C15) + words[j : j + n]
    return out ^ (out >> np.uint64(32))


def _leaks_of(part: pa.RecordBatch, text_col: str, bench: Benchmark) -> Iterator[tuple[int, int, int, list[tuple[int, int, int]]]]:
    """(row, item, covered words, tiles) of a block."""
    words = Words(*utf8(part.column(part.schema.get_field_index(text_col))), SIGNS)
    every = seed_hashes(words.hash, bench.size) if len(words.hash) >= bench.size else np.zeros(0, np.uint64)
    at, item = bench.hits(every)
    row = np.searchsorted(words.first, at, side="right") - 1
    inside = at + bench.size <= words.first[row + 1]
    rows = {int(r): item[inside][row[inside] == r] for r in np.unique(row[inside])}
    count = np.diff(words.first)
    for r in np.flatnonzero((count > 0) & (count < bench.size)).tolist():
        rows[r] = bench.hits(seed_hashes(words.hash[words.first[r] : words.first[r + 1]], bench.size))[1]
    for r, items in sorted(rows.items()):
        first, last = words.first[r], words.first[r + 1]
        for found in bench.leaks(words.hash[first:last], every[first : max(first, last - bench.size + 1)], items):
            yield r, *found


def _collected(bench: DataFrame, item_col: str, text_col: str, limit: int, least: float) -> Benchmark | None:
    """The benchmark on the driver, if it is small enough to be broadcast."""
    size = bench.agg(F.coalesce(F.sum(F.length(text_col)), F.lit(0))).first()[0]
    if size > 4 * limit:
        return None
    rows = bench.select(item_col, text_col).orderBy(item_col, text_col).collect()
    found = Benchmark([r[0] for r in rows], [r[1] for r in rows], least=least)
    return found if found.size_all <= limit else None


def leaked(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", coverage: float = COVERAGE, limit: int = BROADCAST_WORDS) -> DataFrame:
    """(id, item_id, coverage, matched_words, item_words, n_tiles, tiles) of each document and item whose words tiles cover to at least coverage.

    tiles: document word, item word and length of each, joined by colons and commas. Null texts are empty, and no words
    leak. An item of fewer than five words, too few for a tile, leaks into documents that hold its words and no others. Of matches equally long
    the first in the document is marked first. Repeated rows are each reported, null ids too; empty tables give no rows. Very long texts are
    searched whole; other columns are not read. Documents stay where they are if the benchmark has at most limit seeds; else both sides meet by seed hash.
    """
    id_type, item_type = (f[c].dataType.simpleString() for f, c in ((docs.schema, id_col), (bench.schema, item_col)))
    schema = f"`{id_col}` {id_type}, `{item_col}` {item_type}, coverage double, matched_words long, item_words long, n_tiles long, tiles string"
    names = [id_col, item_col, "coverage", "matched_words", "item_words", "n_tiles", "tiles"]
    small = _collected(bench, item_col, item_text, limit, coverage)
    types = [docs.select(id_col).limit(0).toArrow().schema.field(0).type, bench.select(item_col).limit(0).toArrow().schema.field(0).type]

    def report(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [*types, pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    def line(doc: object, item: object, words: int, covered: int, found: list[tuple[int, int, int]]) -> tuple:
        return doc, item, covered / words, covered, words, len(found), ",".join(f"{i}:{j}:{k}" for i, j, k in found)

    if small is not None:
        shared = docs.sparkSession.sparkContext.broadcast(small)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in blocks(batches, text_col):
                rows = [line(part.column(0)[r].as_py(), shared.value.ids[i], len(shared.value.words[i]), n, found) for r, i, n, found in _leaks_of(part, text_col, shared.value)]
                if rows:
                    yield report(rows)

        return docs.select(id_col, text_col).mapInArrow(run, schema)

    def seeds(batches: Iterator[pa.RecordBatch], every: bool = False) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches, "text"):
            words = Words(*utf8(part.column(1)), SIGNS)
            for r in range(part.num_rows):
                own = words.hash[words.first[r] : words.first[r + 1]]
                found = seed_hashes(own, SEED_WORDS)
                first = np.arange(len(found)) if every else np.unique(found, return_index=True)[1]
                found = found[first]
                if len(found):
                    where = pa.array(np.full(len(found), r))
                    yield pa.RecordBatch.from_arrays([part.column(0).take(where), pa.array(found.view(np.int64)), pa.array(first.astype(np.int32)), pa.array(np.full(len(found), len(own), np.int32))], names=["key", "seed", "at", "n"])

    def sought(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, n, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at, often, hashes = (np.array([s[k] for s in own]) for k in ("at", "often", "seed"))
                order = np.argsort(at)
                out += [(key, int(h)) for h in hashes[order][rare_seeds(at[order], often[order], n, SEED_WORDS, coverage)]]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out]), pa.array([o[1] for o in out], pa.int64())], names=["item_key", "seed"])

    def keyed(df: DataFrame, text: str) -> DataFrame:
        return df.where(F.col(text).isNotNull()).select(F.sha2(text, 256).alias("key"), F.col(text).alias("text"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text, item, target in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                one = Benchmark([item], [target], least=coverage)
                for _, _, n, found in _leaks_of(pa.record_batch([pa.array([text])], names=["text"]), "text", one):
                    rows.append(line(doc, item, len(one.words[0]), n, found))
            if rows:
                yield report(rows)

    # Equal texts are tiled once for their seeds; an item's and a text's digest stand for them until they are paired.
    kinds = "key string, seed long, at int, n int"
    left = keyed(docs, text_col).dropDuplicates(["key"]).mapInArrow(seeds, kinds).select("key", "seed", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int").alias("salt"))
    whole = keyed(bench, item_text).dropDuplicates(["key"]).mapInArrow(lambda it: seeds(it, True), kinds)
    own = whole.join(whole.groupBy("seed").agg(F.countDistinct("key").alias("often")), "seed").groupBy("key", "n").agg(F.collect_list(F.struct("at", "often", "seed")).alias("own"))
    right = own.select("key", "n", "own").mapInArrow(sought, "item_key string, seed long").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    pairs = left.join(right, ["seed", "salt"]).select("key", "item_key").distinct()  # a seed of a third of all texts is dealt over its salts
    items = bench.where(F.col(item_text).isNotNull()).select(F.sha2(item_text, 256).alias("item_key"), F.col(item_col).alias("_item"), F.col(item_text).alias("_target"))
    texts = docs.where(F.col(text_col).isNotNull()).select(F.sha2(text_col, 256).alias("key"), F.col(id_col).alias("_doc"), F.col(text_col).alias("_text"))
    return pairs.join(items, "item_key").join(texts, "key").select("_doc", "_text", "_item", "_target").mapInArrow(verify, schema)


def clean(docs: DataFrame, bench: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", coverage: float = COVERAGE, limit: int = BROADCAST_WORDS) -> DataFrame:
    """The rows of docs in which no item leaked, unchanged."""
    small = _collected(bench, item_col, item_text, limit, coverage)
    if small is None:
        key, digest = unused(docs, "_key"), F.sha2(text_col, 256)
        bad = leaked(docs.select(digest.alias(key), text_col), bench, key, text_col, item_col, item_text, coverage, limit).select(key).distinct()
        return docs.withColumn(key, digest).join(bad, key, "left_anti").drop(key)
    shared = docs.sparkSession.sparkContext.broadcast(small)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in blocks([batch], text_col):
                good = np.ones(part.num_rows, dtype=bool)
                good[[r for r, *_ in _leaks_of(part, text_col, shared.value)]] = False
                yield batch.slice(at, part.num_rows).filter(pa.array(good))
                at += part.num_rows

    return docs.mapInArrow(run, docs.schema)
