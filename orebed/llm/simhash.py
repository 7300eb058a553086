"""SimHash near-duplicates: Gray-ordered hierarchical index over masked bit patterns.

Texts become 64-bit fingerprints, equal fingerprints one class. Any two classes at
radius or fewer differing bits agree on at least two of radius + 2 bit blocks, so a
class is filed under the pattern of each pair of blocks: these masked patterns are the
upper nodes of the index, and the keys that Spark deals out. Below an upper node the
fingerprints stand in Gray rank order; runs of them share further bits, which their
inner node holds once. A search adds up the differing bits on its way down and leaves
a whole run as soon as they exceed the radius, or when the run is in its component already.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orebed.llm.components import connected_components
from orebed.llm.kernels import cut_lineage, unused

FANOUT = 8
#: Classes below one upper node that a single task indexes; more are dealt as pairs of chunks.
NODE_ROWS = 20_000
#: How often a larger upper node is parted by further bits before its classes are dealt as pairs of chunks.
DEPTH = 2
#: (query, node) pairs that a search of an index holds at once.
PAIRS = 1 << 20
#: Bytes of a text that are cut into words at once.
PIECE = 1 << 18
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def _pieces(text: bytes) -> Iterator[bytes]:
    """text in pieces of about PIECE bytes, cut in white space."""
    at = 0
    while len(text) - at > PIECE:
        space = _SPACE.search(text, at + PIECE)
        to = space.start() if space else len(text)
        yield text[at:to]
        at = to
    yield text[at:]


def fingerprint(text: bytes, size: int = 4) -> int:
    """SimHash of lower-cased word shingles by XXH64 (seed 42); 0 without words.

    A long text is hashed a piece at a time, each with the last size - 1 words of the one before.
    """
    h, counts, n, words = xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64), 0, []
    for piece in _pieces(text):
        words += piece.lower().split()
        if len(words) < size:
            continue
        hashes = np.fromiter((h(b" ".join(words[i : i + size]), 42) for i in range(len(words) - size + 1)), dtype=np.uint64, count=len(words) - size + 1)
        counts += _ones(hashes)
        n += len(hashes)
        words = words[len(words) - size + 1 :]
    if not n and words:
        counts, n = _ones(np.array([h(b" ".join(words), 42)], dtype=np.uint64)), 1
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big") if n else 0


def _ones(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes set each of their 64 bits, the highest first."""
    return np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4) -> DataFrame:
    """(id, fp long): the fingerprint of every whole text; a null text counts as empty."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint((t.as_py() or "").encode("utf-8", "surrogatepass"), size) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(fps, dtype=np.uint64).view(np.int64))], names=[id_col, "fp"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {id_type}, fp long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Position of each 64-bit word in the binary-reflected Gray sequence."""
    for s in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(s))
    return x


def masks(radius: int) -> list[int]:
    """The masks of all pairs of radius + 2 blocks that cover 64 bits."""
    return [a | b for a, b in combinations(_parts(range(64), radius + 2), 2)]


def finer(mask: int, radius: int) -> list[int]:
    """mask with each of radius + 1 blocks of its other bits: words that agree in mask and differ in at most radius bits agree in one of these."""
    return [mask | p for p in _parts([i for i in range(64) if not mask >> i & 1], radius + 1)]


def _parts(bits: Sequence[int], n: int) -> list[int]:
    cuts = [round(len(bits) * i / n) for i in range(n + 1)]
    return [sum(1 << i for i in bits[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


class GrayIndex:
    """Hierarchical index over one upper node's distinct fingerprints."""

    def __init__(self, fps: np.ndarray) -> None:
        self.fps = fps[np.argsort(gray_rank(fps), kind="stable")]
        levels = [(self.fps, np.full(len(fps), np.uint64(0xFFFFFFFFFFFFFFFF)))]
        while len(levels[0][0]) > 1:
            pattern, shared = levels[0]
            at = np.arange(0, len(pattern), FANOUT)
            ones = np.bitwise_and.reduceat(pattern | ~shared, at)
            zeros = np.bitwise_or.reduceat(pattern & shared, at)
            same = np.bitwise_and.reduceat(shared, at) & ~(ones ^ zeros)
            levels.insert(0, (zeros & same, same))
        #: From the root down: pattern, and the bits which all below share and no node above holds.
        self.levels = []
        for d, (pattern, shared) in enumerate(levels):
            above = levels[d - 1][1][np.arange(len(pattern)) // FANOUT] if d else np.uint64(0)
            self.levels.append((pattern, shared & ~above))

    def components(self, radius: int, pairs: int = PAIRS) -> np.ndarray:
        """For each fingerprint the smallest index that links of at most radius bits lead to within this node.

        As many fingerprints are looked up together as give at most about pairs (query, node) pairs, should nothing be pruned.
        """
        n = len(self.fps)
        comp = np.arange(n)
        step = max(1, min(256, pairs // max(n, 1)))
        seen, joined = None, []
        for at in range(0, n, step):
            q = np.arange(at, min(n, at + step))
            if comp is not seen:
                seen, joined = comp, [np.where((lo := np.minimum.reduceat(comp, np.arange(0, n, s))) == np.maximum.reduceat(comp, np.arange(0, n, s)), lo, -1) for s in (FANOUT ** np.arange(len(self.levels) - 1, -1, -1)).tolist()]
            node, acc = np.zeros(len(q), dtype=np.int64), None
            for d, (pattern, own) in enumerate(self.levels):
                if d:
                    node = (node[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                    q, acc = np.repeat(q, FANOUT), np.repeat(acc, FANOUT)
                    q, acc, node = (x[node < len(pattern)] for x in (q, acc, node))
                diff = np.bitwise_count((self.fps[q] ^ pattern[node]) & own[node]).astype(np.int64)
                acc = diff if acc is None else acc + diff
                near = (acc <= radius) & (joined[d][node] != comp[q])
                q, acc, node = q[near], acc[near], node[near]
            comp = _merged(comp, q, node)
        return comp


def _merged(comp: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """comp after joining the components of a and b."""
    while len(a):
        x, y = comp[a], comp[b]
        lo, hi = np.minimum(x, y), np.maximum(x, y)
        if not (differ := lo != hi).any():
            break
        a, b = a[differ], b[differ]
        root = np.arange(len(comp))
        np.minimum.at(root, hi[differ], lo[differ])
        while (root[root] != root).any():
            root = root[root]
        comp = root[comp]
    return comp


def _links_of_sorted(node: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning set of links within each run of equal node."""
    first = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
    size = np.diff(np.concatenate([first, [len(node)]]))
    small = np.repeat(size, size) <= 2 * FANOUT
    a, b = [], []
    for d in range(1, 2 * FANOUT):
        i = np.flatnonzero((node[:-d] == node[d:]) & small[:-d]) if len(node) > d else np.zeros(0, np.int64)
        if not len(i):
            break
        i = i[np.bitwise_count(fps[i] ^ fps[i + d]) <= radius]
        a.append(fps[i])
        b.append(fps[i + d])
    for f, s in zip(first[size > 2 * FANOUT], size[size > 2 * FANOUT], strict=True):
        index = GrayIndex(np.unique(fps[f : f + s]))
        comp = index.components(radius)
        moved = np.flatnonzero(comp != np.arange(len(comp)))
        a.append(index.fps[moved])
        b.append(index.fps[comp[moved]])
    return np.concatenate(a or [fps[:0]]), np.concatenate(b or [fps[:0]])


def _search(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Rows (node, fp) sorted by node: a node that a batch cuts is kept for the next one."""
    kept_node, kept_fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)

    def out(node: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        a, b = _links_of_sorted(node, fps, radius) if len(node) > 1 else (fps[:0], fps[:0])
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    for batch in batches:
        node = np.concatenate([kept_node, batch.column(0).to_numpy()])
        fps = np.concatenate([kept_fp, batch.column(1).to_numpy().view(np.uint64)])
        if not len(node):
            continue
        cut = int(np.searchsorted(np.cumsum(node[1:] != node[:-1]), (node[1:] != node[:-1]).sum(), side="left")) + 1 if (node != node[-1]).any() else 0
        yield from out(node[:cut], fps[:cut])
        kept_node, kept_fp = node[cut:], fps[cut:]
    yield from out(kept_node, kept_fp)


def links(classes: DataFrame, radius: int = 4, node_rows: int = NODE_ROWS, depth: int = DEPTH) -> DataFrame:
    """Links (a, b) between distinct fingerprints of column fp that span the same components as all pairs at radius or fewer bits.

    An upper node with more than node_rows classes is parted by each of radius + 1 blocks of its
    other bits, up to depth times. What is larger still (classes that share nearly all of their bits)
    is dealt as all pairs of its chunks, each a task of at most twice node_rows, so that no key is gathered whole.
    """
    level = masks(radius)
    under = lambda m: F.struct(m.alias("mask"), F.col("fp").bitwiseAND(m).alias("pattern"))
    filed = classes.where("fp IS NOT NULL").select("fp", F.explode(F.array(*[under(F.lit(_signed(m))) for m in level])).alias("n")).select("n.*", "fp")
    ready, chunks = [], F.lit(None).cast("int")
    for deep in range(depth + 1):
        counted = filed.groupBy("mask", "pattern").count().where(F.col("count") > node_rows)
        large = cut_lineage(counted.select("mask", "pattern", F.ceil(F.col("count") / node_rows).cast("int").alias("chunks")))
        if large.isEmpty():
            break
        if deep == depth:
            chunks, filed = F.col("chunks"), filed.join(large, ["mask", "pattern"], "left")
            break
        ready.append(filed.join(large, ["mask", "pattern"], "left_anti"))
        parts = F.create_map(*[x for m in level for x in (F.lit(_signed(m)), F.array(*[F.lit(_signed(p)) for p in finer(m, radius)]))])
        over = filed.join(large, ["mask", "pattern"], "left_semi").select("fp", F.explode(parts[F.col("mask")]).alias("mask"))
        filed = over.select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("pattern"), "fp")
        level = list(dict.fromkeys(p for m in level for p in finer(m, radius)))
    chunk = F.pmod(F.xxhash64("fp"), chunks).cast("int")
    pairs = F.when(chunks.isNull(), F.array(F.lit(0))).otherwise(F.transform(F.sequence(F.lit(0), chunks - 1), lambda j: F.least(chunk, j) * chunks + F.greatest(chunk, j)))
    dealt = filed.select("mask", "pattern", "fp", F.explode(pairs).alias("pair")).select(F.xxhash64("mask", "pattern", "pair").alias("node"), "fp")
    for part in ready:
        dealt = dealt.unionByName(part.select(F.xxhash64("mask", "pattern", F.lit(0)).alias("node"), "fp"))
    return dealt.repartition("node").sortWithinPartitions("node").mapInArrow(lambda it: _search(it, radius), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4, radius: int = 4, node_rows: int = NODE_ROWS) -> DataFrame:
    """(id, fp long, component_id): one row per document; component_id is the smallest id that links reach.

    Null texts are empty; documents without words have fingerprint 0, which links like any other.
    Repeated rows stay, each with its component. Null ids get their component too and are
    never its name, unless all its ids are null (then it is null). A very long text is hashed a piece
    at a time. An empty table gives no rows. Other columns are not touched.
    """
    fps = cut_lineage(fingerprints(docs, id_col, text_col, size))
    classes = fps.groupBy("fp").agg(F.min(id_col).alias("low"))
    roots = connected_components(links(classes, radius, node_rows)).withColumnRenamed("vertex", "fp")
    named = classes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    names = named.groupBy("root").agg(F.min("low").alias("component_id"))
    of_class = named.join(names, "root").select("fp", "component_id")
    return fps.join(of_class, "fp").select(id_col, "fp", "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how: int) -> DataFrame:
    """docs without near-duplicates: of each component the document with the smallest id stays.

    Where that id's row is repeated, one copy stays. Rows without an id can't be named and all stay.
    """
    found = near_duplicates(docs, id_col, text_col, **how)
    mark = unused(docs, "_repeated")
    chosen = found.where(F.col(id_col) == F.col("component_id")).groupBy(id_col).agg((F.count("*") > 1).alias(mark))
    kept = docs.join(chosen, id_col)
    once = kept.where(~F.col(mark)).drop(mark)
    again = kept.where(F.col(mark)).drop(mark).dropDuplicates([id_col])
    return once.unionByName(again).unionByName(docs.where(F.col(id_col).isNull())).select(docs.columns)
