"""Vectorised helpers over Arrow string batches, shared by the operators of this subpackage.

All of them work on whole texts: a batch is only cut between documents, so
that the numpy temporaries of a task stay small whatever the batch size is.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes handled at once by the numpy kernels (a longer document is handled alone).
BLOCK_BYTES = 1 << 20

_WS = np.zeros(256, dtype=bool)
_WS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: White space and ASCII punctuation: what parts words where signs don't matter.
SIGNS = _WS.copy()
SIGNS[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True
#: Byte map that lower-cases A-Z only.
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder that the session names; where it names none, a local session takes a folder of its own and a cluster is an error."""
    if spark.sparkContext.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(shared or tempfile.mkdtemp(prefix="ckpt-"))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise df in the shared checkpoint folder, so that lost executors cost no recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table of a data folder; only Spark's reader touches the path."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def bucket_of(id_col: str, modulus: int) -> F.Column:
    """crc32 of the id as text, modulo modulus; null ids give null."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store that no later step reads."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def unused(df: DataFrame, name: str) -> str:
    """name, with underscores in front until df has no column of it in either case."""
    while name.lower() in {c.lower() for c in df.columns}:
        name = f"_{name}"
    return name


def blocks(batches: Iterator[pa.RecordBatch], text_col: str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches between rows so that each piece holds about limit text bytes; null texts become empty."""
    for batch in batches:
        i = batch.schema.get_field_index(text_col)
        text = pc.fill_null(batch.column(i), "")
        batch = batch.set_column(i, pa.field(text_col, text.type), text)
        sizes = np.cumsum(pc.binary_length(text).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            done = sizes[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(sizes, done + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's UTF-8 bytes and the offsets of its rows in them."""
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return raw, off - off[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit moves every output bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 20), base, dtype=np.uint64)
        have[0] = 1
        _POWERS[base] = have = np.cumprod(have)
    return have[:n]


class Words:
    """The words (runs of bytes other than x20 and x09-x0D, or than parting, with A-Z lower-cased) of a block of texts.

    hash: 64-bit hash of each word; start, end: its byte range in the block;
    first: for each document the index of its first word, and the word count at last.
    """

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, parting: np.ndarray = _WS) -> None:
        n = len(raw)
        solid = ~parting[raw]
        before = np.zeros(n, dtype=bool)
        after = np.zeros(n, dtype=bool)
        if n:
            before[1:] = solid[:-1]
            after[:-1] = solid[1:]
            inner = offsets[(offsets > 0) & (offsets < n)]
            before[inner] = False
            after[inner - 1] = False
        self.start = np.flatnonzero(solid & ~before)
        self.end = np.flatnonzero(solid & ~after) + 1
        self.first = np.searchsorted(self.start, offsets)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_BYTE[ASCII_LOWER[raw]] * _powers(_BASE, n), out=sums[1:])
        self.hash = mix((sums[self.end] - sums[self.start]) * _powers(_BASE_INV, n + 1)[self.start])

    def shingles(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the runs of size words of each document (of all its words, if it has fewer), and the offsets of the documents in them."""
        count = np.diff(self.first)
        n_sh = np.where(count >= size, count - size + 1, np.minimum(count, 1))
        first = np.concatenate([[0], np.cumsum(n_sh)])
        doc = np.repeat(np.arange(len(count)), n_sh)
        at = self.first[:-1][doc] + np.arange(first[-1]) - first[:-1][doc]
        out = np.zeros(len(at), dtype=np.uint64)
        left = self.first[1:][doc] - at
        for j in range(size):
            there = left > j
            h = self.hash[np.where(there, at + j, 0)] if len(self.hash) else np.zeros(len(at), np.uint64)
            out = out * np.uint64(_BASE) + np.where(there, h, np.uint64(0))
        return mix(out), first
