"""Quality classifier: supervised subword embeddings.

A document is the average of learned vectors, one for each hashed word, each hashed word shape and each hashed
n-gram of its characters (across word borders, so that the shape of text counts too); a
linear layer with softmax tells the labels apart. Vectors and layer are trained together by
stochastic gradient descent in numpy, on a bounded sample of the labelled rows and by an executor, which
hands over a table of fixed size. As average and layer are linear, a trained bucket's vector acts through one number per label,
so scoring sums one table entry per n-gram.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orebed.llm.grams import features, row_sums
from orebed.llm.kernels import blocks, bucket_of, utf8

ORDERS = (2, 3, 4)
BITS = 16
DIM = 8
EPOCHS = 6
RATE = 0.5
#: Labelled documents that training uses at most; those of smallest hash are taken.
TRAIN_DOCS = 3000
#: Feature counts (8 bytes each) that training holds at most; the documents of largest hash are left out beyond it.
TRAIN_COUNTS = 24_000_000
#: Share of labelled documents kept back from the descent, on which the score is calibrated.
CALIBRATE = 4


class Subwords:
    """Bucket vectors, output layer and the calibration of their log-odds."""

    def __init__(self, bits: int = BITS, dim: int = DIM, seed: int = 0) -> None:
        rng = np.random.default_rng(seed)
        self.vectors = rng.uniform(-1 / dim, 1 / dim, (1 << bits, dim)).astype(np.float64)
        self.layer = np.zeros((dim, 2))
        self.bias = np.zeros(2)
        self.scale = (1.0, 0.0)

    def train(self, rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS, rate: float = RATE, seed: int = 0) -> None:
        """Descend on rows of (buckets, their counts, label), the labels weighted alike."""
        rng = np.random.default_rng(seed)
        labels = np.array([y for _, _, y in rows], dtype=np.int64)
        weight = len(rows) / (2 * np.maximum(np.bincount(labels, minlength=2), 1))
        for epoch in range(epochs):
            step = rate * (1 - epoch / epochs)
            for i in rng.permutation(len(rows)):
                at, count, y = rows[i]
                share = count / max(1, count.sum())
                mean = share @ self.vectors[at]
                z = mean @ self.layer + self.bias
                p = np.exp(z - z.max())
                grad = p / p.sum()
                grad[y] -= 1
                grad *= step * min(weight[y], 10.0)
                back = self.layer @ grad
                self.layer -= np.outer(mean, grad)
                self.bias -= 0.1 * grad
                # Buckets share the update by their part in the average, as a step on the average itself would.
                self.vectors[at] -= np.outer(share / max(float(share @ share), 1e-12) * 0.1, back)

    def table(self) -> np.ndarray:
        """What each bucket adds to the log-odds of label 1."""
        return self.vectors @ (self.layer[:, 1] - self.layer[:, 0])

    def log_odds(self, rows: list[tuple[np.ndarray, np.ndarray, int]]) -> np.ndarray:
        table = self.table()
        return np.array([(n @ table[at]) / max(1, n.sum()) for at, n, _ in rows]) + self.bias[1] - self.bias[0]

    def calibrate(self, rows: list[tuple[np.ndarray, np.ndarray, int]]) -> None:
        """Fit slope and shift of the log-odds by Newton steps (kept if the rows hold a single label)."""
        y = np.array([r[2] for r in rows], dtype=float)
        if not len(rows) or y.min() == y.max():
            return
        z = self.log_odds(rows)
        unit = max(float(np.abs(z).mean()), 1e-9)
        x = np.column_stack([z / unit, np.ones_like(z)])
        theta = np.array([1.0, 0.0])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
            hess = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + 0.05 * np.eye(2)
            theta -= np.linalg.solve(hess, x.T @ (p - y) + 0.05 * theta)
        if theta[0] > 0:
            self.scale = (float(theta[0] / unit), float(theta[1]))


def bags(batches: Iterator[pa.RecordBatch], text_col: str, orders: tuple[int, ...], bits: int) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray, np.ndarray]]:
    """For each row: its batch, its index, the buckets of its features and their counts."""
    for batch in blocks(batches, text_col):
        raw, offsets = utf8(batch.column(batch.schema.get_field_index(text_col)))
        found = features(raw, offsets, orders, bits)
        for i in range(batch.num_rows):
            counts = np.bincount(np.concatenate([at[first[i] : last[i]] for at, first, last in found]), minlength=1)
            at = np.flatnonzero(counts)
            yield batch, i, at, counts[at]


class Fitted(NamedTuple):
    """What scoring needs: each bucket's part in the log-odds, their bias, slope and shift of the calibration."""

    table: np.ndarray
    bias: float
    slope: float
    shift: float

    def scores(self, raw: np.ndarray, offsets: np.ndarray, orders: tuple[int, ...], bits: int) -> np.ndarray:
        total, n = np.zeros(len(offsets) - 1), np.zeros(len(offsets) - 1)
        for at, first, last in features(raw, offsets, orders, bits):
            total += row_sums(self.table[at], first, last)
            n += np.maximum(last - first, 0)
        z = (total / np.maximum(n, 1) + self.bias) * self.slope + self.shift
        return np.round(1 / (1 + np.exp(-np.clip(z, -40, 40))), 9)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", train_docs: int = TRAIN_DOCS, bits: int = BITS, orders: tuple[int, ...] = ORDERS, train_counts: int = TRAIN_COUNTS) -> Fitted:
    """Train on at most train_docs labelled documents; tasks count their features, and one descends on the counts.

    Labels must be 0 or 1; rows without one are left out, and of contradicting labels
    of an id the smaller counts. Rows are taken in the order of their ids' hashes, those of one id in that of
    their texts, repeated ones each; null texts are empty. Without any labelled document every score is 0.5.
    """
    chosen = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min(label_col).cast("int").alias("_label"))
    chosen = chosen.orderBy(F.xxhash64(id_col), id_col).limit(train_docs)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, i, at, counts in bags(batches, "text", orders, bits):
            yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(i, 1) for k in range(3)), pa.array([at.astype(np.int32)], pa.list_(pa.int32())), pa.array([counts.astype(np.int32)], pa.list_(pa.int32()))], names=["h", "g", "y", "at", "n"])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for y, at, n in zip(batch.column(2), batch.column(3), batch.column(4), strict=True):
                held += len(at)
                if held <= train_counts or not rows:
                    rows.append((at.values.to_numpy().copy(), n.values.to_numpy().copy(), y.as_py()))
        model = Subwords(bits)
        model.train([r for i, r in enumerate(rows) if i % CALIBRATE])
        model.calibrate(rows[::CALIBRATE])
        numbers = np.concatenate([model.table(), [model.bias[1] - model.bias[0], *model.scale]])
        yield pa.RecordBatch.from_arrays([pa.array([numbers.tobytes()], pa.binary())], names=["model"])

    # chosen has train_docs rows at most, so it is broadcast; the order does not depend on how rows were dealt.
    sample = docs.select(id_col, text_col).join(F.broadcast(chosen), id_col).select(F.xxhash64(id_col).alias("h"), F.xxhash64(text_col).alias("g"), F.col("_label").alias("y"), F.col(text_col).alias("text"))
    counted = sample.mapInArrow(count, "h long, g long, y int, at array<int>, n array<int>")
    got = counted.repartition(1).sortWithinPartitions("h", "g").mapInArrow(train, "model binary").first()
    if got is None:  # no rows, so no task
        return Fitted(np.zeros(1 << bits), 0.0, 1.0, 0.0)
    numbers = np.frombuffer(got.model)
    return Fitted(numbers[:-3], *numbers[-3:].tolist())


def scored(docs: DataFrame, model: Fitted, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7, orders: tuple[int, ...] = ORDERS, bits: int = BITS) -> DataFrame:
    """(id, score, predicted): score from 0 to 1 (higher: label 1 likelier), predicted 1 if score >= threshold.

    Null and empty texts are scored by the bias alone. Each row gives one row, repeated rows and null ids too; an empty table
    gives none. Long texts are scored whole. Rows are neither joined nor moved, other columns not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, text_col):
            score = shared.value.scores(*utf8(batch.column(batch.schema.get_field_index(text_col))), orders, bits)
            keep = [c for c in batch.schema.names if c != text_col]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in keep), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=[*keep, "score", "predicted"])

    id_type = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {id_type}, score double, predicted int")


def kept(docs: DataFrame, model: Fitted, text_col: str = "text", threshold: float = 0.7, orders: tuple[int, ...] = ORDERS, bits: int = BITS) -> DataFrame:
    """The rows of docs that the model accepts, unchanged and with all columns, in one pass."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in blocks([batch], text_col):
                good = shared.value.scores(*utf8(part.column(part.schema.get_field_index(text_col))), orders, bits) >= threshold
                yield batch.slice(at, part.num_rows).filter(pa.array(good))
                at += part.num_rows

    return docs.mapInArrow(run, docs.schema)


def held_out(id_col: str = "doc_id", modulus: int = 4, remainder: int = 2) -> F.Column:
    """Whether a row is kept from training; rows without an id are not."""
    return F.coalesce(bucket_of(id_col, modulus) == remainder, F.lit(False))
