"""Hashed n-gram views of a block of texts."""

from __future__ import annotations

import numpy as np

from orebed.llm.kernels import Words

_ODD = (np.arange(1, 33, 2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).tolist()
#: Kinds of bytes that word shapes tell apart.
_KIND = np.full(256, 1, dtype=np.uint64)
_KIND[list(range(97, 123))] = 2
_KIND[list(range(65, 91))] = 3
_KIND[list(range(48, 58))] = 4
_KIND[list(range(128, 256))] = 5


def byte_grams(raw: np.ndarray, n: int) -> np.ndarray:
    """The n bytes (n <= 8) from each position as one number; positions less than n from the end are left out."""
    if len(raw) < n:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(len(raw) - n + 1, dtype=np.uint64)
    for j in range(n):
        out |= raw[j : len(raw) - n + 1 + j].astype(np.uint64) << np.uint64(8 * j)
    return out


def slots(values: np.ndarray, salt: int, bits: int) -> np.ndarray:
    """A slot in 0 .. 2**bits - 1 for each value, by a multiplicative hash that salt chooses."""
    x = (values + np.uint64(salt + 1)) * np.uint64(_ODD[salt % len(_ODD)])
    x ^= x >> np.uint64(29)
    return ((x * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - bits)).astype(np.int64)


def row_sums(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Sum of values[first:last] for each row."""
    sums = np.concatenate([[0], np.cumsum(values, dtype=np.float64)])
    last = np.clip(last, 0, len(values))
    return sums[np.maximum(last, np.minimum(first, len(values)))] - sums[np.minimum(first, len(values))]


def characters(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code points of a block of UTF-8 texts, and the offsets of its rows in them (bytes that are no UTF-8 stand for themselves)."""
    if not len(raw) or raw.max() < 128:
        return raw, offsets
    firsts = (raw & 0xC0) != 0x80
    codes = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(codes) != firsts.sum():
        return raw, offsets
    return codes, np.concatenate([[0], np.cumsum(firsts)])[offsets]


def char_grams(codes: np.ndarray, n: int) -> np.ndarray:
    """A number for the n characters from each position; positions less than n from the end are left out."""
    if len(codes) < n:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(len(codes) - n + 1, dtype=np.uint64)
    for j in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + codes[j : len(codes) - n + 1 + j].astype(np.uint64)
    return out


def features(raw: np.ndarray, offsets: np.ndarray, orders: tuple[int, ...], bits: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(slots, first, last) for character n-grams of each order (across word borders), for words and for word shapes; first and last delimit each row.

    A word's shape is what its borders and the byte before it look like, and whether it stood among the four words before it: a word's
    n-grams can't show that it repeats, as an average has no order.
    """
    out = []
    codes, at = characters(raw, offsets)
    for k, n in enumerate(orders):
        out.append((slots(char_grams(codes, n), k, bits), at[:-1], np.maximum(at[1:] - n + 1, at[:-1])))
    words = Words(raw, offsets)
    again = np.zeros(len(words.hash), dtype=bool)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(words.first))
    for d in range(1, 5):
        again[d:] |= (words.hash[d:] == words.hash[:-d]) & (row[d:] == row[:-d])
    before = np.zeros(len(words.hash), dtype=np.uint64)
    before[1:] = np.where(row[1:] == row[:-1], _KIND[raw[words.end[:-1] - 1]], np.uint64(0))
    shape = ((before * np.uint64(8) + _KIND[raw[words.start]]) * np.uint64(8) + _KIND[raw[words.end - 1]]) * np.uint64(2) + again
    out.append((slots(words.hash, len(orders), bits), words.first[:-1], words.first[1:]))
    return [*out, (slots(shape, len(orders) + 1, bits), words.first[:-1], words.first[1:])]
