"""Byte-level BPE encoding and decoding as a tree reduction over a monoid.

An element is the encoding of a piece of text; joining two neighbours gives the encoding
of both pieces together. A text is halved until the pieces are small, these leaves are
encoded, and neighbours are joined on the way up. A join encodes a window around the seam again and
keeps the tokens outside of it, once one of two things proves them final on each side:

* the window ends where the pattern splits in every context (see ``CUTS``), or
* inside one long run that the pattern never splits, the token at the window's edge and
  its outer neighbour encode to just themselves when put together. Encodings of a run are
  exactly the sequences all of whose adjacent pairs do so, given that every token encodes to itself.

Until then the window grows, at most to both pieces. Decoding concatenates up the same kind of tree.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orebed.llm.kernels import blocks

LEAF_CHARS = 1024
LEAF_TOKENS = 1024
#: Characters on each side of a seam that are first looked at.
WINDOW = 24
#: Characters around a seam that must be one run before its tokens are compared pairwise.
RUN = 256

# Every split that holds whatever stands around it: letters, digits and signs each end a
# match of the pattern where another kind follows (an apostrophe before a letter may not),
# and so does any other character before white space.
_SIGNS = r"!-/:-@\[-`{-~"
CUTS = re.compile(
    rf"[A-Za-z](?=[0-9{_SIGNS}])|[0-9](?=[A-Za-z{_SIGNS}])|[!-&(-/:-@\[-`{{-~](?=[A-Za-z0-9])|'(?=[0-9])"
    r"|[^\x09-\x0d\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000](?=[\x09-\x0d\x20])"
)
ONE_RUN = re.compile(rf"[A-Za-z]+|[0-9]+|[{_SIGNS}]+")


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a vocabulary file: a base64 token and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The plain definition: join the adjacent pair of lowest rank, the leftmost of equals, until none has a rank."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        rank, i = min((ranks.get(a + b, len(ranks) << 1), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
        if rank >= len(ranks) << 1:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts


class Codec:
    """Encoder and decoder for one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, leaf_chars: int = LEAF_CHARS) -> None:
        self.leaf_chars = leaf_chars
        self.plain = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.bytes = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.bytes[rank] = token
        self.size = [len(b) for b in self.bytes]
        self.name = [str(i) for i in range(len(self.bytes))]
        self.ranks = ranks
        self._closed: bool | None = None

    @property
    def closed(self) -> bool:
        """Whether every token encodes to itself, as pairwise proofs need it."""
        if self._closed is None:
            self._closed = all(len(merged(t, self.ranks)) == 1 for t in self.ranks)
        return self._closed

    def encode(self, text: str) -> list[int]:
        """Token ids of the whole text."""
        return self._encode(text, 0, len(text))

    def _encode(self, text: str, lo: int, hi: int) -> list[int]:
        if hi - lo <= self.leaf_chars:
            return self.plain.encode_ordinary(text[lo:hi])
        mid = (lo + hi) // 2
        return self.join(text, lo, mid, hi, self._encode(text, lo, mid), self._encode(text, mid, hi))

    def join(self, text: str, lo: int, mid: int, hi: int, left: list[int], right: list[int]) -> list[int]:
        """Encoding of text[lo:hi] from those of text[lo:mid] and text[mid:hi]."""
        width, tried = WINDOW, False
        while True:
            a, b = max(lo, mid - width), min(hi, mid + width)
            cuts = [m.end() + a for m in CUTS.finditer(text[a:b])]
            before, after = [c for c in cuts if c <= mid], [c for c in cuts if c >= mid]
            start = before[-1] if before else lo if a == lo else None
            end = after[0] if after else hi if b == hi else None
            if start is not None and end is not None:
                break
            if width >= RUN and not tried:
                tried = True
                if (found := self._inside_run(text, lo, mid, hi, left, right)) is not None:
                    return found
            width *= 4
        keep = self._behind(left, len(text[start:mid].encode()))
        skip = self._ahead(right, len(text[mid:end].encode()))
        return left[:keep] + self.plain.encode_ordinary(text[start:end]) + right[skip:]

    def _behind(self, ids: list[int], n: int) -> int:
        at = len(ids)
        while n > 0:
            at -= 1
            n -= self.size[ids[at]]
        return at

    def _ahead(self, ids: list[int], n: int) -> int:
        at = 0
        while n > 0:
            n -= self.size[ids[at]]
            at += 1
        return at

    def _inside_run(self, text: str, lo: int, mid: int, hi: int, left: list[int], right: list[int]) -> list[int] | None:
        """The join by pairwise proofs, if the seam lies in one run and they succeed within it."""
        if mid - lo < RUN or hi - mid < RUN or not ONE_RUN.fullmatch(text, mid - RUN, mid + RUN) or not self.closed:
            return None
        n = 1
        while True:
            i, j = len(left) - n, n
            if i < 1 or j >= len(right) or max(sum(self.size[t] for t in left[i - 1 :]), sum(self.size[t] for t in right[: j + 1])) > RUN:
                return None
            window = self.plain._encode_single_piece(b"".join([self.bytes[t] for t in left[i:] + right[:j]]))
            if self._stable(left[i - 1], window[0]) and self._stable(window[-1], right[j]):
                return left[:i] + window + right[j:]
            n *= 2

    def _stable(self, a: int, b: int) -> bool:
        return self.plain._encode_single_piece(self.bytes[a] + self.bytes[b]) == [a, b]

    def decode(self, ids: list[int]) -> bytes:
        """The bytes that the ids stand for."""
        if len(ids) <= LEAF_TOKENS:
            table = self.bytes
            return b"".join([table[i] for i in ids])
        mid = len(ids) // 2
        return self.decode(ids[:mid]) + self.decode(ids[mid:])


_CODECS: dict[tuple, Codec] = {}


def encoded(docs: DataFrame, vocab_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256[, ids]) of every whole text, without special tokens.

    The driver reads the vocabulary file and broadcasts it (a file of fixed size). A null text is
    encoded like an empty one; repeated rows and null ids stay as they are; no rows give no rows.
    """
    with open(vocab_path, "rb") as f:
        raw = docs.sparkSession.sparkContext.broadcast(f.read())
    id_type = docs.schema[id_col].dataType.simpleString()
    key = (vocab_path, pattern, leaf_chars)
    schema = f"`{id_col}` {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _CODECS:
            _CODECS[key] = Codec({base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.value.splitlines())}, pattern, leaf_chars)
        codec = _CODECS[key]
        for batch in blocks(batches, text_col):
            counts, shas, back, parts = [], [], [], []
            for text in batch.column(1).to_pylist():
                ids = codec.encode(text)
                names = codec.name
                counts.append(len(ids))
                shas.append(hashlib.sha256(",".join([names[i] for i in ids]).encode()).hexdigest())
                back.append(hashlib.sha256(codec.decode(ids)).hexdigest())
                if with_ids:
                    parts.append(np.array(ids, dtype=np.int32))
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(shas), pa.array(back)]
            if with_ids:
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int32))))
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def decoded(tokens: DataFrame, vocab_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, bytes binary): what the token ids stand for; null ids decode to null."""
    with open(vocab_path, "rb") as f:
        raw = tokens.sparkSession.sparkContext.broadcast(f.read())
    key = (vocab_path, "", LEAF_CHARS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _CODECS:
            _CODECS[key] = Codec({base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.value.splitlines())}, r"[\s\S]")
        for batch in batches:
            out = [None if ids is None else _CODECS[key].decode(ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=[id_col, "bytes"])

    id_type = tokens.schema[id_col].dataType.simpleString()
    return tokens.select(id_col, F.col(ids_col).cast("array<int>").alias(ids_col)).mapInArrow(run, f"`{id_col}` {id_type}, bytes binary")
