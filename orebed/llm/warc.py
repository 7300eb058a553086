"""WARC archives: a writer with one gzip member for each record, and a splittable reader.

Reading deals byte ranges over tasks. A task looks for gzip magic in its range; a candidate
counts if its member inflates whole (zlib checks its sum) to a WARC header and the block that the header
announces. A record belongs to the range in which its member starts, so a task reads on past its range's end
for the last one. A member can hold gzip members of its own (an archive stored in a page), which a range
that begins inside of it takes for records: records of a file tile it, so whatever starts before the end of
an earlier one is such a false find and goes.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import UTC, datetime
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs as stores
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orebed.llm.kernels import BLOCK_BYTES, blocks, cut_lineage, ensure_checkpoint_dir, removed, unused

MAGIC = b"\x1f\x8b\x08"
CRLF = b"\r\n"
#: Payloads of fewer bytes are never revisits.
LEAST_REVISIT = 1000
#: Bytes of an archive file, after which a task begins another.
FILE_BYTES = 1 << 30
#: Bytes of an archive that a task scans for records.
RANGE_BYTES = 8 << 20
#: Tasks that ranges are dealt over; more ranges share them.
MOST_TASKS = 20_000
#: Groups of equal payloads up to which their digests are broadcast (about 100 bytes each).
BROADCAST_GROUPS = 500_000
#: A digest with more than this share of all pages is hot; there are at most its inverse of them.
HOT_SHARE = 1e-4
#: Bytes that are read at once where a member goes past a range.
STEP = 1 << 20
_PAGE_ID = "urn:x-page:"
_SCHEMA = "path string, offset long, length long, warc_type string, record_id string, target_uri string, warc_date string, refers_to_id string, payload_bytes long, payload_digest string, digest_holds boolean"


def store_of(path: str) -> tuple[stores.FileSystem, str]:
    """The store of a Hadoop path, and the path in it: local and mounted folders, and what pyarrow reaches (hdfs, s3, gs, abfs)."""
    path = re.sub(r"^s3[an]:", "s3:", re.sub(r"^file:/+", "/", path))
    if "://" not in path:
        return stores.LocalFileSystem(), path
    return stores.FileSystem.from_uri(path)


# Records as bytes ---------------------------------------------------------------------------------------------------


def member(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A WARC/1.1 record as one gzip member."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    return zlib.compress(b"WARC/1.1\r\n" + head.encode() + CRLF + block + CRLF + CRLF, wbits=31)


def page_record(page_id: int | None, url: str | None, payload: bytes, size: int, sha1: str, refers_to: int | None, date: str) -> bytes:
    """A response with its payload, or a revisit, whose HTTP header alone is kept."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    headers = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<{_PAGE_ID}{page_id}>" if page_id is not None else f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date)]
    if url:
        headers.append(("WARC-Target-URI", quote(url, safe="".join(map(chr, range(33, 127))))))
    headers.append(("Content-Type", "application/http; msgtype=response"))
    headers.append(("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(sha1)).decode()))
    if revisit:
        headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<{_PAGE_ID}{refers_to}>")]
    return member(headers, http if revisit else http + payload)


def _lines(raw: bytes) -> dict[str, str]:
    """Header fields by their lower-cased names; folded lines go on with the line before."""
    found: dict[str, str] = {}
    name = ""
    for line in raw.decode("utf-8", "replace").split("\r\n"):
        if line[:1] in (" ", "\t") and name:
            found[name] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            found[name := name.strip().lower()] = value.strip()
    return found


@dataclass
class Record:
    """headers and http by lower-cased names; payload is the block without its HTTP header, length that of the gzip member."""

    headers: dict[str, str]
    payload: bytes
    length: int
    http: dict[str, str] = field(default_factory=dict)


class Bytes:
    """A file's bytes from some offset on, read as far as they are asked for."""

    def __init__(self, file: pa.NativeFile, at: int, to: int) -> None:
        self.file, self.start = file, at
        file.seek(at)
        self.raw = bytearray(file.read(to - at))

    def at(self, offset: int, size: int) -> bytearray:
        """Up to size bytes from offset; fewer at the end of the file."""
        end = self.start + len(self.raw)
        if offset + size > end:
            self.file.seek(end)
            self.raw += self.file.read(max(STEP, offset + size - end))
        return self.raw[offset - self.start : offset - self.start + size]


def decoded(source: Bytes, offset: int) -> Record | None:
    """The record whose gzip member starts at offset; None if none does."""
    lead = source.at(offset, 10)
    if len(lead) < 10 or lead[:3] != MAGIC or lead[3] & 0xE0:
        return None
    inflate, out, used = zlib.decompressobj(31), bytearray(), 0
    try:
        while not inflate.eof:
            chunk = source.at(offset + used, STEP if out else 4096)
            if not chunk:
                return None
            used += len(chunk)
            out += inflate.decompress(chunk)
            if len(out) >= 8 and not out.startswith(b"WARC/"):
                return None
    except zlib.error:
        return None
    head, parted, rest = bytes(out).partition(CRLF + CRLF)
    headers = _lines(head.partition(CRLF)[2])
    if not head.startswith(b"WARC/") or not parted or not headers.get("content-length", "").isdigit() or len(rest) < int(headers["content-length"]):
        return None
    block, http = rest[: int(headers["content-length"])], {}
    if headers.get("content-type", "").startswith("application/http"):
        first, _, block = block.partition(CRLF + CRLF)
        http = _lines(first.partition(CRLF)[2])
    return Record(headers, block, used - len(inflate.unused_data), http)


def scanned(source: Bytes, start: int, stop: int) -> Iterator[tuple[int, Record]]:
    """The records whose members start in start .. stop - 1."""
    at = start
    while at < stop:
        window = source.at(at, min(STEP, stop - at) + len(MAGIC) - 1)
        hit = window.find(MAGIC)
        if hit < 0:
            at += max(1, len(window) - len(MAGIC) + 1)
            continue
        at += hit
        if at >= stop:
            return
        if (record := decoded(source, at)) is None:
            at += 1
        else:
            yield at, record
            at += record.length


# Writing ------------------------------------------------------------------------------------------------------------


def decided(pages: DataFrame, id_col: str = "page_id", text_col: str = "html", least: int = LEAST_REVISIT) -> DataFrame:
    """pages' rows with _payload, _size, _sha1 and _refers: the largest id among equal payloads of at least `least` bytes, null on the rows that keep theirs.

    Only digests are grouped. Where groups of equal payloads are few their digests are broadcast; otherwise digests meet their pages by a
    join, but for the hot ones (each over HOT_SHARE of all rows, so at most 1 / HOT_SHARE of them), which are broadcast.
    """
    body = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    rows = pages.withColumns({"_payload": body, "_size": F.octet_length(body).cast("long"), "_sha1": F.sha1(body)})
    large = rows.where(F.col("_size") >= least)
    groups = large.groupBy(F.concat_ws(":", "_sha1", "_size").alias("_key")).agg(F.max(id_col).alias("_keep"), F.count("*").alias("_n"))
    groups = cut_lineage(groups.where("_n > 1"))
    key = F.when(F.col("_size") >= least, F.concat_ws(":", "_sha1", "_size"))
    if groups.count() <= BROADCAST_GROUPS:
        met = rows.withColumn("_key", key).join(F.broadcast(groups), "_key", "left")
    else:
        hot = groups.where(F.col("_n") > HOT_SHARE * rows.count())
        by_hot = rows.withColumn("_key", key).join(F.broadcast(hot.select("_key", F.col("_keep").alias("_hot"))), "_key", "left")
        spread = F.when(F.col("_hot").isNotNull() | F.col("_key").isNull(), F.concat(F.lit("-"), F.xxhash64(id_col, "_sha1").cast("string"))).otherwise(F.col("_key"))
        met = by_hot.withColumn("_key", spread).join(groups.join(hot, "_key", "left_anti"), "_key", "left").withColumn("_keep", F.coalesce("_hot", "_keep"))
    return met.withColumn("_refers", F.when(~F.col(id_col).eqNullSafe(F.col("_keep")), F.col("_keep")))


def written(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", text_col: str = "html", least: int = LEAST_REVISIT, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write a record for each row below folder; returns the files (path, bytes, records), a table in the checkpoint folder.

    Each attempt of a task writes files of its own names, and only those of the attempts that count are in the result, so lost
    executors and speculation leave files that nobody reads. Null texts are empty payloads, null urls leave the field out; rows with a null id get a
    random record id. Of repeated rows with the largest id all are responses. An empty table gives no files. Other columns of pages, whatever their names, are left out.
    """
    date = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    plain = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(text_col).alias("html"))
    rows = decided(plain, least=least).select("page_id", "url", "_sha1", "_size", "_refers", F.when(F.col("_refers").isNull(), F.col("_payload")).alias("_payload"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, below = store_of(folder)
        store.create_dir(below, recursive=True)
        out, name, size, n = None, "", 0, 0

        def ended() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pylist([{"path": f"{folder}/{name}", "bytes": size, "records": n}], pa.schema([("path", pa.string()), ("bytes", pa.int64()), ("records", pa.int64())]))

        for batch in blocks(batches, "_payload"):
            for page_id, url, sha1, length, refers, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    name, n = f"pages-{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(f"{below}/{name}", compression=None)
                    info = member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
                    out.write(info)
                    size = len(info)
                record = page_record(page_id, url, payload, length, sha1, refers, date)
                out.write(record)
                size, n = size + len(record), n + 1
                if size >= file_bytes:
                    yield ended()
                    out = None
        if out is not None:
            yield ended()

    return cut_lineage(rows.mapInArrow(run, "path string, bytes long, records long"))


# Reading ------------------------------------------------------------------------------------------------------------


def archives(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes) of the archives that a path or pattern names; Spark lists them and reads none."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"))


def _id_of(uri: F.Column) -> F.Column:
    return F.when(uri.startswith(_PAGE_ID), F.substring(uri, len(_PAGE_ID) + 1, 20).cast("long"))


def records(files: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The records of archives (path, bytes), a row for each: where its member lies, its main fields, and the payload's size and digest.

    The size of a revisit's payload is what its HTTP header tells. payload_digest is lower-case hex SHA-1, computed from the
    payload where there is one; digest_holds compares it with the header's (null without one). Other gzip members and damaged ones give no row. Nulls
    in files are left out, an empty table gives no rows, a path that is named twice gives its records once. A task holds one range, and the records that it decodes one by one.
    """
    cut = files.where("path IS NOT NULL AND bytes > 0").select("path", "bytes").distinct()
    ranges = cut.select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(range_bytes).cast("long"))).alias("start"))
    tasks = ranges.select("path", "start", F.least(F.col("start") + range_bytes, "bytes").alias("stop"))
    n = cut.agg(F.coalesce(F.sum(F.ceil(F.col("bytes") / range_bytes)), F.lit(1))).first()[0]
    tasks = tasks.repartition(min(int(n), MOST_TASKS), "path", "start")
    fields = "warc_type warc_record_id warc_target_uri warc_date warc_refers_to".split()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start, stop in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                store, name = store_of(path)
                with store.open_input_file(name) as file:
                    rows = []
                    for offset, r in scanned(Bytes(file, start, stop), start, stop):
                        h = r.headers
                        told = _hex(h.get("warc-payload-digest"))
                        revisit = h.get("warc-type") == "revisit"
                        size = int(r.http.get("content-length", "0")) if revisit and r.http.get("content-length", "0").isdigit() else len(r.payload)
                        own = told if revisit else hashlib.sha1(r.payload).hexdigest()
                        rows.append((path, offset, r.length, *((h.get(f.replace("_", "-")) or "").strip("<>") or None for f in fields), size, own, None if told is None else told == own))
                    yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], kind) for i, kind in enumerate(_KINDS)], names=_NAMES)

    found = tasks.mapInArrow(run, _SCHEMA)
    before = F.max(F.col("offset") + F.col("length")).over(Window.partitionBy("path").orderBy("offset").rowsBetween(Window.unboundedPreceding, -1))
    return found.withColumn("_before", before).where("coalesce(_before, 0) <= offset").drop("_before")


_NAMES = [part.split()[0] for part in _SCHEMA.split(", ")]
_KINDS = [{"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}[part.split()[1]] for part in _SCHEMA.split(", ")]


def _hex(digest: str | None) -> str | None:
    """A SHA-1 field (base 32 or hex) as lower-case hex."""
    kind, _, value = (digest or "").partition(":")
    if kind.lower() != "sha1":
        return None
    try:
        return value.lower() if len(value) == 40 else base64.b32decode(value.upper()).hex()
    except ValueError:
        return None


def payloads(index: DataFrame) -> DataFrame:
    """index's rows (as records() gives them, or any part of them) with payload: each task seeks the members it was dealt and scans nothing.

    A row whose offset holds no record has a null payload.
    """
    name = unused(index, "payload")
    path_at, offset_at = index.columns.index("path"), index.columns.index("offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                store, path = store_of(batch.column(path_at)[i].as_py())
                with store.open_input_file(path) as file:
                    at = batch.column(offset_at)[i].as_py()
                    record = decoded(Bytes(file, at, at), at)
                yield pa.RecordBatch.from_arrays([*batch.slice(i, 1).columns, pa.array([record and record.payload], pa.binary())], names=[*batch.schema.names, name])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in index.schema)
    return index.mapInArrow(run, f"{schema}, `{name}` binary")


def round_trip(pages: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every page, as read back from archives written in the checkpoint folder.

    The rows are checkpointed and the archives deleted. page_id is null for rows that had none; equal payloads whose ids are all null stay responses.
    """
    spark = pages.sparkSession
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/warc-{uuid.uuid4().hex}"
    try:
        found = records(written(pages, folder)).where(F.col("warc_type").isin("response", "revisit"))
        digest = F.when(F.col("digest_holds"), F.col("payload_digest")).otherwise(F.raise_error(F.lit("a payload differs from its digest")))
        return cut_lineage(found.select(_id_of(F.col("record_id")).alias("page_id"), "payload_bytes", digest.alias("payload_digest"), F.col("warc_type").alias("record_type"), _id_of(F.col("refers_to_id")).alias("refers_to")))
    finally:
        removed(spark, folder)


def oracle_sql(least: int = LEAST_REVISIT) -> str:
    """The same rows from the pages alone."""
    return f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
k AS (SELECT page_id, strlen(html) AS n, sha1(html) AS d, CASE WHEN strlen(html) >= {least} THEN max(page_id) OVER (PARTITION BY html) END AS keep FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest, CASE WHEN keep IS NOT NULL AND keep IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN keep IS NOT NULL AND keep IS DISTINCT FROM page_id THEN keep END AS refers_to FROM k"""
