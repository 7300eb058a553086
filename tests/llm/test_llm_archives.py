"""Archives, conversation repair and the divergence audit: against slow definitions, and odd tables."""

from __future__ import annotations

import gzip
import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import pyarrow as pa
import pytest
from llm.conftest import prose

from orebed.llm import divergence, repair, warc

PAGES = "page_id long, url string, html string, _key string, _payload string, bytes long, path string"
TURNS = "conv_id long, turn long, role string, text string, part int, pos long, conv string, audit string"


# Archives ------------------------------------------------------------------------------------------------------------


def page_rows():
    long = "<p>" + prose(5, 40_000) + "</p>"
    rows = [(1, "http://a.example/x y\r\nX: 1", "a" * 1000), (2, None, "a" * 1000), (3, "", "a" * 999), (4, "http://é.example/", "é" * 500), (5, "u", None), (6, "u", ""), (7, "u", long), (8, "u", long), (8, "u", long)]
    rows += [(None, "u", long), (None, "v", "only nulls " * 100), (None, "v", "only nulls " * 100), (9, "u", "a" * 999), (-3, "u", "\r\n\r\nWARC/1.1\r\n"), (10, "u", "é" * 500)]
    return rows


def pages(spark, rows):
    return spark.createDataFrame([(*r, None, "clash", 5, "p") for r in rows], PAGES)


def expected_pages(rows):
    keep = {}
    for page_id, _, html in rows:
        if page_id is not None and len((html or "").encode()) >= 1000:
            keep[html] = max(page_id, keep.get(html, page_id))
    out = []
    for page_id, _, html in rows:
        body = (html or "").encode()
        to = keep.get(html) if len(body) >= 1000 else None
        revisit = to is not None and to != page_id
        out.append((page_id, len(body), hashlib.sha1(body).hexdigest(), "revisit" if revisit else "response", to if revisit else None))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("groups", [warc.BROADCAST_GROUPS, 0])
def test_pages_come_back(spark, monkeypatch, groups):
    monkeypatch.setattr(warc, "BROADCAST_GROUPS", groups)
    monkeypatch.setattr(warc, "HOT_SHARE", 0.15)
    got = warc.round_trip(pages(spark, page_rows()))
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert rows_of(got) == expected_pages(page_rows())
    assert rows_of(warc.round_trip(pages(spark, []))) == []


def test_archives_are_plain_gzip(spark, tmp_path):
    files = warc.written(pages(spark, page_rows()).coalesce(2), str(tmp_path), file_bytes=20_000).collect()
    assert sum(f.records for f in files) == len(page_rows())
    seen = 0
    for f in files:
        raw = open(f.path, "rb").read()
        assert len(raw) == f.bytes
        text = gzip.decompress(raw)
        assert text.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n")
        while text:  # records tile the file
            head, _, rest = text.partition(b"\r\n\r\n")
            n = int(re.search(rb"Content-Length: (\d+)", head)[1])
            assert rest[n : n + 4] == b"\r\n\r\n"
            assert b"\nX: 1" not in head
            text, seen = rest[n + 4 :], seen + 1
    assert seen == len(page_rows()) + len(files)


@pytest.mark.parametrize("size", [37, 1000, 1 << 20])
def test_any_ranges_give_the_same_records(spark, tmp_path, size, monkeypatch):
    monkeypatch.setattr(warc, "MOST_TASKS", 16)
    files = warc.written(pages(spark, page_rows()), str(tmp_path))
    whole, cut = (warc.records(files.unionByName(files), range_bytes=n).drop("path") for n in (1 << 30, size))
    assert rows_of(whole) == rows_of(cut)
    assert rows_of(warc.records(warc.archives(spark, f"{tmp_path}/*.warc.gz"), size).drop("path")) == rows_of(whole)
    assert whole.where("digest_holds").count() == len(page_rows())


def test_payloads_by_offset(spark, tmp_path):
    index = warc.records(warc.written(pages(spark, page_rows()), str(tmp_path))).withColumnRenamed("warc_date", "payload")
    got = warc.payloads(index.where("warc_type = 'response'"))
    assert got.columns == [*index.columns, "_payload"]
    for r in got.collect():
        assert hashlib.sha1(r._payload).hexdigest() == r.payload_digest


def test_archives_in_archives_and_damage(spark, tmp_path, monkeypatch):
    """A record that holds an archive, bytes that only look like members, other members and a cut file."""
    monkeypatch.setattr(warc, "MOST_TASKS", 16)
    headers = [("WARC-Type", "resource"), ("WARC-Record-ID", "<urn:x:1>")]
    inner = b"".join(warc.member([*headers, ("n", str(i))], random.Random(i).randbytes(200)) for i in range(5))
    head = b"WARC/1.0\r\nWARC-Type: resource\r\nContent-Length: %d\r\n\r\n" % len(inner)
    stored = zlib.compressobj(0, wbits=31)
    outer = stored.compress(head + inner + b"\r\n\r\n") + stored.flush()
    junk = warc.MAGIC + b"\x00" * 30 + warc.MAGIC
    last = warc.member(headers, b"last")
    raw = warc.member(headers, b"first") + outer + junk + gzip.compress(b"no record") + last + warc.member(headers, b"cut off")[:-9]
    (tmp_path / "odd.warc.gz").write_bytes(raw)
    files = spark.createDataFrame([(str(tmp_path / "odd.warc.gz"), len(raw)), (None, 5), ("gone", 0)], "path string, bytes long")
    expected = [(0, 5), (len(warc.member(headers, b"first")), len(inner)), (raw.index(last), 4)]
    for size in (16, 64, 301, 1 << 20):
        assert sorted(tuple(r) for r in warc.records(files, size).select("offset", "payload_bytes").collect()) == expected


# Conversations -------------------------------------------------------------------------------------------------------

LEGAL_ROLES = re.compile(r"(s?(ua)+)?")


def plain_edits(rows):
    """The cheapest (cost, audit, lines) of all sequences of edits, by trying them all; rows (role, text, fault)."""
    found = []

    def go(i, cost, audit, roles, lines, limit):
        if cost > limit[0]:
            return
        if i == len(rows) and LEGAL_ROLES.fullmatch(roles):
            found.append((cost, audit, lines))
            limit[0] = min(limit[0], cost)
        for role in ("user", "assistant"):
            go(i, cost + 3, audit + "I", roles + role[0], [*lines, f"{role}:"], limit)
        if i == len(rows):
            return
        role, text, fault = rows[i]
        go(i + 1, cost + 4, audit + "D", roles, lines, limit)
        if fault in ("blank", "duplicate"):
            return
        more = 3 * (fault == "truncated")
        if role:
            go(i + 1, cost + more, audit + "K", roles + role[0], [*lines, f"{role}:{text}"], limit)
        for to in ("user", "assistant"):
            go(i + 1, cost + 3 + more, audit + "R", roles + to[0], [*lines, f"{to}:{text}"], limit)

    go(0, 0, "", "", [], [4 * len(rows)])
    return min(found)


def plain_repair(rows):
    """Results by conversation from (conv_id, turn, role, text)."""
    out = {}
    for conv in {r[0] for r in rows}:
        after = []
        for _, turn, role, text in (r for r in rows if r[0] == conv):
            kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            role, text = (" " if role is None else role), (" " if text is None else text)
            text = {1: "", 2: re.sub("[.!?]", "", text)}.get(kind, text)
            after += [(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
        after.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, lattice = set(), []
        for _, role, text in after:
            bare = text.rstrip(" \t\n\v\f\r")
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
            seen.add((role, text))
            lattice.append((role, text, fault))
        cost, audit, lines = plain_edits(lattice)
        turns = {r[0] for r in after if r[0] is not None}
        count = Counter(x[2] for x in lattice)
        illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in itertools.pairwise(after))
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def conversations(seed, n):
    rng = random.Random(seed)
    rows = []
    for conv in [None, *range(n)]:
        turn = 0
        for _ in range(rng.randint(1, 5)):
            turn += rng.choice([0, 1, 1, 1, 2])
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""])
            rows.append((conv, rng.choice([turn, turn, turn, turn, None]), role, rng.choice(["yes.", "no", "", None, " \t\n", "why?", "so ", "émile! ", "\x0b."])))
    return rows


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "clash", None) for r in rows], TURNS)


def by_conversation(df):
    return {r.conv_id: tuple(r)[1:] for r in df.collect()}


@pytest.mark.parametrize("seed", range(2))
def test_repair_by_trying_all_edits(spark, seed):
    rows = conversations(seed, 150)
    expected = plain_repair(rows)
    got = repair.repaired(table(spark, rows))
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert by_conversation(got) == expected
    assert by_conversation(repair.repaired(table(spark, rows), long_rows=2, block_rows=2)) == expected


def test_long_conversations_are_chained(spark):
    """One conversation holds most rows, over many tasks; some rows are very long."""
    rng = random.Random(4)
    rows = [(7, t // 2, rng.choice(["user", "assistant", "system"]), rng.choice(["yes.", "no", "why? " * 50, "x" * 2_000_00 + "."]) if t % 97 else f"{t}.") for t in range(1200)] + conversations(9, 20)
    whole = by_conversation(repair.repaired(table(spark, rows).coalesce(1), long_rows=1 << 20))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert by_conversation(repair.repaired(table(spark, rows).repartition(5), long_rows=64, block_rows=16)) == whole
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(whole[7][6]) > 500


def test_repair_of_nothing(spark):
    assert repair.repaired(table(spark, [])).count() == 0
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert by_conversation(repair.repaired(table(spark, [(gone, 0, "user", "hi.")]))) == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


# Divergence ----------------------------------------------------------------------------------------------------------


def plain_audit(rows, min_docs, top):
    """The audit by its definition; rows (text, lang, source)."""
    rows = [tuple(x or "" for x in r) for r in rows]
    words = [re.findall(divergence.TERM, re.sub("[A-Z]", lambda m: m[0].lower(), t)) for t, _, _ in rows]
    out = set()
    for lang in {r[1] for r in rows}:
        mine = [(w, r[2]) for w, r in zip(words, rows, strict=True) if r[1] == lang]
        in_docs = Counter(t for w, _ in mine for t in set(w))
        kept = [t for t, n in in_docs.items() if n >= min_docs]
        counts = {s: Counter(t for w, own in mine if own == s for t in w if in_docs[t] >= min_docs) for s in {s for _, s in mine}}
        counts[None] = sum(counts.values(), Counter())

        def p(source, term):
            total = sum(counts[source].values()) + 5 * len(kept)
            return 1 + 1_000_000_000 * (counts[source][term] + 5) // total

        for s in set(counts) - {None}:
            pairs = [(o, sum(abs(p(s, t) - p(o, t)) for t in kept)) for o in set(counts) - {None, s}]
            terms = [(t, p(s, t) - p(None, t)) for t in kept if counts[s][t] and p(s, t) > p(None, t)]
            for part, items, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out |= {(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(items[:most])}
    return out


DOCS = "doc_id long, text string, lang string, source string, term string, n long, zero long, p double"


@pytest.mark.parametrize(("min_docs", "top"), [(1, 3), (3, 7), (3, 1000), (10_000, 5)])
def test_audit_by_definition(spark, min_docs, top, monkeypatch):
    monkeypatch.setattr(divergence, "HELD", 20)
    monkeypatch.setattr(divergence, "PAIRS", 10)
    rng = random.Random(min_docs * top)
    vocabulary = [f"{a}{b}" for a in "AabcéßÉ" for b in "xyz\U0001f600́"]
    rows = [(" ".join(rng.choices(vocabulary[: rng.randint(1, 30)], k=rng.randint(0, 40))), rng.choice(["en", "de", None, ""]), rng.choice(["s1", "s2", "é", None, "hot", "hot", "hot"])) for _ in range(300)]
    rows += [(None, "en", "empty"), ("", "fr", "only"), ("123 ...", "en", "signs"), ("word " * 50_000, "en", "hot"), ("a_b A-B a\x00b", "en", "s1")] * 2
    docs = spark.createDataFrame([(None if i % 9 == 0 else i % 50, *r, "clash", 1, 1, 0.5) for i, r in enumerate(rows)], DOCS)
    got = divergence.audited(docs, min_docs=min_docs, top=top)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    collected = [tuple(r) for r in got.collect()]
    assert len(collected) == len(set(collected))
    assert set(collected) == plain_audit(rows, min_docs, top)


def test_audit_of_nothing(spark):
    assert divergence.audited(spark.createDataFrame([], DOCS)).count() == 0


def test_postings_stand_together_over_batches():
    rows = [("l", "a", "s"), ("l", "a", "t"), ("l", "b", "s"), ("m", "b", "s"), ("m", "b", "t"), ("m", "b", "u"), ("m", "c", "s")]
    for size in (1, 2, 3, 10):
        batches = [pa.RecordBatch.from_pylist([dict(zip("abc", r, strict=True)) for r in rows[i : i + size]]) for i in range(0, len(rows), size)]
        blocks = list(divergence.whole_terms(iter(batches)))
        assert [tuple(r.values()) for b in blocks for r in b.to_pylist()] == rows
        for most in (1, 2, 100):
            met = [(b.column(2)[i].as_py(), b.column(2)[j].as_py()) for b in blocks for left, right in divergence.met_pairs(divergence.term_ends(b), most) for i, j in zip(left.tolist(), right.tolist(), strict=True)]
            assert met == [("s", "t"), ("s", "t"), ("s", "u"), ("t", "u")]
