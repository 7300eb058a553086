"""The ten queries and the pipeline on whole tables: against SQL, brute force, exact round trips or held-out accuracy."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from conftest import assert_same

from orebed.llm import bpe
from orebed.llm.queries import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def docs(duck):
    return dict(duck.sql("SELECT doc_id, coalesce(text, '') FROM documents").fetchall())


def rows_of(spark, sf_dir, name):
    return QUERIES[name](spark, sf_dir).collect()


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(name, spark, duck, sf_dir):
    assert_same(QUERIES[name](spark, sf_dir), duck, ORACLE_SQL[name])


def digest(spans):
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()


def test_secrets_by_plain_patterns(spark, sf_dir, docs):
    assign = re.compile(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
    kinds = ("assign", "access", "hex")
    got = rows_of(spark, sf_dir, "op3_secrets")
    assert sorted(r.doc_id for r in got) == sorted(docs)
    for r in got:
        t = docs[r.doc_id]
        base = [("assign", m.start(), m.end()) for m in assign.finditer(t) if len(m[2]) >= 6]
        base += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        base += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        base.sort(key=lambda s: (s[1], kinds.index(s[0])))
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(b[0] == k for b in base) for k in kinds)
        assert r.base_sha256 == digest(base)
        assert {f"{k}:{s}:{e}" for k, s, e in base} <= set(r.spans.split(","))


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def plain_pii(t):
    out = [("email", m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", m) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", m) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(re.sub("[^0-9]", "", m[0])) <= 19 and luhn(re.sub("[^0-9]", "", m[0]))]
    out += [("phone", m) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return [(k, m.start(), m.end()) for k, m in out]


def test_pii_by_plain_patterns(spark, sf_dir, docs):
    got = rows_of(spark, sf_dir, "op9_pii")
    assert sorted(r.doc_id for r in got) == sorted(docs)
    assert sum(r.n_email for r in got) > 0
    for r in got:
        base = plain_pii(docs[r.doc_id])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(b[0] == k for b in base) for k in ("email", "ip", "card", "phone"))
        assert r.base_sha256 == digest(base)
        assert {f"{k}:{s}:{e}" for k, s, e in base} <= set(r.spans.split(","))


def test_bpe_as_the_library_does(spark, sf_dir, docs):
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    got = rows_of(spark, sf_dir, "op7_byte_bpe")
    assert sorted(r.doc_id for r in got) == sorted(docs)
    for r in got:
        ids = plain.encode_ordinary(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_by_all_pairs(spark, sf_dir, docs):
    fps = {i: plain_fingerprint(t) for i, t in docs.items()}
    root = {i: i for i in fps}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(fps)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if (fps[i] ^ fps[j]).bit_count() <= 4 and find(i) != find(j):
                root[max(find(i), find(j))] = min(find(i), find(j))
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in rows_of(spark, sf_dir, "op10_simhash_neardup")}
    assert got == {i: (f"{fps[i]:016x}", find(i)) for i in ids}
    assert len({c for _, c in got.values()}) < len(ids)


def test_neighbours_recall(spark, sf_dir, duck):
    vectors = {i: np.array(v, dtype=float) for i, v in duck.sql("SELECT vec_id, embedding FROM embeddings").fetchall() if v is not None and None not in v and np.isfinite(v).all() and np.any(v)}
    got = defaultdict(list)
    for r in sorted(rows_of(spark, sf_dir, "op5_nearest_neighbours"), key=lambda r: (r.query_id, r["rank"])):
        got[r.query_id].append((r.vec_id, r.score))
        assert r["rank"] == len(got[r.query_id])
    queries = [i for i in vectors if i % 50 == 0]
    assert sorted(got) == sorted(queries)
    cos = lambda a, b: float(a @ b / (np.linalg.norm(a) * np.linalg.norm(b)))
    hits = total = 0
    for q in queries:
        best = sorted(((-cos(vectors[q], v), i) for i, v in vectors.items() if i != q))[:5]
        assert len(got[q]) == len(best)
        for i, s in got[q]:
            assert abs(s - cos(vectors[q], vectors[i])) < 1e-9
        hits += len({i for i, _ in got[q]} & {i for _, i in best})
        total += len(best)
    assert hits >= 0.9 * total


def test_quality_on_held_out_labels(spark, sf_dir, duck, docs):
    labels = dict(duck.sql("SELECT doc_id, min(quality) FROM labels WHERE quality IN (0, 1) GROUP BY doc_id").fetchall())
    got = rows_of(spark, sf_dir, "op4_quality_classifier")
    assert sorted(r.doc_id for r in got) == sorted(docs)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1
        assert r.predicted == (r.score >= 0.7)
    seen = [(r.score, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]
    good, bad = [s for s, y in seen if y == 1], [s for s, y in seen if y == 0]
    auc = np.mean([(g > b) + (g == b) / 2 for g in good for b in bad])
    assert auc > 0.8


def test_language_on_held_out_documents(spark, sf_dir, duck, docs):
    lang = dict(duck.sql("SELECT doc_id, lang FROM documents").fetchall())
    got = rows_of(spark, sf_dir, "op6_language_id")
    assert sorted(r.doc_id for r in got) == sorted(docs)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in docs[r.doc_id]))
    seen = [r.lang_pred == lang[r.doc_id] for r in got if r.held_out and lang[r.doc_id] is not None and r.lang_pred != "und"]
    assert np.mean(seen) > 0.9


def plain_words(text):
    return re.findall(r"[^\x20\x09-\x0D!-/:-@\[-`{-~]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))


def plain_tiling(doc, item, least=5):
    """Words of item under greedy tiles: again and again the longest common run of unmarked words."""
    free_d, free_i, covered = [True] * len(doc), [True] * len(item), 0
    while True:
        best, before = (0, 0, 0), [0] * (len(item) + 1)
        for i in range(len(doc)):
            now = [0] * (len(item) + 1)
            for j in range(len(item)):
                if doc[i] == item[j] and free_d[i] and free_i[j]:
                    now[j + 1] = before[j] + 1
                    best = max(best, (now[j + 1], -(i - now[j + 1] + 1), -(j - now[j + 1] + 1)))
            before = now
        k, i, j = best[0], -best[1], -best[2]
        if k < least:
            return covered
        free_d[i : i + k] = free_i[j : j + k] = [False] * k
        covered += k


def test_leaks_by_plain_tiling(spark, sf_dir, duck, docs):
    items = {i: plain_words(t or "") for i, t in duck.sql("SELECT item_id, text FROM benchmark").fetchall()}
    words = {i: plain_words(t) for i, t in docs.items()}
    runs = defaultdict(set)
    for i, w in items.items():
        for n in range(len(w) - 4):
            runs[tuple(w[n : n + 5])].add(i)
    expected = {}
    for d, w in words.items():
        for i in set().union(*(runs.get(tuple(w[n : n + 5]), ()) for n in range(len(w) - 4)), ()):
            if len(w) <= 3000:
                covered = plain_tiling(w, items[i])
                if covered >= 0.6 * len(items[i]):
                    expected[d, i] = covered
    got = {(r.doc_id, r.item_id): r.matched_words for r in rows_of(spark, sf_dir, "op1_decontamination") if len(words[r.doc_id]) <= 3000}
    assert got == expected
    assert expected


def test_passages_cover_exact_repeats(spark, sf_dir, docs):
    words = {i: plain_words(t) for i, t in docs.items()}
    at = defaultdict(set)
    for i, w in words.items():
        for n in range(len(w) - 49):
            at[tuple(w[n : n + 50])].add(i)
    groups = [s for s in at.values() if len(s) > 1]
    got = rows_of(spark, sf_dir, "op8_repeated_passages")
    assert set().union(*groups) <= {r.doc_id for r in got}
    root = {i: i for i in docs}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for r in got:
        root[find(r.doc_id)] = find(r.other_doc_id)
    assert all(len({find(i) for i in s}) == 1 for s in groups)
    for r in got:
        a, b = (words[i][s : s + n] for i, s, n in ((r.doc_id, r.first_word, r.n_words), (r.other_doc_id, r.other_first_word, r.other_n_words)))
        x, y = ({tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (a, b))
        assert min(len(a), len(b)) >= 50
        assert len(x & y) >= 0.8 * len(x | y)


def test_pipeline(spark, sf_dir, duck, docs):
    """Every stage against plain Python on what the stage before it kept."""
    import corpus_pipeline
    from orebed.llm import pii, quality

    stages = dict(corpus_pipeline.STAGES)
    table = start = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept, texts = {}, {}
    for name, stage in stages.items():
        table = stage(spark, table, sf_dir)
        if name != "byte_bpe":
            assert table.columns == start.columns
            table = table.checkpoint()
            texts[name] = {r.doc_id: r.text or "" for r in table.select("doc_id", "text").collect()}
        kept[name] = sorted(r.doc_id for r in table.select("doc_id").collect())
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = quality.scored(start, quality.fit(start, labels.where(~quality.held_out()))).collect()
    assert kept["quality_filter"] == sorted(r.doc_id for r in scored if r.predicted == 1)
    fps = {i: plain_fingerprint(t) for i, t in texts["quality_filter"].items()}
    root = {i: i for i in fps}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(fps)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if (fps[i] ^ fps[j]).bit_count() <= 4 and find(i) != find(j):
                root[max(find(i), find(j))] = min(find(i), find(j))
    assert kept["near_dedup"] == sorted({find(i) for i in ids})
    items = [plain_words(t or "") for (t,) in duck.sql("SELECT text FROM benchmark").fetchall()]
    runs = [{tuple(w[n : n + 5]) for n in range(len(w) - 4)} for w in items]

    def leaks(words):
        own = {tuple(words[n : n + 5]) for n in range(len(words) - 4)}
        near = [w for w, r in zip(items, runs, strict=True) if len(own & r) * 5 >= 0.6 * len(w)]
        return any(plain_tiling(words, w) >= 0.6 * len(w) for w in near if len(w) >= 5) or any(words == w for w in items if 0 < len(w) < 5)

    assert kept["decontamination"] == [i for i in kept["near_dedup"] if not leaks(plain_words(texts["near_dedup"][i]))]
    assert kept["pii_redaction"] == kept["decontamination"] == kept["byte_bpe"]
    for i, t in texts["pii_redaction"].items():
        out, at = "", 0
        for k, s, e in sorted(pii.trained().spans(texts["decontamination"][i]), key=lambda c: (c[1], -c[2])):
            if s >= at:
                out += texts["decontamination"][i][at:s] + f"<{k}>"
            at = max(at, e)
        assert t == out + texts["decontamination"][i][at:]
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    assert {r.doc_id: list(r.ids) for r in table.collect()} == {i: plain.encode_ordinary(t) for i, t in texts["pii_redaction"].items()}
    whole = corpus_pipeline.run(spark, sf_dir)
    assert sorted(map(str, whole.collect())) == sorted(map(str, table.collect()))
    labelled = dict(duck.sql("SELECT doc_id, min(quality) FROM labels WHERE quality IN (0, 1) GROUP BY doc_id").fetchall())
    good = [i for i, y in labelled.items() if y == 1]
    assert sum(i in kept["quality_filter"] for i in good) > 0.9 * len(good)


def test_scores_of_a_fixed_model(spark, docs, sf_dir):
    """A made table of bucket values: the score of every whole text, one feature after the other."""
    from orebed.llm import quality
    from orebed.llm.grams import _KIND
    from orebed.llm.kernels import Words, utf8

    table = np.random.default_rng(0).standard_normal(1 << quality.BITS)
    model = quality.Fitted(table, 0.1, 2.0, -0.2)
    got = {r.doc_id: r.score for r in quality.scored(spark.read.parquet(f"{sf_dir}/documents.parquet"), model).collect()}
    mask = (1 << 64) - 1
    odd = [(2 * k + 1) * 0x9E3779B97F4A7C15 & mask for k in range(16)]

    def slot(value, salt):
        x = (value + salt + 1) * odd[salt % 16] & mask
        x ^= x >> 29
        return (x * 0xBF58476D1CE4E5B9 & mask) >> (64 - quality.BITS)

    for i, text in sorted(docs.items())[:40]:
        found = []
        for k, n in enumerate(quality.ORDERS):
            for at in range(len(text) - n + 1):
                h = 0
                for c in text[at : at + n]:
                    h = (h * 0x9E3779B97F4A7C15 + ord(c)) & mask
                found.append(slot(h, k))
        raw, offsets = utf8(pa.array([text], "large_string"))
        words = re.findall(rb"[^\x20\x09-\x0D]+", text.encode())
        hashes = Words(raw, offsets).hash.tolist()
        assert len(hashes) == len(words)
        lower = [w.lower() for w in words]
        for at, (w, h) in enumerate(zip(words, hashes, strict=True)):
            before = int(_KIND[words[at - 1][-1]]) if at else 0
            again = lower[at] in lower[max(0, at - 4) : at]
            found += [slot(h, len(quality.ORDERS)), slot(((before * 8 + int(_KIND[w[0]])) * 8 + int(_KIND[w[-1]])) * 2 + again, len(quality.ORDERS) + 1)]
        z = (sum(table[s] for s in found) / max(1, len(found)) + 0.1) * 2.0 - 0.2
        assert abs(got[i] - 1 / (1 + np.exp(-z))) < 1e-6
