"""Personal data: candidate spans from generous patterns, chosen by gradient-boosted trees.

Four base patterns with checks (see ``base_spans``) always count. Beside them, generators
propose overlapping spans of each kind in looser shapes: spelled-out or bracketed mail addresses, addresses
with other separators or ports, numbers grouped otherwise, telephone numbers without
a country code. Features describe a candidate's format and the words around it;
trees, trained on labelled examples that this module makes from templates, score it; of overlapping
candidates the likeliest stays, if it reaches its kind's threshold, which is
calibrated for precision on examples that the trees have not seen.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from orebed.llm.boosting import BoostedTrees, threshold_for

KINDS = ("email", "ip", "card", "phone")
#: Precision that a kind's threshold must reach on the calibration examples.
PRECISION = 0.995
EXAMPLES = 6000
#: Candidates of a text that are scored at once.
SCORED = 10_000

LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")  # a start within digits fails where the first of them failed
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")

GENERATORS = (
    ("email", re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+\s?(?:@|\(at\)|\[at\]|\{at\}|\x20at\x20)\s?[A-Za-z0-9-]+(?:(?:\.|\s?(?:\(dot\)|\[dot\]|\{dot\}|\x20dot\x20)\s?)[A-Za-z0-9-]+)+", re.I)),
    ("ip", re.compile(r"(?<![0-9A-Za-z])[0-9]{1,3}(?:\s?(?:\.|\[\.\]|\(\.\)|,|-)\s?[0-9]{1,3}){3}(?![0-9A-Za-z])")),
    ("card", re.compile(r"(?<![0-9A-Za-z])[0-9]{4}(?:[._/\xa0\x20-]{1,3}[0-9]{3,6}){2,4}(?![0-9A-Za-z])")),
    ("phone", re.compile(r"(?<![0-9A-Za-z.+])(?:00[1-9][0-9]{0,2}[\x20./-]?)?\(?[0-9]{2,5}\)?(?:[\x20./-]{1,3}[0-9]{2,7}){1,4}(?![0-9A-Za-z])")),
)
#: Text pieces of which one must occur (lower-cased) before a mail address without @ is looked for.
SPELLED = ("(at)", "[at]", "{at}", " at ")

# Words that hint at a kind, or against all.
CUES = {
    "email": ("mail", "e-mail", "email", "contact", "write", "reach", "correo", "courriel", "adresse"),
    "ip": ("ip", "host", "server", "address", "login", "addr", "client", "ping"),
    "card": ("card", "visa", "mastercard", "credit", "payment", "karte", "tarjeta", "carte", "paid", "billing"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "cell", "telefon", "telefono", "telephone", "ring", "sms", "whatsapp"),
}
AGAINST = ("version", "release", "isbn", "order", "invoice", "section", "figure", "page", "serial", "part", "build", "ticket", "date", "total", "usd", "eur", "kg", "no", "id")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The spans that always count, by kind and start."""
    out = emails(text)
    if DIGIT.search(text):
        out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(_small(p) for p in m[0].split("."))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 13:
                digits = m[0].replace(" ", "").replace("-", "")
                if 13 <= len(digits) <= 19 and luhn(digits):
                    out.append(("card", m.start(), m.end()))
        if "+" in text:
            out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return out


def emails(text: str) -> list[tuple[str, int, int]]:
    """Leftmost matches of local part, @ and dotted domain; each has one @, so the search goes from @ to @ in linear time."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start, step = at, 64
        while start > done:  # back over the local part, in growing steps
            piece = text[max(done, start - step) : start]
            rest = len(piece.rstrip(LOCAL))
            start -= len(piece) - rest
            step *= 4
            if rest:
                break
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            out.append(("email", start, domain.end()))
            done = domain.end()
        at = text.find("@", max(at + 1, done))
    return out


def _small(part: str) -> bool:
    return len(part := part.lstrip("0")) <= 3 and int(part or "0") <= 255


def candidates(text: str) -> list[tuple[str, int, int]]:
    """Generous spans of every kind; they may overlap."""
    out = []
    low = text.lower()
    if "@" in text or any(s in low for s in SPELLED):
        out += [("email", m.start(), m.end()) for m in GENERATORS[0][1].finditer(text)]
    if DIGIT.search(text):
        for kind, pattern in GENERATORS[1:]:
            out += [(kind, m.start(), m.end()) for m in pattern.finditer(text)]
    return out


def describe(text: str, kind: str, start: int, end: int) -> list[float]:
    """Format and context features of a candidate."""
    span = text[start:end]
    digits = "".join(c for c in span if c in "0123456789")
    groups = re.findall(r"[0-9]+", span)
    before = re.findall(r"[a-z-]+", text[max(0, start - 40) : start].lower())[-4:]
    after = re.findall(r"[a-z-]+", text[end : end + 20].lower())[:2]
    near = text[max(0, start - 1) : start]
    last = re.split(r"\.|\(dot\)|\[dot\]|\{dot\}|\x20dot\x20", span.lower())[-1].strip()
    return [
        float(KINDS.index(kind)),
        float(len(span)),
        float(len(digits)),
        float(len(groups)),
        float(max(map(len, groups), default=0)),
        float(min(map(len, groups), default=0)),
        float(len(groups[0]) if groups else 0),
        float(len(groups[-1]) if groups else 0),
        float(bool(groups) and all(len(g) <= 3 and int(g) <= 255 for g in groups)),
        float(bool(digits) and luhn(digits)),
        float(len(set(digits))),
        float(sum(c in " \xa0" for c in span)),
        float(span.count("-")),
        float(span.count(".")),
        float(span.count("/")),
        float("(" in span),
        float("[" in span or "{" in span),
        float("@" in span),
        float(len({c for c in span if not c.isalnum()})),
        float(last.isalpha() and 2 <= len(last) <= 6),
        float(" at " in span.lower()),
        float(near in (":", "=", "(", '"', "<")),
        float(any(w in CUES[kind] for w in before)),
        float(any(w in CUES[k] for w in before for k in KINDS if k != kind)),
        float(any(w in AGAINST for w in before)),
        float(bool(before) and before[-1] in CUES[kind]),
        float(any(w in AGAINST for w in after)),
        float(span[:1] == "0"),
        float(text[start - 2 : start] in ("# ", "$ ", "€ ") or near in "#$€%" and near != ""),
    ]


def examples(n: int = EXAMPLES, seed: int = 7) -> list[tuple[str, str, int, int, int]]:
    """Labelled samples: (text, kind, start, end, label) from templates, positive and negative alike in shape."""
    rng = np.random.default_rng(seed)
    pick = lambda *of: of[int(rng.integers(len(of)))]
    digits = lambda k: "".join(str(int(d)) for d in rng.integers(0, 10, k))
    word = lambda: "".join(pick("ba", "re", "mon", "ti", "er", "sal", "ne", "vo", "lin", "da") for _ in range(int(rng.integers(1, 4))))
    plain = lambda: " ".join(word() for _ in range(int(rng.integers(0, 5))))
    separators = (" ", "-", ".", "/", " - ")

    def card() -> str:
        body = pick("4", "5", "37", "6011") + digits(14)
        body = body[:15]
        return body + next(c for c in "0123456789" if luhn(body + c))

    def spelled(tld: str) -> str:
        at, dot = pick((" at ", " dot "), ("(at)", "(dot)"), (" [at] ", " [dot] "), ("{at}", "{dot}"), (" (at) ", "."), ("[at]", "."))
        return word() + pick("", ".", "_") + word() + at + word() + dot + tld

    out = []
    while len(out) < n:
        kind, label = pick(*KINDS), int(rng.integers(2))
        s = pick(*separators)
        cue = pick(*CUES[kind]) + pick(":", " ", ": ", " is ", "= ") if rng.random() < (0.7 if label else 0.05) else ""
        if not label and rng.random() < 0.5:
            cue = pick(*AGAINST) + pick(" ", ": ", " no. ", " #")
        if kind == "email":
            span = spelled(pick("com", "org", "net", "de", "fr", "io")) if label else pick(word() + " at " + word() + "." + word() + word(), word() + "@" + word() + ". " + word() + word(), word() + " at " + word() + "." + word() + "." + word(), "meet " + word() + " at " + word() + " dot " + word() + word() + word())
        elif kind == "ip":
            parts = [str(int(x)) for x in rng.integers(0, 256, 4)]
            span = pick("[.]", "(.)", " . ").join(parts) if label else pick(", ", "-", " - ", ",").join(str(int(x)) for x in rng.integers(0, 999, 4))
        elif kind == "card":
            c = card() if label else digits(16)
            while not label and luhn(c):
                c = digits(16)
            span = pick(".", "_", "/", " - ", "\xa0", "  ").join((c[:4], c[4:8], c[8:12], c[12:]))
        elif label:
            area, a, b = digits(3), digits(3), digits(4)
            span = pick(f"({area}) {a}-{b}", f"{area}{s}{a}{s}{b}", f"00{pick('1', '44', '49', '33')} {area} {a} {b}", f"0{digits(2)}/{digits(3)} {digits(4)}", f"({area}){s}{a}{s}{b}")
            if not span.startswith(("(", "00")) and not cue:
                cue = pick(*CUES[kind]) + ": "
        else:
            span = pick(f"{digits(4)}-{digits(2)}-{digits(2)}", f"{digits(2)}/{digits(2)}/{digits(4)}", f"{digits(3)}.{digits(2)}", f"{digits(2)}.{digits(2)}.{digits(2)}", f"{digits(5)}-{digits(3)}", f"{digits(3)} {digits(3)} {digits(3)}", f"{digits(2)}-{digits(4)}")
        text = f"{plain()} {cue}"
        out.append((f"{text}{span} {plain()}", kind, len(text), len(text) + len(span), label))
    return out


class Redactor:
    """Trees and the calibrated threshold of each kind."""

    def __init__(self, n: int = EXAMPLES, seed: int = 7, precision: float = PRECISION) -> None:
        rows = [r for r in examples(n, seed) if r[1:4] in candidates(r[0])]
        x = np.array([describe(t, k, s, e) for t, k, s, e, _ in rows])
        y = np.array([r[4] for r in rows], dtype=float)
        unseen = np.arange(len(rows)) % 3 == 0
        self.trees = BoostedTrees().fit(x[~unseen], y[~unseen])
        z = self.trees.log_odds(x)
        self.thresholds = {}
        for i, kind in enumerate(KINDS):
            own = unseen & (x[:, 0] == i)
            self.thresholds[kind] = max(0.0, threshold_for(z[own], y[own], precision)) if own.any() else float("inf")

    def spans(self, text: str, base: list[tuple[str, int, int]] | None = None) -> list[tuple[str, int, int]]:
        """All spans by kind, then start: the base ones, and candidates that touch none of them nor a likelier one.

        Characters of chosen spans are marked, so each candidate costs its own length, however many there are.
        """
        base = base_spans(text) if base is None else base
        found = candidates(text)
        if not found:
            return base
        taken = bytearray(len(text))
        for _, s, e in base:
            taken[s:e] = b"\1" * (e - s)
        found = [c for c in found if taken.find(1, c[1], c[2]) < 0]
        chosen = []
        if found:
            z = np.concatenate([self.trees.log_odds(np.array([describe(text, *c) for c in found[at : at + SCORED]])) for at in range(0, len(found), SCORED)])
            for i in np.lexsort(([c[1] for c in found], -z)):
                kind, s, e = found[i]
                if z[i] >= self.thresholds[kind] and taken.find(1, s, e) < 0:
                    chosen.append((kind, s, e))
                    taken[s:e] = b"\1" * (e - s)
        return sorted(base + chosen, key=lambda c: (KINDS.index(c[0]), c[1]))


@lru_cache(maxsize=1)
def trained() -> Redactor:
    """The redactor; its samples have a fixed seed, so every process trains the same one."""
    return Redactor()


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def found(docs: DataFrame, model: Redactor | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every whole text.

    Counts and digest are of the base spans. A null text counts as empty. Each row gives one row, repeated rows and null ids too; an
    empty table gives none. Base spans of different kinds may overlap; of candidates equally likely the first stays. Very long texts are
    searched whole. One pass, nothing is moved, other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model or trained())
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, shas, spans = {k: [] for k in KINDS}, [], []
            for text in batch.column(1).to_pylist():
                base = base_spans(text or "")
                for k in KINDS:
                    counts[k].append(sum(b[0] == k for b in base))
                shas.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined(shared.value.spans(text or "", base)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(counts[k], pa.int64()) for k in KINDS), pa.array(shas), pa.array(spans, pa.string())], names=[id_col, *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {id_type}, {', '.join(f'n_{k} long' for k in KINDS)}, base_sha256 string, spans string")


def redacted(docs: DataFrame, model: Redactor | None = None, text_col: str = "text") -> DataFrame:
    """docs with each span of the texts replaced by its kind in angle brackets; overlapping spans become one. Null texts stay null, all rows and other columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model or trained())

    def clean(text: str | None) -> str | None:
        spans = sorted(shared.value.spans(text), key=lambda c: (c[1], -c[2])) if text else []
        if not spans:
            return text
        out, at = [], 0
        for kind, start, end in spans:
            if start >= at:
                out += [text[at:start], f"<{kind}>"]
            at = max(at, end)
        return "".join([*out, text[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i = batch.schema.get_field_index(text_col)
            yield batch.set_column(i, batch.schema.field(i), pa.array([clean(t) for t in batch.column(i).to_pylist()], batch.schema.field(i).type))

    return docs.mapInArrow(run, docs.schema)
