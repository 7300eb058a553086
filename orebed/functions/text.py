"""Text expressions: tokens, numbers, findings, similarity."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The token shapes and patterns that results must match.
WORD_TOKENS = "[a-z]+(?:-[a-z0-9]+)+|[a-z]+[0-9]+|[0-9]+(?:\\.[0-9]+)?|[a-z]+"
#: The same matches, with a look at each letter only once; RE2 has no such form.
WORD_TOKENS_ONCE = "[a-z]++(?:(?:-[a-z0-9]++)++|[0-9]++)?|[0-9]++(?:\\.[0-9]++)?"
SIMPLE_TOKENS = "[a-z0-9]{2,}"
INJECTION = {
    "instruction_override": "(?i)ignore\\s+(?:all\\s+)?(?:(?:previous|prior)(?:\\s+system)?|system)\\s+instructions?",
    "policy_bypass": "(?i)(?:bypass|disable|override)\\s+(?:the\\s+)?(?:policy|safety|guardrails?)",
    "data_exfiltration": "(?i)(?:upload|send|exfiltrate)\\s+(?:all\\s+)?(?:files|secrets|documents|data)",
    "role_spoofing": "(?i)(?:system|developer)\\s*(?:message|prompt)\\s*:",
}
#: Java's boundary knows letters of all scripts; this one only A-Z, a-z, 0-9 and _, as RE2's.
PLAIN_BOUNDARY = "(?:(?<=\\w)(?!\\w)|(?<!\\w)(?=\\w))"


def as_re2(pattern: str) -> str:
    """A pattern that Java matches as RE2 does: plain boundaries and spaces, and letters of either case in all scripts."""
    own = pattern.replace("(?i)", "(?iu)").replace("\\s", "[\\t\\n\\f\\r ]")
    if "@" not in pattern:  # the others begin and end with plain letters and digits, so one look is enough
        own = re.sub(r"^((?:\(\?iu\))?)\\b", r"\1(?<!\\w)", own)
        own = re.sub(r"\\b$", r"(?!\\w)", own)
    return own.replace("\\b", PLAIN_BOUNDARY)


PII = {
    "email": "(?i)\\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\\.[A-Z]{2,}\\b",
    "pan_like": "\\b[A-Z]{5}[0-9]{4}[A-Z]\\b",
    "account_identifier": "(?i)\\b(?:account|a/c)\\s*(?:no\\.?|number)?\\s*[:#-]?\\s*[0-9]{8,18}\\b",
    "address_like": "(?i)\\b[0-9]{1,5}\\s+[A-Za-z][A-Za-z .'-]{2,40}\\s+(?:road|rd|street|st|lane|ln|avenue|ave)\\b",
}
PII_BOUNDED = {  # these look around, which RE2 can't
    "phone": "(?<![0-9])(?:\\+91[- ]?)?[6-9][0-9]{9}(?![0-9])",
    "aadhaar_like": "(?<![0-9])[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}(?![0-9])",
}
CARD = "[0-9](?:[ -]?[0-9]){12,18}"
MULTIPLIERS = {"k": 1e3, "thousand": 1e3, "m": 1e6, "mn": 1e6, "million": 1e6, "bn": 1e9, "billion": 1e9, "lakh": 1e5, "crore": 1e7}


def tokens(text: Column) -> Column:
    """Lower-cased compounds, codes, decimals and words; a compound's parts follow as tokens of their own."""
    low = F.regexp_replace(F.regexp_replace(F.lower(text), "≤", " less than or equal "), "≥", " greater than or equal ")
    found = F.regexp_extract_all(low, F.lit(WORD_TOKENS_ONCE), F.lit(0))
    parted = F.flatten(F.transform(found, lambda t: F.when(t.contains("-"), F.concat(F.array(t), F.split(t, "-"))).otherwise(F.array(t))))
    return F.when(low.rlike("[a-z]-[a-z0-9]"), parted).otherwise(found)  # texts without compounds need no second look


def simple_tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits of two characters or more."""
    return F.regexp_extract_all(F.lower(text), F.lit(SIMPLE_TOKENS), F.lit(0))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct elements; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def containment(a: Column, b: Column) -> Column:
    """Share of a's distinct elements that b has; 0 if there are none."""
    n = F.size(F.array_distinct(a))
    return F.when(n > 0, F.size(F.array_intersect(a, b)) / n).otherwise(0.0)


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(digits)
    value = lambda i: F.substring(digits, i, F.lit(1)).cast("int")
    doubled = lambda d: F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)
    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda s, i: s + F.when((n - i) % 2 == 1, doubled(value(i))).otherwise(value(i)))
    return F.when(n > 0, total % 10 == 0).otherwise(False)


def cards(text: Column) -> Column:
    """Numbers of 13 to 19 digits, by blanks or hyphens parted, that pass the Luhn check."""
    found = F.transform(F.regexp_extract_all(text, F.lit(CARD), F.lit(0)), lambda c: F.regexp_replace(c, "[ -]", ""))
    return F.filter(found, luhn)


def masked(value: Column) -> Column:
    """First and last two characters with asterisks between; short values are masked whole."""
    n = F.length(value)
    return F.when(n <= 4, F.repeat(F.lit("*"), n)).otherwise(F.concat(F.substring(value, 1, 2), F.repeat(F.lit("*"), n - 4), F.substring(value, -2, 2)))


def findings(text: Column, patterns: dict[str, str]) -> Column:
    """array<struct<kind, value>> of all matches of named patterns."""
    each = [F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(0)), lambda v, k=kind: F.struct(F.lit(k).alias("kind"), v.alias("value"))) for kind, p in patterns.items()]
    return F.concat(*each)


def sentences(text: Column) -> Column:
    """Text split after ., ! or ? where white space and a capital or digit follow."""
    return F.filter(F.transform(F.split(text, "(?<=[.!?])\\s+(?=[A-Z0-9])"), lambda s: F.trim(s)), lambda s: s != "")


def word_windows(text: Column, size: int, overlap: int, least: int) -> Column:
    """array<struct<start, n, words>>: windows of size words that overlap, of least words or more."""
    words = F.filter(F.split(text, "\\s+"), lambda w: w != "")
    starts = F.sequence(F.lit(0), F.greatest(F.size(words) - 1, F.lit(0)), F.lit(size - overlap))
    made = F.transform(starts, lambda s: F.struct(s.alias("start"), F.least(F.lit(size), F.size(words) - s).alias("n"), F.array_join(F.slice(words, s + 1, F.lit(size)), " ").alias("words")))
    return F.filter(made, lambda w: w["n"] >= least)


def number_value(token: Column) -> Column:
    """The value of a number with commas and a multiplier word (k, mn, crore ...); null if it isn't one."""
    low = F.lower(F.trim(token))
    base = F.regexp_replace(F.regexp_extract(low, "([+-]?[0-9][0-9,]*(?:\\.[0-9]+)?)", 1), ",", "")
    unit = F.regexp_extract(low, "(thousand|million|billion|crore|lakh|bn|mn|k|m)$", 1)
    factor = F.coalesce(F.create_map(*[x for k, v in MULTIPLIERS.items() for x in (F.lit(k), F.lit(v))])[unit], F.lit(1.0))
    return F.when(base != "", base.cast("double") * factor)


def normal_reference(value: Column) -> Column:
    """Trimmed, upper-cased, white space collapsed."""
    return F.upper(F.regexp_replace(F.trim(value), "\\s+", " "))


def fold(flags: dict[str, Column], default: str) -> Column:
    """The name of the first flag that holds (a decision ladder)."""
    out = None
    for name, flag in flags.items():
        out = F.when(flag, name) if out is None else out.when(flag, name)
    return out.otherwise(default) if out is not None else F.lit(default)
