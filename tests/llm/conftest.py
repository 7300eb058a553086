"""Fixtures of small tables for the training-data operators."""

from __future__ import annotations

import random

import pytest

#: Text, language and other columns, some named like columns that the operators make.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, fp long, component_id long, _key string, _repeated boolean, slot int, shard string"


def frame(spark, rows, schema=SCHEMA):
    """A documents table from (doc_id, text) pairs; the other columns are null."""
    n = schema.count(",") + 1
    return spark.createDataFrame([(*r, *[None] * (n - len(r))) for r in rows], schema)


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 8))) for _ in range(n))


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, ties and repeated rows, beside columns of clashing names."""
    long = prose(1, 60_000)
    rows = [(1, None), (2, ""), (3, "   \n\t "), (4, long), (5, long), (6, "Café \U0001f600 naïve"), (6, "Café \U0001f600 naïve"), (None, "no id here"), (None, None), (7, "x" * 50_000), (8, "7" * 50_000), (-9, "mail me at a.b@example.org now")]
    return frame(spark, rows)


@pytest.fixture(scope="session")
def none(spark):
    return frame(spark, [])
