"""Small tables with the awkward rows that every operator must take."""

from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def make_docs(spark):
    """documents from texts or (doc_id, text[, lang, source]) rows."""
    def build(rows, extra=""):
        full = []
        for i, r in enumerate(rows):
            r = (i, r) if r is None or isinstance(r, str) else r
            doc_id, text, *more = r
            lang, source = (more + ["en", "s1"][len(more):])[:2]
            full.append((doc_id, text, lang, source, None if text is None else len(text)))
        docs = spark.createDataFrame(full, SCHEMA)
        return docs.selectExpr("*", *extra) if extra else docs
    return build


@pytest.fixture(scope="session")
def prose():
    """Invented prose of n words, the same for the same seed."""
    def build(n, seed=0, vocabulary=4000):
        draw = random.Random(seed)
        return " ".join(f"w{draw.randrange(vocabulary)}x" for _ in range(n))
    return build


@pytest.fixture(scope="session")
def awkward(make_docs, prose):
    """Nulls in every column, empty, blank and very long texts, ties and repeated rows, and clashing extra columns."""
    long = prose(30_000, 9)
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, prose(120, 1)), (3, prose(120, 1)), (4, prose(120, 1)), (None, prose(80, 2)),
            (5, long), (6, "x" * 50_000), (7, "é ü 日本 😀 'S 's a"), (8, prose(90, 3), None, None), (9, prose(90, 3), "de", None)]
    return make_docs(rows, ("'k' as key", "7 as ids", "1 as Row", "2 as size", "3 as spans"))


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
