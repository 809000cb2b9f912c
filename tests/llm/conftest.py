"""Rows that every operator of documents must handle."""

import pytest

ODD = [
    (1, "the quick brown fox jumps over the lazy dog and runs away", "en"),
    (2, "the quick  brown fox\tjumps over the lazy dog and runs away", None),
    (2, "the quick  brown fox\tjumps over the lazy dog and runs away", None),
    (None, "the quick brown fox jumps over the lazy dog and runs away", "en"),
    (3, None, "en"),
    (4, "", None),
    (5, "  \n\t ", "fr"),
    (6, "Größe漢字 привет 🙂 \x1c\x85 x", "de"),
    (7, "word " * 30_000, "en"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty, blank and very long texts, repeated rows, and columns with clashing names."""
    rows = [(i, t, lang, "s", len(t or ""), f"f{k}", k, k, 0.5, "x") for k, (i, t, lang) in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, file string, row long, _metadata long, score double, v string")


@pytest.fixture(scope="session")
def docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")
