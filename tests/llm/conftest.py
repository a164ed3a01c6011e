"""Tables with every awkward row."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

#: Names that operators use for columns of their own.
CLASHING = ("score", "rejected", "lang_pred", "_found", "_mine", "_id", "_sha", "class_id", "digest", "shard", "ids", "held_out", "locator", "rep", "first")
LONG = " ".join(f"word{i % 977} tail{i % 31}" for i in range(60_000))


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns with clashing names."""
    rows = [
        (1, "the quick brown fox jumps over the lazy dog today", "en", "a", 1, "x"),
        (1, "the quick brown fox jumps over the lazy dog today", "en", "a", 1, "x"),
        (2, "the quick  brown\tfox jumps over the lazy dog today", "en", "a", None, "x"),
        (3, None, None, None, None, None),
        (4, "", "en", "a", 1, "x"),
        (None, "the quick brown fox jumps over the lazy dog today", "en", "a", 1, "x"),
        (None, None, None, None, None, None),
        (5, LONG, "en", "a", 1, "x"),
        (6, "!!! ... 123", "en", "a", 1, "x"),
        (7, "fox", "de", "b", 1, "y"),
        (8, "퟿ é 中文 🙂 \x0b\x0c", "fr", "b", 1, "y"),
    ]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, size int, row string").withColumns({n: F.lit(n) for n in CLASHING})


@pytest.fixture(scope="session")
def none(spark, odd):
    return spark.createDataFrame([], odd.schema)
