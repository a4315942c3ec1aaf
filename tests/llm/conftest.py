from __future__ import annotations

import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (doc_id, text, source) rows, with clashing and extra columns on request."""

    def make(rows, extra=False):
        df = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
        if extra:
            from pyspark.sql import functions as F

            for name in ("size", "rate", "copies", "ids", "decoded", "spans", "base", "score", "keep", "votes", "n", "digest", "component_id", "kept"):
                df = df.withColumn(name, F.lit("x"))
        return df

    return make


EDGES = [(1, "one two three four five six", "a"), (2, None, "a"), (3, "", None), (4, "one two three four five six", None), (None, "no id here at all, really none", "b"), (5, " \t\n ", "b"), (6, "word " * 40_000, "c"), (1, "one two three four five six", "a")]


@pytest.fixture(scope="session")
def edges():
    """Nulls in every column, empty and very long texts, ties and repeated rows."""
    return EDGES
