"""The fixtures of the main tests, and a maker of document tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DOCS = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"


@pytest.fixture
def docs(spark):
    """``[text, ...]`` or ``[(doc_id, text, source), ...]`` to a documents table."""

    def make(rows, **more):
        rows = [r if isinstance(r, tuple) else (i, r, "src") for i, r in enumerate(rows)]
        df = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCS)
        # columns whose names clash with those the operators work with
        return df.selectExpr("*", "1 AS size", "'x' AS key", "2 AS uid", "3 AS n", "4 AS kept", "5 AS copies")

    return make


EDGES = ["", None, "   \n\t ", "one", "two words", "a b c d e f g h", "a b c d e f g h", "long " * 3000, "é ß ñ\n\n| x |"]


@pytest.fixture
def edges(docs):
    """Empty and null texts, short and long ones, repeated rows, null ids and sources."""
    rows = [(i, t, "src" if i % 2 else None) for i, t in enumerate(EDGES)]
    return docs([*rows, rows[5], rows[7], (None, "no id here", "src"), (None, None, None)])
