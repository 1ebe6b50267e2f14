from __future__ import annotations

import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from texts, or from (id, text) pairs; extra columns have names that clash with inner ones."""

    def make(rows):
        pairs = [r if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)]
        return spark.createDataFrame([(i, t, None, "s", None) for i, t in pairs], DOCS)

    return make


@pytest.fixture(scope="session")
def odd_texts():
    """Null, empty, blank and very long texts, repeated rows and a null id."""
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    return [(1, None), (2, ""), (3, " \n\t \n"), (4, long), (5, "ties and ties and ties"), (5, "ties and ties and ties"), (None, "no id here"), (None, None)]
