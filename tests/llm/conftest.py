from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from ``(doc_id, text)`` pairs, with the other columns of the table."""

    def make(rows, extra: dict | None = None):
        full = [(i, t, "en" if t else None, "src0", len(t) if t else None) for i, t in rows]
        df = spark.createDataFrame(full, DOCUMENTS)
        return df.selectExpr("*", *(f"{v} AS {k}" for k, v in (extra or {}).items()))

    return make


CLASHING = {"n_tokens": "'x'", "score": "1", "key": "2", "node": "'n'", "component": "0", "row": "5", "sequence_id": "'s'"}


@pytest.fixture
def odd_docs(docs_of):
    """Null, empty, blank, very long and repeated texts, a null id, and columns with names operators use inside."""
    long = " ".join(f"word{k % 997}" for k in range(30_000))
    rows = [
        (1, None), (2, ""), (3, " \t\n "), (4, "a"), (5, "same words in this text"), (6, "same words in this text"),
        (6, "same words in this text"), (7, long), (8, "x" * 200_000), (None, "no id here at all"), (9, "\n\n\n"),
        (10, "İstanbul ΣΑΣ ﬁ ½ 漢字 한국어 \u0000 end <|endoftext|> x"),
    ]
    return docs_of(rows, CLASHING)


@pytest.fixture
def no_docs(docs_of, spark):
    return spark.createDataFrame([], DOCUMENTS)
