from __future__ import annotations

import pytest

from tests.conftest import DATA

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that operators use inside, as columns of a given table.
CLASHING = ["words", "hashes", "grams", "bins", "fp", "node", "key", "line", "site", "label", "score", "place", "ids", "id", "held", "turns", "segments", "bag", "tail_hash", "text_hash"]


@pytest.fixture(scope="session")
def tiny(tmp_path_factory):
    return f"{DATA}/sf0.01"


@pytest.fixture
def docs(spark):
    """Rows (doc_id, text[, lang, source]) as documents with columns of clashing names."""

    def make(rows):
        full = [(i, t, *(rest + [None, None])[:2], len(t or "")) for i, t, *rest in rows]
        df = spark.createDataFrame(full, DOCS)
        return df.selectExpr("*", *[f"'x' as `{c}`" for c in CLASHING])

    return make
