from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row long, _k string, fp string"


@pytest.fixture(scope="session")
def docs(spark):
    """Make a documents table from texts (or (id, text) pairs); it has extra columns whose names
    operators use themselves."""

    def make(*rows, lang="en", source="src0"):
        rows = [r if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)]
        return spark.createDataFrame(
            [(i, t, lang, source, len(t or ""), 7, "k", "f") for i, t in rows], DOCS
        )

    return make


#: Nulls, empty and white texts, ties, repeated rows, a long text and one without spaces.
ODD = [
    (1, "the cat sat on the mat and looked at the moon"),
    (1, "the cat sat on the mat and looked at the moon"),
    (2, None),
    (3, ""),
    (4, " \t\n"),
    (None, "a row without an id"),
    (None, None),
    (7, "x" * 3000),
    (8, "long text " * 5000),
    (9, "Ünïcode \U0001f600 <|im_end|> 1234abc"),
]
