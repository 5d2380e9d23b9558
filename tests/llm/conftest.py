from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, doc_id_extra long, fp long, score double"


@pytest.fixture(scope="session")
def odd(spark):
    """Rows that every operator must survive: nulls, empties, ties, repeated rows, clashing extra columns."""
    rows = [
        (1, "The end of a plain line.\nAnother line of it.", "en", "a", 40, 7, 7, 0.5),
        (1, "The end of a plain line.\nAnother line of it.", "en", "a", 40, 7, 7, 0.5),
        (2, None, "en", "a", None, None, None, None),
        (3, "", None, None, 0, 1, 1, 1.0),
        (4, " \t\n\r\v\f ", "fr", "b", 6, 1, 1, 1.0),
        (None, "no id here", "en", "b", 10, 1, 1, 1.0),
        (5, "x" * 70_000, "en", "c", 70_000, 1, 1, 1.0),
        (6, "12345 678", "en", "c", 9, 1, 1, 1.0),
        (7, "Grüße, 漢字 🙂 <|im_end|> \\ ▁ é", "de", "c", 30, 1, 1, 1.0),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)
