from __future__ import annotations

import pytest

LONG = "word " * 30_000


@pytest.fixture
def awkward(spark):
    """Documents with NULLs, empty and very long texts, ties, repeated rows and columns whose names clash."""
    rows = [
        (1, "a b c d e f g", "en", None, 1), (2, "a b  c d e f g", None, "src", 2), (3, None, "en", "src", 3),
        (4, "", None, None, None), (5, LONG, "en", "src", 5), (None, "no id here", "en", "src", 6),
        (7, "x y z", "en", "src", 7), (7, "x y z", "en", "src", 7), (8, LONG + "end", "en", "src", 8), (9, " \n\t", "", "", 9),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, keep_id int")


@pytest.fixture
def nothing(awkward):
    return awkward.limit(0)
