from __future__ import annotations

import pytest
from sample_texts import ODD


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Odd texts with repeated rows, a null id and columns with clashing names."""
    rows = [(i, t, "en" if i % 2 else None, None, 0, "x", 1) for i, t in enumerate(ODD)] + [(3, ODD[3], "en", "s", 1, "x", 1), (None, "no id here at all", "en", "s", 1, "x", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, topic string, fp long")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
