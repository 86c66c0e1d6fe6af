import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))


@pytest.fixture(scope="session")
def llm_docs(spark):
    """(rows) -> a documents table with columns that clash with the operators' own names."""

    def make(rows):
        full = [(i, t, "en", s, len(t) if t is not None else None, "x", 1) for i, t, s in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, kept string, size int").repartition(3)

    return make
