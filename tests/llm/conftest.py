import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

from llm_fixtures import LONG  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row long, doc string, size string, block string, wide string, queue string, score string, `key` string"

@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls everywhere, empty and very long texts, equal rows, columns named like helpers'."""
    rows = [
        (1, "alpha beta gamma delta epsilon zeta eta theta", "en", "s1", 10, None, "d", None, "b", None, "q", "s", "k"),
        (2, "alpha beta gamma delta epsilon zeta eta theta", "en", "s1", 10, 1, None, "z", "b", "w", "q", "s", None),
        (2, "alpha beta gamma delta epsilon zeta eta theta", "en", "s1", 10, 1, None, "z", "b", "w", "q", "s", None),
        (3, None, None, None, None, None, None, None, None, None, None, None, None),
        (None, "a text without an id", "en", "s2", 1, 1, "d", "z", "b", "w", "q", "s", "k"),
        (None, None, None, None, None, None, None, None, None, None, None, None, None),
        (4, "", "en", "s2", 0, 1, "d", "z", "b", "w", "q", "s", "k"),
        (5, " \n\t ", "en", "s3", 3, 1, "d", "z", "b", "w", "q", "s", "k"),
        (6, LONG, "en", "s3", len(LONG), 1, "d", "z", "b", "w", "q", "s", "k"),
        (7, "Été çà <|endoftext|> d'accord it's 42  x", "fr", "s3", 5, 1, "d", "z", "b", "w", "q", "s", "k"),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
