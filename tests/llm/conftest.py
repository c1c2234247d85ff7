import sys
from pathlib import Path

import pytest

# Behind the folder of all tests, whose conftest is the one that tests import from.
sys.path.append(str(Path(__file__).resolve().parent))

from helpers import docs_of, prose, with_clashes  # noqa: E402


@pytest.fixture(scope="session")
def odd_rows():
    """Null ids and texts, empty, blank, repeated and very long texts."""
    long = prose(1, 60_000)
    return [
        (1, "One two three four five"), (1, "One two three four five"), (None, "One two three four five"), (None, None),
        (2, None), (3, ""), (4, " \n\t "), (5, long), (6, "é ñ   ß 日本語 🎉"), (7, "a"), (8, "Mit License " * 3), (9, "x" * 5000),
    ]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    return with_clashes(docs_of(spark, odd_rows))


@pytest.fixture(scope="session")
def no_docs(spark):
    return with_clashes(docs_of(spark, []))


@pytest.fixture(scope="session")
def documents(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


@pytest.fixture(scope="session")
def document_rows(documents):
    return [tuple(r) for r in documents.select("doc_id", "text").collect()]
