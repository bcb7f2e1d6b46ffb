import pytest

ODD = [
    (1, "one two three four five six"), (2, None), (3, ""), (4, " \t\n"), (5, "x"), (5, "x"), (None, "no id here at all"),
    (6, "ünïcode ÀÉ  wide space 東京"), (7, "long " * 30_000), (8, "!!! ??? 123"),
    (9, "a\x00b <|endoftext|> \U0001f600"),
]


@pytest.fixture
def docs(spark):
    """Documents from (doc_id, text) pairs, with columns whose names operators use inside."""

    def make(rows):
        wide = [(*r, "here", "fp", 0, len(r[1] or "")) for r in rows]
        return spark.createDataFrame(
            wide, "doc_id bigint, text string, source string, key string, hashes int, n_chars bigint")

    return make


@pytest.fixture
def odd(docs):
    """Nulls, empty and very long texts, repeated rows, a null id."""
    return docs(ODD)


@pytest.fixture
def none(docs):
    return docs([])
