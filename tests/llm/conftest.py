import pytest


@pytest.fixture
def frame(spark):
    """A DataFrame of dicts under a schema; missing columns are null."""

    def make(schema: str, rows: list[dict] | None = None):
        names = [c.split()[0] for c in schema.split(", ")]
        return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows or []], schema)

    return make


DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, row_id long"
EDGE = [
    {"doc_id": 1, "text": None},
    {"doc_id": 2, "text": ""},
    {"doc_id": 3, "text": "one two three"},
    {"doc_id": 3, "text": "one two three"},
    {"doc_id": None, "text": "no id here at all"},
    {"doc_id": 4, "text": "%%% \t ***"},
    {"doc_id": 5, "text": "word " * 60_000, "key": "clash", "row_id": 9},
]


@pytest.fixture
def edge_docs(frame):
    """Null, empty, repeated, wordless and very long texts, a null id, and extra columns with names used inside."""
    return frame(DOCS, EDGE).repartition(3)


@pytest.fixture
def no_docs(frame):
    return frame(DOCS)
