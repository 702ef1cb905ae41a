import pytest


@pytest.fixture
def where(tmp_path):
    return f"file://{tmp_path}/work"


@pytest.fixture
def docs_of(spark):
    """Documents from (doc_id, text) with the other columns, and one with clashing names."""

    def make(rows):
        full = [(i, t, "en", "s", None if t is None else len(t), "x") for i, t in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, keep string")

    return make


ODD = [(1, None), (2, ""), (2, ""), (None, "some text here"), (3, "a" * 20000), (4, "w " * 9000), (4, "w " * 9000), (5, "é😀\x00\n\n\t"), (6, " "), (7, "9" * 5000)]


@pytest.fixture
def odd_docs(docs_of):
    return docs_of(ODD)


@pytest.fixture
def no_docs(docs_of):
    return docs_of([])
