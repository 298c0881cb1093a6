import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, score double, uid long"


@pytest.fixture
def docs(spark):
    """A table of (id, text) rows with extra columns, some of them named like columns of results."""

    def make(rows, partitions=3):
        full = [(i, t, "en", "s", None if t is None else len(t), None, None, None) for i, t in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(partitions)

    return make


EDGES = [(1, None), (2, ""), (3, "   \n\t "), (4, "word"), (None, "a text without an id"), (5, "x" * 30_000), (6, "same same text"), (6, "same same text"), (7, "same same text"), (8, "née ﬁ ▁ İ 漢字\r\nline two ")]


@pytest.fixture
def edge_rows():
    return EDGES
