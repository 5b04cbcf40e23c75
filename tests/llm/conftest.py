import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture
def documents(spark):
    """Documents of given texts, numbered from 0."""

    def make(texts, ids=None, langs=None, sources=None):
        n = len(texts)
        rows = list(zip(ids or range(n), texts, langs or ["en"] * n, sources or ["s"] * n, [len(t or "") for t in texts]))
        return spark.createDataFrame(rows, SCHEMA)

    return make


#: Nulls, blanks, ties, repeats, odd characters and a long word.
ODD = [None, "", " \n\t ", "a", "a", "é ü ß", "x" * 5000, "one two three", "ONE two Three", "\n\n", " wide blank", "emoji 😀 text", "a\x00b", "tab\tand\x0bfeed"]
