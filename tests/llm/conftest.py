import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, _id string, value int, h bigint, n bigint"


@pytest.fixture
def make_docs(spark):
    """Documents from (doc_id, text) pairs, with extra columns of names that the operators use too."""

    def make(rows, lang=None):
        return spark.createDataFrame([(i, t, lang[k] if lang else None, "s", len(t or ""), "x", 1, 2, 3) for k, (i, t) in enumerate(rows)], DOCS)

    return make


#: Texts that every operator has to take: null, empty, blank, one word, no letters, very long, and a long run without a break.
ODD = [None, "", " \t\n", "word", "12 !! 34", "a b c d e f g " * 20000, "x" * 200_000, "é😀 ü", "  "]
