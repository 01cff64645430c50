import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp long, component_id long, `key` string, row string, size long, word string"


@pytest.fixture(scope="session")
def make_docs(spark):
    """documents from (doc_id, text, lang, source) with further columns whose
    names clash with those the operators use."""

    def make(rows):
        full = [(i, t, lang, s, None if t is None else len(t), 1, 2, "k", "r", 3, "w") for i, t, lang, s in rows]
        return spark.createDataFrame(full, DOCS)

    return make
