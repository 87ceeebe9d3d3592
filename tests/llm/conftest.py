import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, digest string, block int, key string"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text); the extra columns clash with names that operators use inside."""
    def make(rows):
        full = [(i, t, "en", "src0", len(t or ""), "x", 1, "k") for i, t in rows]
        return spark.createDataFrame(full, DOCS)
    return make


ODD = [(1, None), (2, ""), (3, " \t\n"), (None, "alone here and now"), (4, "one"), (4, "one"), (5, "two words"), (6, "word " * 60_000)]


@pytest.fixture(scope="session")
def odd_docs(make_docs):
    """Nulls, empty texts, repeated rows, a very long text."""
    return make_docs(ODD)
