import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, extra string, hash string"


@pytest.fixture
def docs(spark):
    """A maker of small document tables with extra columns."""

    def make(rows):
        full = [(i, t, lang, src, len(t or ""), "x", "y") for i, t, lang, src in ((*r, "en", "src0")[:4] if len(r) == 2 else r for r in rows)]
        return spark.createDataFrame(full, DOCS)

    return make
