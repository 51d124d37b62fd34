import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (doc_id, text) pairs, with other columns whose names clash with internal ones."""

    def make(rows, lang=None):
        rows = [(i, t, lang[n] if lang else "en", "src", len(t or ""), n) for n, (i, t) in enumerate(rows)]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, th int")

    return make
