import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """Makes a documents table from (doc_id, text) or whole rows."""

    def make(rows):
        whole = [r if len(r) == 5 else (*r, "en", "src0", len(r[1] or "")) for r in rows]
        return spark.createDataFrame(whole, DOCS)

    return make
