import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """Builds a documents table of (doc_id, text) pairs; lang, source and n_chars follow from them."""
    def build(pairs):
        rows = [
            (i, t, "en", f"src{(i or 0) % 5}", None if t is None else len(t)) for i, t in pairs
        ]
        return spark.createDataFrame(rows, DOCS)

    return build
