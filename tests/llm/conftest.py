import pytest

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """Documents from texts, or from (doc_id, text, source)."""

    def make(rows):
        full = [(i, r, "en", f"s{i % 3}", None) if r is None or isinstance(r, str) else (r[0], r[1], "en", r[2], None) for i, r in enumerate(rows)]
        return spark.createDataFrame(full, DOC_SCHEMA)

    return make
