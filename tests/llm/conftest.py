import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """Rows ``(doc_id, text, lang, source)`` as documents, with an extra column whose name clashes with working names."""

    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", 7) for r in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, length int")

    return make
