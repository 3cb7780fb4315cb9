import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (doc_id, text, lang, source), with a column whose name clashes with what operators add."""

    def make(rows):
        full = [(i, t, lang, source, len(t or ""), "kept as it is") for i, t, lang, source in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, score string")

    return make
