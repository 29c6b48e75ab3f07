import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """A documents table of (id, text) rows, with extra columns named like results."""

    def make(rows):
        full = [(i, t, "en", "s", len(t or "")) for i, t in rows]
        df = spark.createDataFrame(full, DOC)
        clashing = ("kept", "score", "n_words", "digest", "id", "uid", "label", "size", "key", "component")
        return df.selectExpr("*", *[f"'extra' as {c}" for c in clashing])

    return make
