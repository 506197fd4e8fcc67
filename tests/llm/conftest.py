import pytest


@pytest.fixture(scope="session")
def docs(spark):
    """A documents table of (doc_id, text) rows, with columns whose names clash with results."""

    def make(*rows):
        return spark.createDataFrame(
            [(i, t, "en", "s", len(t or ""), "x", "y", 0) for i, t in rows],
            "doc_id long, text string, lang string, source string, n_chars long, kept string, text_digest string, print int")

    return make


def rows(df, *cols):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=repr)
