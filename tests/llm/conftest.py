import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, url string"


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table with an extra column from (doc_id, text, lang, source) rows."""

    def make(rows):
        return spark.createDataFrame([(*r, len(r[1]) if r[1] else 0, "u") for r in rows], SCHEMA).repartition(3)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Null, empty, blank, long, repeated and multi-byte texts."""
    long = " ".join(f"word{i % 997}" for i in range(30_000))
    return [
        (1, None, None, None), (2, "", "en", "a"), (3, " \n\t ", "en", None), (4, long, "en", "a"), (4, long, "en", "a"), (5, "Ünïcödé 🎉 日本語 ▁ \x00 x", "de", "b"),
        (6, "x" * 5000, None, "b"), (None, "no id here at all for this text", "en", "c"), (7, "the same words again", "en", "a"), (8, "the same words again", "en", "b"),
    ]
