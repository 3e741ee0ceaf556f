import pytest


@pytest.fixture(scope="session")
def documents(spark):
    """Rows with nulls, empty and long texts, repeated rows and extra columns."""
    rows = [
        (1, "One short text about a river and its long winding banks.", "en", "a", 56),
        (2, "One short text about a river and its long winding banks.", "en", "a", 56),
        (2, "One short text about a river and its long winding banks.", "en", "a", 56),
        (3, None, "en", None, None),
        (4, "", None, "b", 0),
        (None, "No id here, but the text is whole.", "en", "b", 34),
        (5, "Zeichen " * 4000, "de", "c", 32000),
        (6, "\n\n  \n", "fr", "c", 5),
        (7, "été 東京 naïve — “quotes”\r\nΣίσυφος", "fr", "d", 30),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def nothing(documents):
    return documents.limit(0)
