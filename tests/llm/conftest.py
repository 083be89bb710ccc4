import pytest

LONG = "word salad " * 20_000
DOCS = [
    (1, "The quick brown fox.\nSecond line that is certainly longer than forty code points.", "en", "a"),
    (2, "The quick  brown fox.\tSecond line that is certainly longer than forty code points.", "en", "a"),
    (3, None, "en", None), (4, "", None, "b"), (5, " \t\n ", "fr", "b"), (6, LONG, "en", "b"), (7, LONG, "en", None),
    (8, "Émile était là, déjà vu à l'école du village.", "fr", "c"), (8, "Émile était là, déjà vu à l'école du village.", "fr", "c"),
    (None, "no id here but some words", "en", "a"), (None, "no id here but some words", "en", "a"), (9, "12 34 56 --", None, "c"),
]


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in every column, empty and long texts, repeated rows, and columns with the operators' own working names."""
    rows = [(*r, "x", 1, "y", 2.0, True, "z") for r in DOCS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, _id string, size int, row string, key double, kept boolean, found string")


@pytest.fixture(scope="session")
def nothing(awkward):
    return awkward.limit(0)
