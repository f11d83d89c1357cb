import pytest

LONG = "word " * 30_000
ODD = [
    (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu", "en", "s", 1),
    (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu", "en", "s", 1),
    (2, None, "en", None, None),
    (3, "", None, "s", 0),
    (4, " \n\t\n ", "fr", "s", 5),
    (None, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu", None, None, None),
    (None, None, None, None, None),
    (5, LONG, "en", "s", 150_000),
    (6, "x", "de", "s", 1),
    (7, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu", "fr", "s", 1),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty, blank and very long texts, ties and repeated rows."""
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def docs(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], SCHEMA)
