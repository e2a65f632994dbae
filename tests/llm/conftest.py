import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, repeated rows, equal ids, columns with clashing names."""
    rng = random.Random(4)
    words = ["alpha", "beta", "Gamma", "δέλτα", "x", "password", "éé", "42"]
    long = " ".join(rng.choice(words) + str(rng.randrange(9999)) for _ in range(20_000))
    rows = [
        (1, "one two three four five six", "en", "a", 27),
        (1, "one two three four five six", "en", "a", 27),
        (2, None, None, None, None),
        (3, "", "en", "", 0),
        (4, long, "de", "a", len(long)),
        (5, long + " tail", "de", "b", len(long) + 5),
        (6, "   \n\t ", "en", "b", 6),
        (7, "short", "en", "a", 5),
        (7, "another text of the same id", "en", "a", 5),
        (None, "a row without an id", "en", "a", 19),
        (None, None, None, None, None),
        (9, "ONE two  three four five SIX", None, "c", 28),
    ]
    extra = ", id long, group string, cell int, _source string, key long, label int, score double, range int, n long"
    return spark.createDataFrame([(*r, 1, "g", 2, "s", 3, 0, 0.5, 9, 4) for r in rows], DOCS + extra)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, None, None), (None, 0, 1), (4, 0, 1), (7, 1, 0)], "doc_id long, quality int, toxic int")
