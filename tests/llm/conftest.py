import pytest

LONG = "na" * 30_000
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rid long, kept string, _key string"
#: Nulls in every column, empty and very long texts, ties, repeated rows, and columns whose names the
#: operators use themselves.
TEXTS = [
    (1, "The cat sat on the mat and the dog lay by the door all day long"),
    (2, "the CAT sat on the mat and the dog lay by the door all day long"),
    (2, "the CAT sat on the mat and the dog lay by the door all day long"),
    (None, "The cat sat on the mat and the dog lay by the door all day long"),
    (None, None),
    (4, None),
    (5, ""),
    (6, "  \n\t "),
    (7, LONG),
    (8, "Été über ÀBİ \U0001F600 é <|endoftext|> 12 34"),
    (9, "one\ntwo\n" * 40),
    (10, "x"),
]


@pytest.fixture(scope="session")
def odd_rows():
    return TEXTS


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame([(i, t, None, None, None, 0, "k", "z") for i, t in TEXTS], SCHEMA)


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")
