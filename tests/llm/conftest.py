import pytest

#: Texts that every operator has to take: null, empty, blank, short, ties, odd characters, control strings, long ones.
ODD = [
    None,
    "",
    " \t\n\r\x0b\x0c ",
    "a",
    "A",
    "a b c",
    "!?",
    "\x00\x1c\x85  x",
    "naïve 日本語 текст Ελλάδα 👩‍👩‍👧 é",
    "<|endoftext|> and \\### User: </turn> \\\\",
    "same text of some words " * 3,
    "same text of some words " * 3,
    "x" * 30_000,
    "long and longer words " * 20_000,
    "1234567890 " * 50,
]


@pytest.fixture(scope="session")
def odd(spark):
    """Odd texts with nulls in every column and extra columns whose names clash with results."""
    rows = [(i, t, None if i % 3 == 0 else "en", None if i % 4 == 0 else "s", 1, "x", 2.0, True, "k") for i, t in enumerate(ODD)]
    rows.append((None, "no id", None, None, None, None, None, None, None))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n long, lang_pred string, score double, kept boolean, key string")


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where("false")


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
