import pytest

#: Rows with every awkward case: nulls, empties, ties, repeats, a long text.
ROWS = [
    (1, "the quick brown fox jumps over the lazy dog and runs away", "en", "s", 1),
    (2, "The  quick brown\tfox jumps over the lazy dog and runs away", "en", "s", 1),
    (3, None, None, None, None),
    (4, "", "en", "s", 0),
    (5, " \n\t ", "en", None, 4),
    (6, 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" é x́ <|endoftext|> a   b 　c', "fr", "t", 9),
    (6, 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" é x́ <|endoftext|> a   b 　c', "fr", "t", 9),
    (None, "no id here &&& at all", "en", "s", 3),
    (8, "long words " * 20_000, "en", "s", 220_000),
    (9, "Σίσυφος ΣΑΣ İstanbul 12 345 don't we'll \U0001f600\U0001f600", "el", "s", 40),
]


@pytest.fixture(scope="session")
def odd(spark):
    """The awkward rows, with extra columns that clash with inner names."""
    extra = [(*r, "x", 2, None) for r in ROWS]
    return spark.createDataFrame(extra, "doc_id long, text string, lang string, source string, n_chars long, fp string, kept int, `a.b` string")


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")
