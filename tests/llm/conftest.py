import pytest


@pytest.fixture(scope="session")
def docs(spark):
    """Rows that every operator must survive: nulls, empties, ties, repeats, a long text, odd columns."""
    rows = [
        (1, "One two three four five.\nOne two three four five.\n", "en", "a", 50, "x"),
        (2, None, None, None, None, None),
        (3, "", "en", "a", 0, "x"),
        (3, "", "en", "a", 0, "x"),
        (4, "é中\U0001f600 <|im_end|> Mail me: a.b@c.example.org, +1 (212) 555-0100.", "fr", "b", 60, None),
        (5, " \t\n\x0b\x0c\r   ", "en", "b", 8, ""),
        (None, "no key at all", "de", "b", 13, "y"),
        (6, "word " * 30000, "en", "a", 150000, "z"),
        (7, "x" * 200000, "en", "a", 200000, "z"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_words string")
