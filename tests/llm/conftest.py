import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
PAGES = "page_id long, url string, html string"
#: Columns that an operator might use as names of its own.
CLASHING = "size long, node string, row string, words string, host string, line string, label string, q_words string, m_row long, texts string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and wordless texts, ties, repeated rows, a long text, clashing column names."""
    long = " ".join(f"w{i % 7919}x{i}" for i in range(30_000))
    rows = [
        (1, "one two three four five six seven", "en", "a", 33),
        (2, "one two three four five six seven", "en", "a", 33),
        (2, "one two three four five six seven", "en", "a", 33),
        (2, "quite another text with the same id as its neighbour", "en", "b", 52),
        (3, None, None, None, None),
        (4, "", "de", "b", 0),
        (5, " \t\n\x0b\f\r ", "fr", "b", 7),
        (None, "a text without an id, and of some length", "en", None, 40),
        (None, "a text without an id, and of some length", "en", None, 40),
        (6, long, "en", "c", len(long)),
        (7, "Ünï códe 漢字 \U0001f600 text\nsecond line\n\nsecond line", None, "c", 40),
        (8, "!!! ??? 123 456", "en", "c", 15),
    ]
    wide = [(*r, 1, "n", "r", "w", "h", "l", "b", "q", 2, "t") for r in rows]
    return spark.createDataFrame(wide, f"{DOCS}, {CLASHING}")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], f"{DOCS}, {CLASHING}")


@pytest.fixture(scope="session")
def odd_pages(spark):
    rows = [
        (1, "http://a.example/x", "<p>same</p>"),
        (2, "http://a.example/y", "<p>same</p>"),
        (2, "http://a.example/y", "<p>same</p>"),
        (None, None, "<p>same</p>"),
        (3, None, None),
        (4, "not a url", ""),
        (5, "http://b.example/\r\nx", "broken <b <p class='x> text &amp; more"),
        (6, "http://b.example/", "<div>" * 5000 + "deep" + "<p>x"),
        (7, "http://b.example/", "<article>" + "<p>word &eacute;</p>" * 20_000),
    ]
    return spark.createDataFrame([(*r, 1, "h", "t") for r in rows], f"{PAGES}, n_chars long, host string, texts string")


@pytest.fixture(scope="session")
def no_pages(spark):
    return spark.createDataFrame([], PAGES)
