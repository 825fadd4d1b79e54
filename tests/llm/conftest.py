import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, digest int"
PAGES = "page_id long, url string, html string, text string"


@pytest.fixture
def documents(spark):
    """Rows to a table of documents with columns whose names operators use inside."""

    def make(rows):
        full = [
            (i, t, lang, "s", None if t is None else len(t), "x", 1)
            for i, t, lang in ((*r, None)[:3] for r in rows)
        ]
        return spark.createDataFrame(full, DOCS)

    return make


@pytest.fixture
def pages(spark):
    return lambda rows: spark.createDataFrame([(i, u, h, "x") for i, u, h in rows], PAGES)


LONG = "word " * 30_000 + "z" * 5_000
AWKWARD = [
    (None, "no id here at all today"),
    (None, None),
    (1, None),
    (2, ""),
    (3, " \n\t "),
    (4, "a"),
    (5, "same text on two rows with one id"),
    (5, "same text on two rows with one id"),
    (6, "12 34 ... !!"),
    (7, LONG),
    (8, "naïve 日本語 😀 ▁ text\r\nwith\x0bmany kinds"),
]


@pytest.fixture
def awkward(documents):
    return documents(AWKWARD)
