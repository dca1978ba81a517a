import os

import pytest

from tablecraft.llm.shipping import ship_package

SMALL = "/root/testdata/sf0.001"
SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    # names that operators might use inside
    "size long, count long, fp long, cell long, length long, piece int, copies int, "
    "root long, h long, line string, word string, kept boolean, score double, url string, page_id long"
)
LONG = "Alpha beta gamma delta " * 30_000
TEXTS = [
    (1, "The cat sat on the mat and looked at the dog.", "en", "a"),
    (2, "The cat sat on the mat and looked at the dog.", "en", "b"),
    (2, "The cat sat on the mat and looked at the dog.", "en", "b"),
    (3, None, "en", None),
    (4, "", None, "a"),
    (5, " \t\n\x0b ", "de", "c"),
    (None, "Zwei Wörter", "de", "c"),
    (None, None, None, None),
    (6, LONG, "en", "a"),
    (7, "x", None, "é"),
    (8, "42 %%% $$$ 1.5 | <b>     é \U0001f600 \x00", "fr", "a"),
    (9, "line one\nline one\n\nline two\nline one", "en", "c"),
    (11, "a\x1cb \x1f c\x85d\xa0e\u3000f \x1d\x1d", "en", "c"),
    (10, "don't it's WE'LL <|endoftext|> thnd$$$ don't!!", "en", "c"),
]


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    ship_package(spark)


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls, empty and long texts, ties, repeated rows, names that may clash."""
    width = len(SCHEMA.split(",")) - 5
    rows = [
        (i, text, lang, source, len(text or ""), *[None] * width)
        for i, text, lang, source in TEXTS
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small():
    if not os.path.isdir(SMALL):
        pytest.skip("test tables not present")
    return SMALL
