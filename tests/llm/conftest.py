import random

import pytest

LONG = "lorem ipsum dolor sit amet " * 8000


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls everywhere, empty and long texts, repeated rows, and columns named like results."""
    rows = [
        (1, None, "en", "src1", 0), (2, "", "de", None, 0), (3, " \n\t", None, "src3", 3), (4, LONG, "en", "x", len(LONG)), (None, "plain words here and there", "en", "src5", 26),
        (6, "one", None, None, 3), (7, "same text twice, the same text twice over and over", "en", "src7", 9), (7, "same text twice, the same text twice over and over", "en", "src7", 9),
        (8, "1234 ### !!! 99", "en", "src2", 15), (9, "ÄÖ 漢字 😀 é", "de", "src9999999999", 9),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("score", "predicted", "labels", "n_words", "row_key", "kind", "class", "component_id", "spans", "host", "domain", "language", "epoch", "key", "accepted", "lang_pred", "place", "item_id", "row_file", "row_index"):
        docs = docs.selectExpr("*", f"'clash' as {name}")
    return docs


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture
def rng():
    return random.Random(5)
