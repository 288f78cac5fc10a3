from __future__ import annotations

import pytest

from tabloom.llm.storage import ship_package

ROWS = [
    (1, "The same text, twice over.\nA second line of it.", "en", "src0"),
    (2, "The same text, twice over.\nA second line of it.", "en", "src1"),
    (3, None, "en", "src0"),
    (4, "", "fr", None),
    (None, "A row without an id: call +1 (743) 555-3824.", None, "src0"),
    (5, "word " * 30_000, "en", "src0"),
    (6, "Ünïcödé ŧext … 漢字 and 😀 emoji", "de", "src2"),
    (7, " \n\t ", "de", "src2"),
    (8, "repeated row", "en", "src0"),
    (8, "repeated row", "en", "src0"),
    (9, "x", "en", "src0"),
]
#: Columns of other tables that clash with names the operators use inside or return.
CLASHES = ("keep_id", "size", "h", "label", "row", "window", "chunks", "key", "body", "tokens")


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    ship_package(spark)


@pytest.fixture(scope="session")
def odd_rows():
    return ROWS


@pytest.fixture(scope="session")
def odd_docs(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string")
    for i, name in enumerate(CLASHES):
        docs = docs.selectExpr("*", f"{i} AS {name}")
    return docs


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")
