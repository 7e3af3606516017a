from __future__ import annotations

import pytest

SF = "/root/testdata/sf0.001"
ODD = [
    (1, "the cat sat on the mat and the dog ran off to the old red barn", "en", "a", 10),
    (2, "the cat sat on the mat and the dog ran off to the old red barn", "en", "a", 10),
    (2, "the cat sat on the mat and the dog ran off to the old red barn", "en", "a", 10),
    (3, "", None, None, None),
    (4, None, None, "b", None),
    (None, "one", "en", "b", 3),
    (5, "é ß ﷺ\u3000x\x1cy <|endoftext|> it's '' 12 …", "de", "b", 3),
    (6, "word " * 3000, "en", "a", 3),
    (7, " \n\t ", "en", "c", 3),
    (8, "x" * 5000, "en", "c", 3),
]


@pytest.fixture(scope="session")
def docs(spark):
    """The small documents and awkward ones, with an extra column of a clashing name."""
    small = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame(ODD, small.schema)
    return small.unionByName(odd)


@pytest.fixture(scope="session")
def rows(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)


@pytest.fixture(scope="session")
def vocabulary():
    from tidemark.llm.queries import word_vocabulary

    return word_vocabulary()
