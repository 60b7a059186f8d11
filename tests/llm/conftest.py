import pytest

#: Every operator must take these: nulls, empty and long texts, ties, repeated rows, clashing columns.
AWKWARD = [
    (1, "plain words here", "a", 1.0, 7),
    (2, None, "b", 2.0, 7),
    (3, "", None, None, None),
    (None, "plain words here", "c", 3.0, 7),
    (4, "plain words here", "a", 1.0, 7),
    (4, "plain words here", "a", 1.0, 7),
    (5, " \t\n ", "a", 1.0, 7),
    (6, "lang é ß 中文 İ \x1c x y <|endoftext|> don't!", "a", 1.0, 7),
    (7, "many words of one long text " * 3000, "a", 1.0, 7),
    (8, "x" * 30_000, "a", 1.0, 7),
    (4, "another text under an id", "z", 9.0, 1),
]
DDL = "doc_id long, text string, found string, score double, n int"


@pytest.fixture(scope="session")
def awkward(spark):
    return spark.createDataFrame(AWKWARD, DDL).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DDL)


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
