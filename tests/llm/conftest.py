import pytest

ODD = [
    (1, None), (2, ""), (3, "   \n\t "), (4, "one two"), (5, "one two"), (6, "a b c d e f g h i j"), (6, "a b c d e f g h i j"), (None, "nobody owns this text at all, not even a little"),
    (7, "x" * 6000), (8, "word " * 5000), (9, "é ß 中文 \U0001f600 tab\tand\x0bvt"), (10, "One TWO three\x00nul"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty and long texts, ties, repeated rows, and extra columns whose names clash with inner ones."""
    rows = [(i, t, "s", 1.0, 2, "k") for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, score string, n double, d1 int, _gone string").repartition(3)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
