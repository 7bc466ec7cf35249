import pytest

#: Nulls, empty and repeated rows, ties, a long text, and columns whose names the operators use themselves.
ROWS = [
    (1, "one two three four five six seven eight nine ten eleven", "en"),
    (1, "one two three four five six seven eight nine ten eleven", "en"),
    (2, "One, two; three four five six seven eight nine ten eleven!", None),
    (3, None, "de"),
    (4, "", None),
    (None, "one two three four five six seven eight nine ten eleven", "fr"),
    (None, None, None),
    (5, "\n \t ", "en"),
    (6, "ab", "en"),
    (7, "word " * 30_000 + "x" * 100_000 + " größe 😀", "de"),
]
CLASH = "n int, y int, p int, q int, comp int, band int, _t string, _base string, _spans string, row int, words int, terms int, counts int, count int, shard int, size int, _gone int, seen int, kept boolean"


@pytest.fixture(scope="session")
def odd(spark):
    n = len(CLASH.split(", "))
    return spark.createDataFrame([(*r, *[None] * n) for r in ROWS], f"doc_id int, text string, lang string, {CLASH}")


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
