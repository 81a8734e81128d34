import pytest

SMALLEST = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"

#: Nulls, empty and repeated rows, ties, a long text, and columns named like the operators' own.
AWKWARD = [
    (1, "one two three four five six", "en", "a", 1), (1, "one two three four five six", "en", "a", 1),
    (2, "one two three four five six", None, None, None), (3, None, "en", "a", 0), (4, "", "en", "a", 0),
    (None, "one two three four five six", "en", "a", 1), (None, None, None, None, None), (5, " \t\n", "en", "b", 3),
    (6, "word " * 40_000, "en", "b", 200_000), (7, "x" * 100_000, "en", "b", 100_000),
    (8, "Ünï ©ode 漢字   it's 12³ Σ\nsame line\nsame line", "de", "b", 40),
]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SMALLEST}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet(f"{SMALLEST}/labels.parquet")


@pytest.fixture(scope="session")
def awkward(spark):
    """The awkward rows with extra columns that clash with names the operators use."""
    from pyspark.sql import functions as F

    frame = spark.createDataFrame(AWKWARD, COLUMNS)
    clash = ("row", "key", "salt", "shard", "slot", "digest", "ids", "bucket", "text_read", "row_id", "score", "n", "stat_n_words")
    return frame.withColumns({c: F.lit("extra") for c in clash})


@pytest.fixture(scope="session")
def empty(awkward):
    return awkward.limit(0)
