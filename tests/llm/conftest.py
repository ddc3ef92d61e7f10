import os

import pytest

DATA = os.environ.get("TESTDATA", "/root/testdata/sf0.001")


@pytest.fixture
def sf_dir():
    if not os.path.isdir(DATA):
        pytest.skip("the given tables are not here")
    return DATA


#: Documents with all that is awkward: nulls, empty and white texts, repeats, a long text, control strings.
ROWS = [
    (0, "one two three four five six seven eight nine ten", "en", "a"),
    (1, "ONE two three four five six seven eight nine ten", "en", "b"),
    (2, None, None, None),
    (3, "", "en", "a"),
    (4, " \n\t ", "en", "b"),
    (5, "short", None, "é"),
    (5, "short", None, "é"),
    (None, "without a number", "fr", "a"),
    (6, "Größe ✓ \\### <|endoftext|> </s> " + "x" * 300, "de", "b"),
    (7, "word " * 4000, "en", "a"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture
def docs(spark):
    """The awkward rows, with further columns under names that operators use inside."""
    from pyspark.sql import functions as F

    more = {c: F.lit("other") for c in ("size", "place", "shard", "ids", "n", "uid", "score", "key", "bucket", "token", "value")}
    return spark.createDataFrame(ROWS, SCHEMA).withColumns(more).repartition(3)


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
