import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
SENTENCE = ("the quick brown fox jumps over the lazy dog while seven wizards quietly box daft jukes and pack my bag with five dozen "
            "liquor jugs before the sphinx of black quartz judges my vow under grey skies at dawn near old stone bridges")


def rows(*texts, source="a"):
    return [(i, t, "en", source, None) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def documents(spark):
    """doc rows -> DataFrame with the columns of ``documents``."""
    return lambda data: spark.createDataFrame(data, DOCS)


@pytest.fixture(scope="session")
def awkward(documents):
    """Nulls in every column, empty and blank texts, a very long text, ties and repeated rows."""
    long_text = " ".join(f"w{i % 977}x{i % 31}y{i}" for i in range(30_000))
    data = [(1, SENTENCE, "en", "a", 5), (1, SENTENCE, "en", "a", 5), (2, None, None, None, None), (None, SENTENCE + " more", "en", "b", 1),
            (3, "", "en", "a", 0), (4, " \t\n ", "en", None, 4), (5, long_text, "en", "b", 9), (6, "one", "en", "a", 3), (7, "ONE", "en", "a", 3),
            (8, SENTENCE.upper(), "en", "c", 5), (9, SENTENCE + "\n", "en", "c", 5), (None, None, None, None, None), (10, "naïve café 日本語 😀", "fr", "a", 7)]
    return documents(data)


@pytest.fixture(scope="session")
def clashing(awkward):
    """The awkward rows with extra columns named like what the operators add."""
    names = ("size", "shard", "slot", "n_words", "kept", "keep_id", "group_size", "tx", "n", "digest", "row", "rows", "copies", "times", "nth", "component_id", "d", "t", "class", "rank", "target", "start", "ids")
    return awkward.select("*", *[F.lit(i).alias(n) for i, n in enumerate(names)])


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
