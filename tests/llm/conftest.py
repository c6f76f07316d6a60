import pytest
from pyspark.sql import functions as F

#: Names that operators use inside or return.
CLASHES = ["row_id", "sid", "n", "tokens", "prefix", "perplexity", "kept", "total", "low", "score", "start", "kept_text", "n_bytes", "_spans", "component_id"]


@pytest.fixture(scope="session")
def rough(spark):
    """Documents with nulls in every column, empty and long texts, repeats, ties and clashing column names."""
    long = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
    prose = "the quick brown fox jumps over the lazy dog and runs away from all of the hounds that follow it today"
    rows = [(1, prose, "en", "s", 9), (2, prose, "en", "s", 9), (2, prose, "en", "s", 9), (3, None, "en", None, None), (4, "", None, "s", 0), (None, prose, "en", "s", 1), (5, long, None, "s", 1), (6, "one two", "en", "s", 1), (7, "one two", "en", "s", 1), (8, " \t\n ", "en", "s", 1), (9, long + " end", "xx", "s", 1), (10, prose.upper(), "en", "s", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    path = _stored(spark, df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASHES)]))
    return path


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 1, 0), (5, 1, 1), (None, 1, 1), (6, None, None), (1, 1, 0), (10, 0, 1)], "doc_id long, quality int, toxic int")


def _stored(spark, df):
    from skeinwork.llm import common

    return common.cut(df, "fixture")


@pytest.fixture
def nothing(rough):
    return rough.limit(0)
