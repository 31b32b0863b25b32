import pytest
from pyspark.sql import types as T

DOCUMENTS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        T.StructField("h", T.StringType()),  # columns whose names the operators use as well
        T.StructField("n_words", T.LongType()),
        T.StructField("kept", T.StringType()),
    ]
)


def prose(seed: int, n: int) -> str:
    x, out = seed * 7919 + 1, []
    for _ in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        out.append("w%x" % (x >> 12))
    return " ".join(out)


def odd_texts() -> list[tuple]:
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows, letters beyond Latin."""
    long = prose(5, 30_000)
    return [
        (1, prose(1, 60), "en", "a", 1, "x", 1, "x"),
        (2, prose(1, 60), "en", "a", 1, "x", 1, "x"),
        (3, prose(2, 30) + "\n" + prose(1, 60) + "  \t" + prose(3, 10), None, "a", 1, None, None, None),
        (4, None, "en", None, None, "x", 1, "x"),
        (5, "", "en", "a", 0, "x", 1, "x"),
        (6, " \n\t ", "en", "a", 4, "x", 1, "x"),
        (7, "again and " * 400, "en", "b", 1, "x", 1, "x"),
        (8, long, "en", "b", 1, "x", 1, "x"),
        (9, prose(6, 100) + " " + long[:9000], "de", "b", 1, "x", 1, "x"),
        (10, "ÄÖÜ ΣΑΣ 漢字 👍🏽 naïve <|endoftext|> it's 42!!", "de", "b", 1, "x", 1, "x"),
        (11, prose(7, 50), "en", "a", 1, "x", 1, "x"),
        (11, prose(7, 50), "en", "a", 1, "x", 1, "x"),
        (12, prose(8, 50), "en", "a", 1, "x", 1, "x"),
        (12, prose(9, 50), "en", "a", 1, "x", 1, "x"),
        (None, prose(10, 50), "en", "a", 1, "x", 1, "x"),
        (None, None, None, None, None, None, None, None),
        (13, 'see token = "0123456789abcdef0123456789abcdef01234567" there', "en", "a", 1, "x", 1, "x"),
        (14, "one two three", "en", "a", 1, "x", 1, "x"),
    ]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_texts(), DOCUMENTS).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCUMENTS)
