import random

import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and columns whose names the operators use themselves."""
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdeo") for _ in range(rnd.randint(1, 7)))
    long = " ".join(word() for _ in range(60_000))
    rows = [
        (1, None, "en", "s", 0), (2, "", "en", "s", 0), (3, " \t\n ", None, None, 4), (None, "no id here at all", "en", "s", 17), (None, None, None, None, None),
        (4, "one two", "en", "s", 7), (4, "one two", "en", "s", 7), (5, long, "en", "s", len(long)), (6, "x" * 200_000, "en", "s", 200_000), (7, "１２ émigré ÀÉ 日本語 ßß", "fr", "t", 20), (8, "12 34 !!", "en", "t", 8),
    ]
    rows += [(100 + i, " ".join(word() for _ in range(40)), "en", "s", 1) for i in range(20)]
    df = spark.createDataFrame(rows, DOC)
    from pyspark.sql import functions as F

    for name in ("key", "cid", "score", "kept", "row", "n_tokens", "topic", "found", "held_out", "digest"):
        df = df.withColumn(name, F.lit("clash"))
    return df.repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOC)
