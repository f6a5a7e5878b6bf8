"""Small tables with nulls, empty and long texts, repeated rows and columns of clashing names."""

import pytest

WORDS = "alpha bravo charlie delta echo foxtrot golf hotel india juliet kilo lima mike november oscar papa quebec romeo sierra tango uniform victor whiskey xray yankee zulu".split()


def sentence(n, step=7, at=0):
    return " ".join(WORDS[(at + i * step) % 26] + str((at * 31 + i) % 97) for i in range(n))


@pytest.fixture(scope="session")
def edge_rows():
    base = sentence(60, at=1)
    return [
        (1, base, "en", "a", 1), (2, base, "en", "a", 1), (3, base + " extra", "en", "b", 1), (4, None, None, None, None), (5, "", "en", "a", 0), (6, "  \n\t", "fr", "a", 3),
        (7, "one two", "en", "a", 7), (8, "ONE Two", "en", "a", 7), (9, sentence(4000, 3, 5), "fr", "c", 1), (10, "12 34 !!", "en", "a", 8), (None, sentence(30, at=9), "en", "a", 1),
        (7, "one two", "en", "a", 7), (11, sentence(20, at=3) + " " + sentence(50, at=17), "fr", "a", 1), (12, "xx " + sentence(50, at=17), "fr", "a", 1), (13, "é" * 300 + "日本" * 50, None, "a", 1),
    ]


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    df = spark.createDataFrame(edge_rows, "doc_id long, text string, lang string, source string, n_chars long")
    # columns whose names the operators use inside
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit(1).alias(c) for c in ("key", "id", "batch", "bucket", "cell", "h", "rank", "t", "words", "score", "spans")]).repartition(3, "doc_id", "text")


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.where("1 = 0")
