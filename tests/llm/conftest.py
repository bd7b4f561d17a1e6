"""Small tables with every awkward case: nulls, empty and very long texts, repeats, ties, clashing names."""

import random

import pytest
from pyspark.sql import functions as F

CLASHING = ("score", "size", "tid", "th", "key", "_th", "_k", "_score", "_doc", "_spans", "spans", "host", "n_words", "_source", "target")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(seed, n, vocabulary=400):
    draw = random.Random(seed)
    return " ".join(f"w{draw.randrange(vocabulary)}x" for _ in range(n))


def edge_rows():
    base = words(1, 60)
    return [
        (1, base, "en", "a", 1), (2, base, "en", "a", 1), (2, base, "en", "a", 1), (3, base + " tail end", "en", None, 1), (4, None, None, None, None), (5, "", "en", "b", 0),
        (6, " \n\t ", "en", "b", 4), (None, "null id text " + words(2, 30), "en", "c", 1), (None, None, None, None, None), (7, words(3, 4_000, 3_000), "de", "c", 1), (8, "a b", "x", "d", 3),
        (9, "a  b", "x", "d", 4), (10, "Ünïcödé ✓ 日本語 " + words(4, 40), "x", "é", 1), (11, "z" * 5000, "x", "d", 1), (12, "no spaces" * 60, "x", "d", 1), (13, "x" + words(1, 60)[40:], "en", "a", 1),
        (14, "the idiot said worthless things " + words(5, 30), "en", "a", 1), (15, "*** ### $$$ " * 30, "en", "a", 1), (16, words(3, 4_000, 3_000)[1000:4000], "de", "c", 1),
    ]


@pytest.fixture(scope="session")
def edge_docs(spark):
    df = spark.createDataFrame(edge_rows(), SCHEMA)
    for c in CLASHING:
        df = df.withColumn(c, F.lit("own"))
    return df


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(i, i % 2, int(i == 14)) for i in range(1, 17)] + [(1, 0, 0), (None, 1, 1), (99, None, None)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int").withColumn("text", F.lit("own")).withColumn("score", F.lit(1))
