"""Small odd tables for every operator."""

import random

import pytest
from pyspark.sql import SparkSession

ROWS = [
    (1, "one two three four five six seven eight nine ten " * 8, "en", "a", 1),
    (2, "one two three four five six seven eight nine ten " * 8, "en", "a", 1),
    (3, "One  two three four five six seven eight nine ten\n" * 8, "en", None, 1),
    (4, None, None, "b", 1),
    (5, "", "de", "", 1),
    (6, " \t\n\x0b\x0c\r ", "de", "b", 1),
    (7, "x" * 200_000, None, "b", 1),
    (8, " ".join(f"w{i}" for i in range(30_000)), "en", "b", 1),
    (9, "word", "fr", "c", 1),
    (9, "word", "fr", "c", 1),
    (None, "no id here", "fr", "c", None),
    (None, "no id here", "fr", "c", None),
    (10, "\U0001f600 é ß 12 !!", "fr", "c", 1),
    (11, "<|endoftext|> # * $ % & | < >", "fr", "c", 1),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use themselves.
CLASHING = ("piece", "start", "length", "shard", "digest", "row", "size", "_doc", "_id", "family", "node", "kept")


@pytest.fixture(scope="session")
def odd(spark: SparkSession):
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    for name in CLASHING:
        df = df.withColumn(name, df["doc_id"].cast("string"))
    return df


@pytest.fixture(scope="session")
def empty(spark: SparkSession):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def near(spark: SparkSession):
    """600 random texts, each third one followed by a copy with few or no changes."""
    draw = random.Random(5)
    words = [f"{a}{b}" for a in "bdfgklmnprst" for b in ("a", "el", "io", "un", "ar")]
    rows = []
    for i in range(600):
        text = [draw.choice(words) for _ in range(draw.choice((2, 20, 80, 300)))]
        if i % 3 == 1:
            text = list(rows[-1][1].split())
            for _ in range(draw.choice((0, 1, 1, 2))):
                text[draw.randrange(len(text))] = "other"
        rows.append((i, " ".join(text), "en", f"s{i % 4}", len(text)))
    return spark.createDataFrame(rows, SCHEMA).repartition(4)
