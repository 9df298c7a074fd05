from __future__ import annotations

import random

import pytest

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ["tie", "node", "shard", "key", "row", "chunk", "_p", "_topic", "_hit_id", "_gone", "copies", "words", "h", "len", "bytes", "id"]


def words(seed: int, n: int, vocabulary: int = 400) -> str:
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


def odd_documents() -> list[tuple]:
    """Nulls in every column, empty and very long texts, ties, repeated rows, near copies, shared passages."""
    base, passage = words(1, 120), words(2, 60)
    rows = [
        (1, base, "en", "a", 10),
        (2, base, "en", "b", 10),
        (3, base + " changed", "de", "a", None),
        (4, words(3, 30) + " " + passage + " " + words(4, 30), "fr", None, 5),
        (5, words(5, 30) + " " + passage.upper() + "\n" + passage, None, "c", 5),
        (6, "", "en", "a", 0),
        (7, None, "en", "a", None),
        (8, " \t\n\x0b\x0c\r ", "es", "b", 7),
        (9, "one", "en", "a", 3),
        (10, "one two", "en", "a", 7),
        (11, "One TWO", "en", "a", 7),
        (12, words(6, 6000, 5000), "en", "a", 1),
        (13, "ünïcode\u2003Wörter 漢字 🎉 É é " + base, "de", "b", 9),
        (14, "..., --- !!!", "en", "a", 12),
        (15, base, "en", "a", 10),
        (15, base, "en", "a", 10),
        (16, "x " * 200, "en", "a", 400),
        (-5, words(7, 80), "en", "a", 10),
        (None, words(8, 70), "en", "a", 10),
        (None, None, None, None, None),
    ]
    return rows + [(100 + i, words(1000 + i, 20 + i), "en" if i % 3 else "de", f"s{i % 4}", i) for i in range(40)]


@pytest.fixture(scope="session")
def docs(spark):
    df = spark.createDataFrame(odd_documents(), DOC_SCHEMA)
    for c in CLASHES:
        from pyspark.sql import functions as F

        df = df.withColumn(c, F.lit(f"extra {c}"))
    return df.repartition(3).cache()


@pytest.fixture(scope="session")
def rows():
    return odd_documents()


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)
