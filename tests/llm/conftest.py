import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

WORDS = [f"w{i}" for i in range(400)]


def _text(start: int, n: int, step: int = 1) -> str:
    return " ".join(WORDS[(start + i * step) % len(WORDS)] + str(i // 400) for i in range(n))


LONG = _text(0, 60)
ROWS = [
    (1, LONG, "en", "b"),
    (2, LONG, "en", "b"),  # exact copy
    (3, LONG.replace("w300", "x"), "en", None),  # near copy
    (4, None, None, None),
    (5, "", "en", "a"),
    (6, "Few words", "en", "a"),
    (6, "few  words", "en", "a"),  # a repeated id
    (7, "Line of five words here\n" * 12, "en", "a"),
    (8, _text(7, 4000, 3) + " " + LONG, "en", "b"),  # very long, with a shared passage
    (9, "a" * 1000 + "é" + "a" * 500, "fr", "c"),  # one byte over and over
    (10, "\t\n \x0b\x0c\r", "en", "c"),
    (11, "mail bob.smith@mail5.example.com or 1.2.3.4.5 and 4111 1111-1111 1111, +1 (743) 555-3824 .", "en", "c"),
    (12, "a@b.c_d@e.f x@y 999.1.1.1 10.0.0.255 4111111111111112 +12 +1234567890123456", "en", "c"),
    (None, LONG, "en", "c"),
    (13, _text(100, 30) + " | 中文 ÀÉ " + _text(100, 30), "en", "a"),
    (2, LONG, "en", "b"),  # a repeated row
]
ITEMS = [("i1", _text(20, 20)), ("i2", "few words"), ("i3", None), ("i4", ""), ("i5", _text(20, 20)), ("i6", _text(35, 6)), ("i7", _text(9, 3))]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="session")
def docs(spark):
    # Columns with the names that operators use themselves.
    from pyspark.sql import functions as F

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    rows = spark.createDataFrame(ROWS, SCHEMA)
    rows = rows.select("*", F.lit(1).alias("part"), F.lit("x").alias("key"), F.lit(0.5).alias("size"), F.lit(2).alias("bucket"))
    own = ["_id", "_p", "_part", "_one", "_place", "_spans", "_words", "_copies", "_key", "_size"]
    return rows.select("*", *[F.lit(f"own{name}").alias(name) for name in own]).repartition(3)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)


@pytest.fixture(scope="session")
def items(spark):
    return spark.createDataFrame(ITEMS, "item_id string, text string")
