from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# Names the operators use inside; a table may have them too.
CLASHING = (
    "node group block label n size key slice target slot leaf part vec rank score order held_out bucket kind "
    "shingle place words queued source_no turn finish step data guest ids bytes kept spans row_key lang_pred"
).split()


def _text(draw: random.Random, n: int) -> str:
    return " ".join("".join(draw.choices("abcdefgh", k=draw.randint(2, 7))) for _ in range(n))


def awkward_rows() -> list[tuple]:
    """Nulls in any column, empty and long texts, copies, near copies, shared passages, odd characters."""
    draw = random.Random(4)
    base = _text(draw, 120)
    passage = _text(draw, 60)
    words = base.split()
    rows = [
        (0, base, "en", "a", 1), (1, base, "en", "a", 1), (2, base.upper(), "en", "b", 1),
        (3, None, "en", "a", None), (4, "", None, None, 0), (5, " \t\n\x0b ", "fr", "b", 5),
        (None, "no id " + passage, "en", "a", 9), (None, None, None, None, None),
        (6, "one", "en", None, 3), (7, "one", "en", "c", 3), (8, "two words", "de", "c", 9),
        (9, "one two three four five", "de", "c", 1), (9, "one two three four five", "de", "c", 1),
        (10, "Released under the MIT License. " + passage, "en", "a", 1),
        (11, "x " + passage + " é ü 漢字 😀 " + passage, "es", "b", 1),
        (12, "Apache License, Version 2.0; cc by-nc; Apache license version 2", "en", "a", 1),
        (13, "12345 !!! ...", "en", "a", 1), (14, "a " * 400, "en", "d", 800), (15, "é" * 300, "fr", "d", 300),
        (16, _text(draw, 20_000), "en", "a", 1), (17, "w" * 60_000, "en", "d", 60_000),
        (18, "\x00\x01 don't   stop\r\n\r\n  now 's", "en", "d", 9),
    ]
    for i in range(20, 60):  # near copies, each with a word or three of its own
        copy = list(words)
        for at in draw.sample(range(len(copy)), draw.randint(1, 3)):
            copy[at] = _text(draw, 1)
        rows.append((i, " ".join(copy), "en", "a", 1))
    rows += [(i, _text(draw, 40) + " " + passage, "fr", "b", 1) for i in range(60, 75)]
    return rows


@pytest.fixture(scope="session")
def awkward(spark):
    docs = spark.createDataFrame(awkward_rows(), SCHEMA).repartition(5)
    return docs.withColumns({c: F.lit("other") for c in CLASHING})


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def sample(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(params=["awkward", "sample"])
def docs(request):
    return request.getfixturevalue(request.param)


@pytest.fixture
def pairs():
    """(doc_id, text) of a table's rows."""
    return lambda df: [tuple(r) for r in df.select("doc_id", "text").collect()]


@pytest.fixture
def same():
    """Whether two lists hold the same rows, however ordered."""
    return lambda a, b: sorted(map(tuple, a), key=repr) == sorted(map(tuple, b), key=repr)
