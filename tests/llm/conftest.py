import random

import pytest

EDGE = "doc_id long, text string, lang string, source string, n_chars long, score string, ids string, kept string"


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls in any column, empty and very long texts, repeated rows, columns with clashing names."""
    rows = [
        (1, "The quick brown fox and the lazy dog.", "en", "a", 37, "x", "y", "z"),
        (1, "The quick brown fox and the lazy dog.", "en", "a", 37, "x", "y", "z"),
        (2, None, "en", "a", None, None, None, None),
        (3, "", None, None, 0, None, None, None),
        (None, "Der schnelle Fuchs und der faule Hund.", "de", "b", 38, None, None, None),
        (4, "123 456 !!", "de", "b", 10, None, None, None),
        (5, "wort und noch ein wort " * 8000, "de", "b", 184_000, None, None, None),
        (6, "x" * 100_000, "en", None, 100_000, None, None, None),
        (7, " \t\n ", "en", "c", 4, None, None, None),
        (8, "Über 日本 \U0001f600 é", "de", "c", 12, None, None, None),
    ]
    return spark.createDataFrame(rows, EDGE)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], EDGE)


@pytest.fixture(scope="session")
def prose():
    """Repeatable invented words by a seed."""

    def make(seed, count, alphabet="abcdefghij"):
        rng = random.Random(seed)
        return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(2, 8))) for _ in range(count)]

    return make
