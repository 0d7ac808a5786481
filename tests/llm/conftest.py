import random

import pytest

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, score double, spans string, "
          "licences string, component_id string, place long, h long")


def prose(seed: int, n: int = 80) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghiklmnoprstu") for _ in range(r.randrange(2, 9))) for _ in range(n))


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows, names that operators use."""
    long = prose(1, 30_000)
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t ", "en", "a", 4), (4, "one", "xx", "b", 3),
            (5, "one", "xx", "b", 3), (6, long, "en", "a", len(long)), (7, long, "en", "c", len(long)),
            (8, prose(2), "de", "b", 1), (8, prose(2), "de", "b", 1), (None, prose(3), "fr", "b", 1),
            (9, "é😀 ü " * 40, "es", None, 1)]
    data = [(*r, 0.5, "x", "y", "z", 1, 2) for r in rows]
    return spark.createDataFrame(data, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def texts(spark):
    def make(values: dict[int, str | None]):
        return spark.createDataFrame(
            [(i, t, "en", "s", len(t or "")) for i, t in values.items()],
            "doc_id long, text string, lang string, source string, n_chars long")

    return make
