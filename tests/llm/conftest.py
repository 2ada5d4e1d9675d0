import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))

VOCABULARY = "alpha beta gamma delta the of and idiot river stone Cloud ÉTÉ naïve x1 licence".split()


@pytest.fixture(scope="session")
def odd_rows():
    """Documents with nulls, empty and very long texts, ties, repeated rows."""
    rng = random.Random(7)

    def text(n):
        return " ".join(rng.choice(VOCABULARY) + str(rng.randrange(40)) for _ in range(n))

    passage = text(60)
    rows = [
        (1, text(30), "a"),
        (2, None, "a"),
        (3, "", None),
        (4, "  \t\n ", "b"),
        (5, passage, "b"),
        (6, text(20) + " " + passage + " " + text(10), "b"),
        (7, passage, "c"),
        (7, passage, "c"),  # a repeated row
        (8, text(3), "c"),
        (9, "one", None),
        (None, text(80), "a"),
        (11, text(6000) + "\n" + passage, "a"),  # very long
        (12, "MIT   License!\nthe apache LICENSE, and the General-Public_License", "b"),
        (13, "w" * 70000 + " end", "a"),  # one very long word
        (14, "w" * 70000 + " end", "c"),
        (15, "Released under teh MIT licence today", "d"),
        (-3, passage.upper(), "d"),
    ]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """The same with columns whose names the operators use inside."""
    rows = [(d, t, "xx", s, None, "clash", 1.5, 7) for d, t, s in odd_rows]
    names = "doc_id long, text string, lang string, source string, n_chars long, id string, score double, row int"
    return spark.createDataFrame(rows, names).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
