import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

LONG = " ".join(f"word{i % 977} tail{i}" for i in range(15000))
PASSAGE = " ".join(f"passage{i}" for i in range(60))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and very long texts, ties, repeated rows and ids, near copies, shared passages."""
    base = " ".join(f"base{i}" for i in range(120)) + "."
    near = base.replace("base60", "other")
    return [
        (1, base), (2, base), (3, near), (4, None), (5, ""), (6, "  \n\t "), (7, "one"), (8, "one"), (9, "Two Words"), (10, "two words"),
        (11, LONG), (12, LONG + " end."), (13, f"start {PASSAGE} end."), (14, f"{PASSAGE} other {PASSAGE}"), (15, "É ü ß 漢字 　  x"),
        (16, "x " * 400), (None, "a row without an id"), (None, base), (17, "repeated row of five words"), (17, "repeated row of five words"),
        (18, "same id, text A"), (18, "same id, text B"), (19, "Line one is here.\nLine one is here.\n\nlast"), (20, "\x1c\x85 odd\x0bspace\x0cwords"),
    ]


@pytest.fixture()
def frame(spark):
    """A documents table with extra columns whose names clash with the operators' own."""

    def make(rows):
        full = [(i, t, "en", "src0", None, "x", 1, 0.5) for i, t in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, kept string, n_words int, component_id double").repartition(3)

    return make
