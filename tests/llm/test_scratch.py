"""What the operators leave in the shared folder, and the shape of their rounds."""

import random
import re
import uuid

import pytest

from wattloom.llm import common, components, minhash, templates
from wattloom.llm.common import released, stored


@pytest.fixture()
def scratch(monkeypatch, tmp_path):
    """The names of the stored tables below a fresh shared folder."""
    monkeypatch.setattr(common, "scratch_dir", lambda spark, label: f"file://{tmp_path}/{label}-{uuid.uuid4().hex}")
    return lambda: sorted(re.sub("-[0-9a-f]{32}$", "", p.name) for p in tmp_path.iterdir())


def test_released(spark, scratch):
    df = spark.range(3)
    kept, gone = stored(df, "kept"), stored(df, "gone")
    released(gone, df, gone)
    assert scratch() == ["kept"] and kept.count() == 3


def test_components_leave_their_result_only(spark, scratch):
    path = [(i, i + 1) for i in range(40)] + [(50, 60), (60, 50), (70, 70), (None, 3)]
    got = {tuple(r) for r in components.components(spark.createDataFrame(path, "u long, v long")).collect()}
    assert got == {(i, 0) for i in range(41)} | {(50, 50), (60, 50)}
    assert scratch() == ["components"]


def test_components_of_random_graphs(spark, scratch):
    rng = random.Random(7)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(0, i) for i in range(150, 190)]
    root = list(range(200))
    for _ in range(200):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = dict(map(tuple, components.components(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert got == {n: root[n] for a, b in edges if a != b for n in (a, b)}


def test_near_duplicates_leave_their_result_only(scratch, frame, odd_rows):
    assert minhash.near_duplicates(frame(odd_rows), width=2).count() == len(odd_rows)
    assert scratch() == ["near"]


def test_line_dedup_leaves_few_tables(scratch, frame):
    own = {i: " ".join(f"{chr(97 + i)}{w}" for w in ("ein", "zwei", "drei", "vier")) for i in range(12)}
    left = templates.without_recurring(frame([(i, f"{line}.\nA line in every text stands here.") for i, line in own.items()])).collect()
    assert {r.doc_id: r.text for r in left} == {i: f"{line}." for i, line in own.items()}
    assert scratch() == ["near", "recurring_lines"]
