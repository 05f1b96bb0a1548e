"""Every tree's bag is drawn from all rows, with as many draws; bags in files and small chunks give the same trees."""

import inspect

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattloom.operators import models, trees


def test_a_bag_has_as_many_draws_as_a_large_table_has_rows(spark):
    """More rows than the 1,048,576 draws a bag once had: the root's share is that of the whole bag."""
    n = 1_200_000
    rows = spark.range(n).select(F.col("id").alias("ident"), (F.col("id") % 5 == 0).cast("int").alias("label"), F.lit(bytearray([1])).alias("bins"))
    label = np.arange(n) % 5 == 0
    for r in trees.fit_forest(rows, 1, 2, max_depth=0).collect():
        times = np.searchsorted(trees.bag_cdf(1.0), trees.uniform(42, r.tree, np.arange(n)), "right")
        assert abs(times.sum() - n) < 0.005 * n
        one, zero = times[label].sum() * n / (2 * label.sum()), times[~label].sum() * n / (2 * (~label).sum())
        assert np.frombuffer(r.value, np.float32)[0] == pytest.approx(one / (one + zero), abs=2e-7)
    assert "bag_rows" not in inspect.signature(models.supervised).parameters
    assert inspect.signature(trees.fit_forest).parameters["bag_rows"].default is None


@pytest.mark.parametrize("n_features", [3, 9])
def test_bags_in_files_give_the_same_tree(monkeypatch, n_features):
    rng = np.random.default_rng(n_features)
    bins = rng.integers(0, 40, (3000, n_features)).astype(np.uint8)
    bins[:, 1] = 7  # cuts nothing
    label, times = (rng.random(3000) < 0.3).astype(np.int64), 1 + rng.poisson(0.5, 3000)
    grown = {depth: trees.grow_classifier(bins, label, times, (1.0, 2.0), 2, depth, 5) for depth in (None, 0, 1, 6)}
    assert len(grown[0]["feature"]) == 1 and len(grown[1]["feature"]) == 3 and (grown[None]["feature"] != 1).all()
    monkeypatch.setattr(trees, "CHUNK_ROWS", 64)
    monkeypatch.setattr(trees, "HELD_BYTES", 500)
    packed, bag = trees.packed_rows(times * 2 + label, bins), trees.Bag()
    for a in range(0, 3000, 70):
        bag.add(packed[a: a + 70].tobytes())
    assert bag.file is not None and np.array_equal(bag.rows(trees.row_words(n_features)), packed)
    for depth, expected in grown.items():
        rows = bag.rows(trees.row_words(n_features)) if depth == 6 else packed.copy()
        again = trees.grow_packed(rows, n_features, (1.0, 2.0), 2, depth, 5)
        assert all(np.array_equal(expected[k], again[k]) for k in expected)
    values = trees.walk(grown[None], bins)
    at = 17  # by hand
    node = 0
    while grown[None]["feature"][node] >= 0:
        node = grown[None]["left"][node] + (bins[at, grown[None]["feature"][node]] > grown[None]["cut"][node])
    assert values[at] == grown[None]["value"][node]


def test_trees_in_pieces_score_all_rows(spark, monkeypatch):
    rng = np.random.default_rng(2)
    bins, label = rng.integers(0, 30, (500, 4)).astype(np.uint8), (rng.random(500) < 0.4).astype(np.int64)
    data = [(i if i % 9 else None, int(y), bytearray(b.tobytes())) for i, (y, b) in enumerate(zip(label, bins))]
    rows = spark.createDataFrame(data, "ident long, label int, bins binary").repartition(3)
    whole = trees.score_forest(rows, trees.fit_forest(rows, 4, 5), 4, 500, 5).collect()
    for name, value in (("PIECE_NODES", 7), ("PART_TREES", 2), ("SLICE_ROWS", 90)):
        monkeypatch.setattr(trees, name, value)
    forest = trees.fit_forest(rows, 4, 5)
    assert forest.count() > 5
    pieces = trees.score_forest(rows, forest, 4, 500, 5).collect()
    key = lambda r: (r.ident is None, r.ident or 0, r.label, bytes(r.bins))
    assert sorted(map(key, pieces)) == sorted((d[0] is None, d[0] or 0, d[1], bytes(d[2])) for d in data)
    assert [r.probability for r in sorted(pieces, key=key)] == pytest.approx([r.probability for r in sorted(whole, key=key)], abs=1e-12)
