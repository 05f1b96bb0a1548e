"""Boosting sums one child of each pair only, in one task for tables it can hold, and tells sums in few bytes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattloom.operators import trees


def test_a_table_that_a_task_can_hold_takes_no_exchange(spark, monkeypatch):
    """530,000 rows once took a barrier exchange, a second each, for every level."""
    def refuse(*_):
        raise AssertionError("sums are exchanged")

    monkeypatch.setattr(trees, "boost_together", refuse)
    monkeypatch.setattr(trees, "boost_in_jobs", refuse)
    rows = spark.range(530_000).select(F.col("id").alias("ident"), (F.col("id") % 3 == 0).cast("int").alias("label"), F.when(F.col("id") % 3 == 0, F.lit(bytearray([1]))).otherwise(F.lit(bytearray([2]))).alias("bins"))
    settings, model = trees.fit_boosting(rows, 1, 2, 2, 0.5)
    assert len(model) == 2 and all(m["feature"][0] == 0 and m["cut"][0] == 1 for m in model)
    assert settings.margins(model, np.array([[1], [2]], np.uint8), np.zeros(2)) == pytest.approx([1.684, -1.684], abs=0.01)


def test_sums_of_one_child_give_those_of_both(monkeypatch):
    rng = np.random.default_rng(6)
    bins, ident = rng.integers(0, 60, (5000, 5)).astype(np.uint8), np.arange(5000)
    label = ((bins[:, 0] > 30) ^ (bins[:, 2] > 20) ^ (rng.random(5000) < 0.1)).astype(np.int32)
    settings, asked = trees.Rounds(5, 3, 4, 0.3, 0.8, 0.8, 1.5, 9), []
    monkeypatch.setattr(trees, "BOOST_CHUNK", 700)
    whole = trees.Rounds.with_siblings

    def checked(self, part, wanted, above, level):
        out = whole(self, part, wanted, above, level)
        asked.append(len(wanted))
        for child in wanted - ((1 << level) - 1):
            assert (out[child] + out[child ^ 1] == above[child >> 1]).all()
            assert out[child, 0, :, 1].sum() <= out[child ^ 1, 0, :, 1].sum()
        return out

    monkeypatch.setattr(trees.Rounds, "with_siblings", checked)
    model = trees.boost_arrays(settings, ident, label, bins)
    assert asked and max(asked) <= 4
    # the values of a tree's nodes from the rows themselves
    g, h = settings.gradients(np.zeros(5000), label, ident, 0)
    at = settings.nodes(model[0], bins, 4)
    for node in np.unique(at):
        own = at == node
        assert model[0]["value"][node] == pytest.approx(-0.3 * g[own].sum() / (h[own].sum() + trees.UNIT))
    assert (model[0]["feature"] >= 0).sum() > 4 and set(model[0]["feature"]) <= {-1, *settings.columns(0)}


@pytest.mark.parametrize("most", [0, 1, 127, 128, -128, -129, 1 << 38, -(1 << 55), (1 << 62) + 5])
def test_sums_are_told_whole(most):
    sums = np.array([[most, 0, -1], [min(most, 3), 1 - (most > 200), -min(abs(most), 100)]], np.int64)
    text = trees.shortened(sums)
    assert (trees.short_numbers(text) == sums.ravel()).all()
    assert abs(most) > 1 << 40 or len(text) < 1 + 6 * 8 * 4 / 3
