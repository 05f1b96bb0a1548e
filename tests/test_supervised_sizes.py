"""The supervised learners grow to the reference's sizes unless told otherwise."""

import inspect

from wattloom.operators import models


def test_sizes_are_arguments_with_the_reference_values():
    given = {k: p.default for k, p in inspect.signature(models.supervised).parameters.items()}
    assert (given["forest_trees"], given["forest_depth"], given["rounds"], given["round_depth"], given["rate"], given["sample"]) == (200, None, 300, 6, 0.1, 0.9)


def test_both_learners_fit(spark):
    rows = spark.createDataFrame([(i, float(i % 7), float(i % 5), int(i % 7 > 3)) for i in range(60)], "event_id long, a double, b double, y int")
    got = models.supervised(rows, rows, ["a", "b"], "y", forest_trees=3, forest_depth=4, rounds=2, round_depth=2).collect()
    assert len(got) == 120 and all(0 <= r.probability <= 1 for r in got)
