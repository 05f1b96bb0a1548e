"""Histogram trees against plain recursive versions, local against distributed growth, scoring against walking every tree."""

import math
import random

import numpy as np
import pytest

from wattloom.operators import models, trees


def table(rng, n, n_features=3, levels=12):
    bins = np.array([[rng.randrange(levels) for _ in range(n_features)] for _ in range(n)], np.uint8)
    label = np.array([int((b[0] > 5) ^ (b[1] > 7) or rng.random() < 0.1) for b in bins], np.int64)
    return bins, label


def all_cuts(rows, weights):
    """(feature, cut) -> weighted Gini of both sides, by trying every cut that leaves rows on both; rows are (bins, label, times)."""
    out = {}
    for f in range(3):
        for cut in sorted({b[f] for b, _, _ in rows})[:-1]:
            out[f, cut] = 0.0
            for side in (True, False):
                s = [sum(t * weights[y] for b, y, t in rows if y == k and (b[f] <= cut) == side) for k in (0, 1)]
                out[f, cut] += s[0] * s[1] / (s[0] + s[1])
    return out


def assert_best(model, rows, weights, node=0, depth=0, max_depth=None):
    """Every inner node cuts its rows as well as any cut could; leaves are pure, cannot be cut or lie at the greatest depth."""
    w = [sum(t * weights[y] for _, y, t in rows if y == k) for k in (0, 1)]
    cuts = all_cuts(rows, weights)
    assert model["value"][node] == pytest.approx(w[1] / sum(w))
    f, cut, left = (int(model[k][node]) for k in ("feature", "cut", "left"))
    if f < 0:
        assert 0 in w or not cuts or depth == max_depth
        return 1
    assert cuts[f, cut] == pytest.approx(min(cuts.values()))
    sides = ([r for r in rows if (r[0][f] <= cut) == side] for side in (True, False))
    return 1 + sum(assert_best(model, own, weights, left + k, depth + 1, max_depth) for k, own in enumerate(sides))


@pytest.mark.parametrize("seed", range(4))
def test_every_node_takes_the_best_cut(seed):
    rng = random.Random(seed)
    bins, label = table(rng, 60)
    times = np.array([rng.randrange(1, 4) for _ in label], np.int64)
    rows = [(b, y, t) for b, y, t in zip(bins.tolist(), label.tolist(), times.tolist())]
    for max_depth in (None, 0, 1, 3):
        model = trees.grow_classifier(bins, label, times, (1.0, 2.5), 3, max_depth, 1)
        assert assert_best(model, rows, (1.0, 2.5), max_depth=max_depth) == len(model["feature"])


def plain_boosting(bins, label, rounds, depth, rate, positive):
    margin = [0.0] * len(label)
    for _ in range(rounds):
        p = [1 / (1 + math.exp(-m)) for m in margin]
        w = [positive if y else 1.0 for y in label]
        g, h = [a * (b - y) for a, b, y in zip(w, p, label)], [a * b * (1 - b) for a, b in zip(w, p)]

        def grow(rows, level):
            tg, th = sum(g[i] for i in rows), sum(h[i] for i in rows)
            best = None
            if level < depth:
                for f in range(len(bins[0])):
                    for cut in sorted({bins[i][f] for i in rows}):
                        lg, lh = sum(g[i] for i in rows if bins[i][f] <= cut), sum(h[i] for i in rows if bins[i][f] <= cut)
                        if lh >= 1 and th - lh >= 1:
                            gain = lg ** 2 / (lh + 1) + (tg - lg) ** 2 / (th - lh + 1) - tg ** 2 / (th + 1)
                            if best is None or gain > best[0] + 1e-9:
                                best = (gain, f, cut)
            if best is None or best[0] <= 1e-6:
                for i in rows:
                    margin[i] -= rate * tg / (th + 1)
                return
            grow([i for i in rows if bins[i][best[1]] <= best[2]], level + 1)
            grow([i for i in rows if bins[i][best[1]] > best[2]], level + 1)

        grow(range(len(label)), 0)
    return margin


def test_boosting_equals_recursion():
    bins, label = table(random.Random(3), 90)
    settings = trees.Rounds(3, 6, 3, 0.3, 1.0, 1.0, 1.5, 1)
    model = trees.boost_arrays(settings, np.arange(90), label, bins)
    expected = plain_boosting(bins.tolist(), label.tolist(), 6, 3, 0.3, 1.5)
    assert settings.margins(model, bins, np.zeros(90)) == pytest.approx(expected, abs=1e-4)


@pytest.fixture()
def rows(spark):
    bins, label = table(random.Random(9), 400)
    return spark.createDataFrame([(i, int(y), bytearray(b.tobytes())) for i, (b, y) in enumerate(zip(bins, label))], "ident long, label int, bins binary").repartition(5), bins, label


def test_distributed_boosting_gives_the_same_trees(rows, monkeypatch):
    df, bins, label = rows
    monkeypatch.setattr(trees, "STORE_ROUNDS", 2)
    settings, local = trees.fit_boosting(df, 3, 5, 3, 0.3, 0.8, 0.7)
    _, jobs = trees.fit_boosting(df, 3, 5, 3, 0.3, 0.8, 0.7, local_rows=0)
    assert len(local) == len(jobs) == 5
    for a, b in zip(local, jobs):
        assert (a["feature"] == b["feature"]).all() and (a["cut"] == b["cut"]).all() and (a["value"] == b["value"]).all()
    scored = {r.ident: r.probability for r in trees.score_boosting(df, settings, local).collect()}
    margin = settings.margins(local, bins, np.zeros(400))
    assert [scored[i] for i in range(400)] == pytest.approx(1 / (1 + np.exp(-margin)))


@pytest.mark.parametrize("bag_rows", [1 << 20, 100])
def test_forest_and_its_scores(rows, monkeypatch, bag_rows):
    """The forest is the mean over trees grown from the bags the hash gives, however rows and trees are dealt."""
    df, bins, label = rows
    monkeypatch.setattr(trees, "PART_TREES", 3)
    monkeypatch.setattr(trees, "SLICE_ROWS", 150)
    forest = trees.fit_forest(df, 3, 7, bag_rows=bag_rows)
    pos = int(label.sum())
    weights, total = (400 / (2 * (400 - pos)), 400 / (2 * pos)), np.zeros(400)
    for t in range(7):
        times = np.searchsorted(trees.bag_cdf(min(1.0, bag_rows / 400)), trees.uniform(42, t, np.arange(400)), "right")
        assert abs(times.sum() - min(400, bag_rows)) < 100
        some = times > 0
        total += trees.walk(trees.grow_classifier(bins[some], label[some], times[some], weights, 1, None, int(trees.mixed(42, t) >> np.uint64(1))), bins).astype(np.float32)
    got = trees.score_forest(df, forest, 3, 400, 7).collect()
    assert len(got) == 400
    assert {r.ident: r.probability for r in got} == pytest.approx(dict(enumerate(total / 7)), abs=1e-6)
    # repeated rows and null ids keep a row each
    twice = df.unionByName(df.limit(1)).unionByName(df.limit(3).selectExpr("cast(null as long) AS ident", "label", "bins"))
    assert trees.score_forest(twice, forest, 3, 404, 7).count() == 404


def test_supervised_on_odd_columns(spark):
    """Missing values, constant columns, null labels and ids; both learners find the rule."""
    rng = random.Random(1)
    data = []
    for i in range(600):
        a, b = rng.gauss(0, 1), rng.gauss(0, 1)
        data.append((i if i % 50 else None, None if i % 17 == 0 else float("nan") if i % 19 == 0 else a, b, 1.0, None if i % 97 == 0 else int(a + b > 0)))
    rows = spark.createDataFrame(data, "event_id long, a double, b double, flat double, y int")
    got = models.supervised(rows, rows, ["a", "b", "flat"], "y", forest_trees=9, rounds=12, round_depth=3).toPandas()
    assert got.columns.tolist() == ["model", "event_id", "label", "probability"] and len(got) == 1200 and got.probability.between(0, 1).all()
    for _, own in got.groupby("model"):
        assert ((own.probability >= 0.5) == (own.label == 1)).mean() > 0.85
    with pytest.raises(ValueError):
        models.supervised(rows.limit(0), rows, ["a", "b"], "y")


def test_cuts_and_bins(spark):
    rows = spark.createDataFrame([(i, float(i % 1000), float(i % 3), int(i % 2)) for i in range(5000)], "event_id long, wide double, few double, y int")
    cuts = trees.quantile_cuts(rows, ["wide", "few"])
    assert 240 <= len(cuts[0]) <= 254 and cuts[1].tolist() == [0.0, 1.0, 2.0]
    found = trees.binned(rows, ["wide", "few"], cuts, "event_id", "y").collect()
    for r in found[:500]:
        assert r.bins[0] == 1 + sum(c < r.ident % 1000 for c in cuts[0]) and r.bins[1] == 1 + r.ident % 3


def test_growth_matches_all_features(spark):
    """A tree that looks at features until enough of them cut equals one that rates them all; the barrier stage equals one task."""
    rng = np.random.default_rng(8)
    bins = np.column_stack([rng.integers(0, k, 4000) for k in (1, 3, 200, 24)]).astype(np.uint8)
    label, times = (rng.random(4000) < 0.3).astype(np.int64), 1 + rng.poisson(0.5, 4000)
    for depth in (0, 3, None):
        model = trees.grow_classifier(bins, label, times, (1.0, 2.0), 4, depth, 3)
        again = trees.grow_classifier(bins, label, times, (1.0, 2.0), 1, depth, 3)
        assert (model["feature"] != 0).all() and (again["feature"] != 0).all()  # a constant feature cuts nothing
    for n_nodes in (4, 4000):  # counted in cells, and sorted
        node = rng.integers(0, n_nodes, 4000)
        one, zero = times * label, times * (1 - label)
        best, cut = trees.best_cuts(node * trees.BINS + bins[:, 2], one, zero, n_nodes, (1.0, 2.0))
        for k in np.unique(node)[:20]:
            own = node == k
            sides = [(c, [(one[own & s].sum() * 2.0, zero[own & s].sum()) for s in (bins[:, 2] <= c, bins[:, 2] > c)]) for c in np.unique(bins[own, 2])[:-1]]
            scores = [sum(a * b / (a + b) for a, b in two) for _, two in sides]
            assert best[k] == pytest.approx(min(scores)) if scores else np.isinf(best[k])
            assert not scores or scores[[c for c, _ in sides].index(cut[k])] == pytest.approx(min(scores))
    rows = spark.createDataFrame([(i, int(y), bytes(b)) for i, (y, b) in enumerate(zip(label, bins))], "ident long, label int, bins binary")
    settings = trees.Rounds(4, 5, 3, 0.1, 0.9, 0.9, 2.0, 42)
    one_task, together = trees.boost_in_task(settings, rows), trees.boost_together(settings, rows, 3)
    in_jobs = trees.boost_in_jobs(settings, rows)  # where the number of slots is not known
    for other in (together, in_jobs):
        assert len(other) == 5 and all(np.array_equal(a[k], b[k]) for a, b in zip(one_task, other) for k in a)
