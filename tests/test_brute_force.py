"""Queries without a SQL twin against a plain Python rerun on the small tables."""

from collections import defaultdict, deque

import numpy as np

import __spark_entry__ as entry
from wattloom.operators import evaluate as e, models as m
from wattloom.sources.readings import Tables

QUERIES = entry.queries()


def in_time(df, *cols):
    pdf = df.select("event_id", "ts", *cols).toPandas()
    return pdf.sort_values(["ts", "event_id"])


def test_adaptive_threshold(spark, folder):
    rows, known, want = in_time(Tables(spark, folder).scored, "meter_id", "score"), defaultdict(lambda: deque(maxlen=500)), {}
    for r in rows.itertuples():
        h = known[r.meter_id]
        thr = 0.9 if len(h) < 30 else np.mean(h) + 3 * np.std(h)
        want[r.event_id] = (thr, r.score >= thr)
        if r.score < thr:
            h.append(r.score)
    for name in ("adaptive_threshold", "stream_adaptive_threshold"):
        got = QUERIES[name](spark, folder).toPandas().set_index("event_id")
        assert len(got) == len(want)
        for k, (thr, hit) in want.items():
            assert abs(got.at[k, "threshold"] - thr) < 1e-6 and bool(got.at[k, "is_anomaly"]) == hit


def test_rate_limit(spark, folder):
    rows, hits, want = in_time(Tables(spark, folder).events, "user_id"), defaultdict(deque), {}
    for r in rows.itertuples():
        h, now = hits[r.user_id], r.ts.value // 1000
        while h and now - h[0] > 86_400_000_000:
            h.popleft()
        want[r.event_id] = len(h) < 3
        if want[r.event_id]:
            h.append(now)
    got = QUERIES["rate_limit_exact"](spark, folder).toPandas()
    assert dict(zip(got["event_id"], got["allowed"])) == want


def test_isotonic_is_monotone(spark, folder):
    got = QUERIES["isotonic_fit"](spark, folder).toPandas().sort_values("score")
    assert got["probability"].is_monotonic_increasing and got["probability"].between(0, 1).all()


def test_platt_slopes_up_and_calibrates(spark, folder):
    t = Tables(spark, folder)
    got = m.platt_fit(t.scored, "score", "label", log=False).first()
    assert got["a"] > 0
    probs = t.scored.withColumn("p", e.platt(t.scored["score"], got["a"], got["b"]))
    assert e.calibration_error(probs, [], "p", "label").first()["ece"] < 0.1


def test_bootstrap_brackets_the_point(spark, folder):
    got = QUERIES["bootstrap_ci"](spark, folder).toPandas()
    assert ((got["lo"] <= got["point"]) & (got["point"] <= got["hi"])).all() and len(got) == len(e.METRICS)


def test_forest_prefers_outliers():
    x = np.random.default_rng(0).normal(size=(256, 2))
    trees = [m.grow_tree(x, np.random.default_rng(i)) for i in range(50)]
    forest = [tuple(np.array(t[k]) for k in ("feature", "threshold", "left", "right", "depth")) for t in trees]
    inner, outer = m.path_lengths(np.array([[0.0, 0.0], [8.0, 8.0]]), forest)
    assert outer < inner


def test_pca_error_is_small_for_what_it_can_express(spark):
    rows = [(i, float(i % 7), 2.0 * (i % 7), 0) for i in range(50)] + [(99, 3.0, -6.0, 1)]
    df = spark.createDataFrame(rows, "event_id long, a double, b double, label int")
    got = {r["event_id"]: r["recon_error"] for r in m.pca_reconstruction(df, ["a", "b"], "label", 1).collect()}
    assert max(v for k, v in got.items() if k != 99) < 1e-9 < got[99]


def test_permutation_keeps_the_values(spark, folder):
    df = Tables(spark, folder).readings.select("event_id", "tension_v")
    got = e.permute_column(df, "tension_v", "event_id", 3).toPandas()
    base = df.toPandas()
    assert np.allclose(sorted(got["tension_v"]), sorted(base["tension_v"]))
    assert (got.sort_values("event_id")["tension_v"].to_numpy() != base.sort_values("event_id")["tension_v"].to_numpy()).any()
