"""Percentile grids, threshold sweeps and window errors: rows against numpy, and no list of thresholds or cells walked row by row."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattloom.operators import evaluate as e, models as m, quantiles


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def scores(spark):
    rows = [(float(i * 7 % 101) / 4, i % 5 == 0) for i in range(400)] + [(None, True), (None, False), (25.0, True)]
    return spark.createDataFrame([(s, int(p)) for s, p in rows], "score double, label int")


@pytest.fixture
def split(spark):
    spark.conf.set("wattloom.split.bytes", "0")
    yield
    spark.conf.unset("wattloom.split.bytes")


def test_many_percentiles_of_many_rows(spark, split):
    df = scores(spark)
    ps = [j / 299 for j in range(300)]
    got = quantiles.many_percentiles(df, "score", ps)
    x = [r["score"] for r in df.collect() if r["score"] is not None]
    assert np.allclose(got.first()["q"], np.quantile(x, ps), rtol=0, atol=1e-12)
    assert "lambdafunction(((__cum" not in plan(got) and "filter(" not in plan(got)
    assert quantiles.many_percentiles(df.filter("score > 1000"), "score", ps).collect() == []


@pytest.mark.parametrize("grid", [[0.25, 3.0, 3.1, 24.75, 25.0, 99.0], [5.0], [5.0, 5.0, 5.0], [-1.0, 7.0], [2.0, None]])
def test_sweep(spark, split, grid):
    df = scores(spark)
    candidates = spark.createDataFrame([(grid,)], "c array<double>")
    out = e.sweep(df, "score", "label", candidates)
    got = {r["step"]: (r["threshold"], r["tp"], r["fp"], r["fn"], r["tn"]) for r in out.collect()}
    rows = [(r["score"], r["label"]) for r in df.collect()]
    p, n = sum(y for _, y in rows), sum(1 - y for _, y in rows)
    for i, t in enumerate(grid):
        if t is None or t in grid[i + 1:]:  # rows of equal thresholds are counted at the last one, as they reach all of them
            continue
        tp = sum(y for s, y in rows if s is not None and s >= t)
        fp = sum(1 - y for s, y in rows if s is not None and s >= t)
        assert got[i + 1] == (t, tp, fp, p - tp, n - fp)
    assert len(got) == sum(t is not None for t in grid)
    assert "filter(" not in plan(out)


def test_window_errors(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 5)) * [1, 2, 3, 4, 5] + rng.normal(size=(200, 1))
    cells, nulls = list("abcde"), rng.random((200, 5)) < 0.05
    rows = [(i, int(i % 9 == 0), *[None if nulls[i, j] else float(x[i, j]) for j in range(5)], None) for i in range(200)] + [(None, None, 1.0, 2.0, 3.0, 4.0, 5.0, None)]
    df = spark.createDataFrame(rows, "event_id long, label int, a double, b double, c double, d double, e double, f double").repartition(3)
    out = m.pca_reconstruction(df, [*cells, "f"], "label", 2)
    assert out.columns == ["event_id", "label", "recon_error"]
    assert "UDF" not in plan(out) and "aggregate(" not in plan(out)
    x = np.vstack([np.where(nulls, np.nan, x), [1.0, 2.0, 3.0, 4.0, 5.0]])
    normal = np.array([i < 200 and i % 9 != 0 for i in range(201)])
    z = np.nan_to_num((x - np.nanmean(x[normal], axis=0)) / np.nanstd(x[normal], axis=0))
    v = np.linalg.eigh(np.cov(z[normal].T))[1][:, -2:]
    want = ((z**2).sum(axis=1) - ((z @ v) ** 2).sum(axis=1)) / 6
    got = {r["event_id"]: r["recon_error"] for r in out.collect()}
    assert len(got) == 201
    assert all(abs(got[i if i < 200 else None] - want[i]) < 1e-9 for i in range(201))


@pytest.mark.parametrize("values", [[1.0], [1.0, float("nan")]])
def test_window_errors_without_a_fit(spark, values):
    df = spark.createDataFrame([(i, 0, v, 2.0 * i) for i, v in enumerate(values)], "event_id long, label int, a double, b double")
    with pytest.raises(Exception):
        m.pca_reconstruction(df, ["a", "b"], "label", 1).collect()
