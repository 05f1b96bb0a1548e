"""Fits and scores that are dealt over tasks: isotonic hulls, forests of many segments, bootstrap areas, request budgets."""

import random
from collections import defaultdict, deque

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F


from wattloom.operators import detect, evaluate, models
from wattloom.streaming import sources as s, stateful as st


def pooled(pairs):
    """Distinct scores with their isotonic means, by pooling neighbours."""
    by = defaultdict(lambda: [0, 0])
    for x, y in pairs:
        by[x][0] += y
        by[x][1] += 1
    blocks = []
    for x in sorted(by):
        blocks.append([*by[x], [x]])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            pos, n, xs = blocks.pop()
            blocks[-1] = [blocks[-1][0] + pos, blocks[-1][1] + n, blocks[-1][2] + xs]
    return {x: pos / n for pos, n, xs in blocks for x in xs}


@pytest.mark.parametrize("rows", [1 << 16, 40, 3])
@pytest.mark.parametrize("shape", ["noise", "rising", "falling", "convex"])
def test_isotonic_fit(spark, monkeypatch, rows, shape):
    monkeypatch.setattr(models, "HULL_ROWS", rows)
    rng = random.Random(rows)
    if shape == "convex":  # no point falls away
        pairs = [(k / 60, int(j < k)) for k in range(60) for j in range(60)]
    else:
        p = {"noise": lambda x: 0.3, "rising": lambda x: x, "falling": lambda x: 1 - x}[shape]
        pairs = [(x, int(rng.random() < p(x))) for x in (rng.randrange(150) / 150 for _ in range(500))]
    df = spark.createDataFrame([*pairs, (None, 1)], "score double, label int")
    got = {r.score: r.probability for r in models.isotonic_fit(df, "score", "label").collect()}
    assert got == pytest.approx(pooled(pairs))


def test_isotonic_fit_of_slices(spark, split_everything):
    rng = random.Random(5)
    pairs = [(x, int(rng.random() < x)) for x in (rng.randrange(90) / 90 for _ in range(400))]
    got = {r.score: r.probability for r in models.isotonic_fit(spark.createDataFrame(pairs, "score double, label int"), "score", "label").collect()}
    assert got == pytest.approx(pooled(pairs))
    assert models.isotonic_fit(spark.createDataFrame([], "score double, label int"), "score", "label").count() == 0


def test_forest_of_many_segments(spark, monkeypatch):
    """More segments than a broadcast model would hold, one of them large and cut in slices; scores equal the plain walk."""
    monkeypatch.setattr(models, "SLICE_ROWS", 50)
    rng = np.random.default_rng(1)
    names = [f"s{k}" for k in range(400) for _ in range(10)] + ["big"] * 700 + ["few"] * 4
    pdf = pd.DataFrame({"event_id": range(len(names)), "segment": names, "a": rng.normal(size=len(names)), "b": rng.normal(size=len(names))})
    df = spark.createDataFrame(pdf)
    forest = models.stored(models.fit_forest(df, ["a", "b"], trees=3), "forest")
    got = models.score_forest(df, forest, ["a", "b"]).toPandas().set_index("event_id").forest_score
    assert len(got) == len(pdf) and got.index.is_unique
    grown = defaultdict(list)
    for r in forest.collect():
        grown[r["segment"]].append(r)
    assert len(grown) == 401
    for name, own in pdf.groupby("segment"):
        if name not in grown:
            assert (got[own.event_id] == 0).all()
            continue
        trees = [tuple(np.array(r[c]) for c in ("feature", "threshold", "left", "right", "depth")) for r in grown[name]]
        expected = 2.0 ** (-models.path_lengths(own[["a", "b"]].to_numpy(), trees) / max(models.average_path(grown[name][0]["size"]), 1e-9))
        assert got[own.event_id].to_numpy() == pytest.approx(expected)


def test_bootstrap_areas(spark):
    rng = random.Random(3)
    data = [(i, rng.randrange(30) / 30, int(rng.random() < 0.4)) for i in range(300)]
    df = spark.createDataFrame([*data, (None, 0.5, 1), (400, None, 1)], "id long, score double, label int")
    got = {r.metric: (r.point, r.lo, r.hi) for r in evaluate.bootstrap_areas(df, "score", "label", "id", 60).collect()}
    m, cuts = evaluate.MIX_MODULUS, [np.ceil(p * evaluate.MIX_MODULUS) for p in evaluate.POISSON_ONE]

    def weight(i, b):
        x = (i % m * (evaluate.mix_factor(0) + b * 209458) + b * 104729 + 104729) % m
        return sum((x * x + i % m) % m * evaluate.mix_factor(3) % m + 7919 - (m if (x * x + i % m) % m * evaluate.mix_factor(3) % m + 7919 >= m else 0) >= c for c in cuts)

    def areas(rows):
        p, n = sum(w for _, y, w in rows if y), sum(w for _, y, w in rows if not y)
        wins = sum(w * v * ((a > b) + 0.5 * (a == b)) for a, y, w in rows if y for b, z, v in rows if not z)
        gain = 0.0
        for t in {a for a, _, _ in rows}:
            at = sum(w for a, y, w in rows if y and a == t)
            gain += at / p * sum(w for a, y, w in rows if y and a >= t) / max(sum(w for a, _, w in rows if a >= t), 1)
        return wins / (p * n), gain

    drawn = [[(x, y, w) for i, x, y in data if (w := weight(i, b))] for b in range(60)]
    total = sum(sum(w for *_, w in rows) for rows in drawn)
    assert abs(total / (300 * 60) - 1) < 0.05  # Poisson counts with mean 1
    values = np.array([areas(rows) for rows in drawn])
    point = areas([(x, y, 1) for _, x, y in data])
    for k, name in enumerate(("roc_auc", "pr_auc")):
        expected = (point[k], np.quantile(values[:, k], 0.025), np.quantile(values[:, k], 0.975))
        # rows without a score or id are left out
        assert got[name] == pytest.approx(expected)


def test_bootstrap_areas_of_slices(spark):
    """Slices that cut through one score, negative ids, null labels and a replicate's draws that never leave their task."""
    rng = random.Random(4)
    data = [(rng.choice([-1, 1]) * i * 7_368_787, 0.5 if i % 2 else rng.random(), rng.choice([0, 1, 1, None])) for i in range(600)]
    df = spark.createDataFrame(data, "id long, score double, label int")
    whole, cut = (sorted(map(tuple, evaluate.bootstrap_areas(df, "score", "label", "id", 40, slice_rows=n).collect())) for n in (10_000, 50))
    assert [c[0] for c in cut] == ["pr_auc", "roc_auc"]
    for a, b in zip(whole, cut):
        assert b[1:] == pytest.approx(a[1:], abs=1e-12)
    drawn = df.select("id").crossJoin(spark.range(40).withColumnRenamed("id", "b")).select("id", "b", evaluate.bootstrap_weight(F.col("id"), F.col("b")).alias("w")).toPandas()
    for b, own in drawn.groupby("b"):
        ident = evaluate.below_modulus(own["id"].to_numpy())
        assert (evaluate.bootstrap_counts(ident, int(b)) == own["w"].to_numpy()).all()
    assert "Generate" not in evaluate.bootstrap_areas(df, "score", "label", "id", 4)._jdf.queryExecution().optimizedPlan().toString()  # rows are not written once per replicate


def requests(rng, n):
    rows, us = [], 0
    for i in range(n):
        us += rng.choice([0, 1, 5, 20, 90]) * 1_000_000
        rows.append((i, rng.choice(["x", "y", None]), pd.Timestamp(us, unit="us").to_pydatetime(), rng.choice(["/a", "/login", "/health", None])))
    return rows


def plain_limiter(rows, span=60, limit=4, own={"/login": 2}, exempt=("/health",)):  # noqa: B006
    held, out = defaultdict(deque), {}
    for i, client, at, path in rows:
        if path in exempt:
            out[i] = (None, True)
            continue
        budget = path if path in own else ""
        hits, now = held[client, budget], at.timestamp()
        while hits and now - hits[0] > span:
            hits.popleft()
        out[i] = (budget, len(hits) < own.get(path, limit))
        if out[i][1]:
            hits.append(now)
    return out


SCHEMA = "id long, client string, at timestamp, path string"
OPTIONS = {"window_s": 60, "limit": 4, "own": {"/login": 2}, "exempt": ("/health",)}


def test_budgets(spark):
    rows = requests(random.Random(1), 400)
    got = detect.rate_limit_budgets(spark.createDataFrame(rows, SCHEMA), "client", "at", "id", "path", **OPTIONS).collect()
    expected = plain_limiter(rows)
    assert {r.id: (r.budget, r.allowed) for r in got} == expected and len(got) == 400
    assert {(b, a) for b, a in expected.values()} >= {("", True), ("", False), ("/login", True), ("/login", False), (None, True)}


def test_streaming_budgets(spark, tmp_path):
    rows = requests(random.Random(2), 300)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", s.ROCKSDB)
    for k in range(0, 300, 60):
        spark.createDataFrame(rows[k: k + 60], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = s.drain_to_table(st.stream_limiter(stream, "client", "at", "id", "path", **OPTIONS), "t-limit").collect()
    assert {r.id: (r.budget, r.allowed) for r in got} == plain_limiter(rows) and len(got) == 300
