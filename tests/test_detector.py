"""The live detector: many batches, late and unordered readings, null meters, seeded buffers, expiry, both sinks."""

import datetime as dtm
import random

import numpy as np
import pandas as pd
import pytest
from oracle import compare
from pyspark.sql import functions as F

import __spark_entry__ as entry
from wattloom.operators import ledger as l
from wattloom.plans.ledger import NODES
from wattloom.streaming import detector as dt, microbatch as m, sources as s

SCHEMA = "event_id long, meter_id string, ts timestamp, consommation_kw double, tension_v double, courant_a double"
MODEL = dt.Model(4, [5.0, 220.0, 20.0, 0.0, 0.0, 5.0, 1.0, 5.0, 1.0, 0.0, 0.0], [2.0, 20.0, 8.0, 2.0, 9.0, 2.0, 1.0, 2.0, 1.0, 0.7, 0.7], 1.4, 7_200_000_000)


def readings(n=400, seed=1):
    rng = random.Random(seed)
    start = dtm.datetime(2024, 3, 1, tzinfo=dtm.timezone.utc)
    rows = []
    for i in range(n):
        wild = rng.random() < 0.15
        rows.append((i, rng.choice(["a", "b", None]), start + dtm.timedelta(minutes=17 * i), rng.uniform(2, 8) * (3 if wild else 1),
                     rng.uniform(190, 250) - (40 if wild and i % 2 else 0), None if i % 41 == 0 else rng.uniform(10, 30)))
    return rows


def plain(batches, model):
    """event_id -> (status, fill, score, threshold, anomaly, class, top, step, deduplicated), reading by reading."""
    seen, out = {}, {}
    for batch in batches:
        for i, meter, ts, *raw in sorted(batch, key=lambda r: (r[2], r[0])):
            st = seen.setdefault(meter, {"rows": [], "scores": [], "alert": None, "last": None})
            us = round((ts - dtm.datetime(1970, 1, 1, tzinfo=dtm.timezone.utc)).total_seconds()) * 10 ** 6
            if st["last"] is not None and (us, i) < st["last"]:
                out[i] = ("late", 0)
                continue
            st["rows"].append((us, i, *[x or 0.0 for x in raw]))
        for st in seen.values():
            for n in range(st.get("done", 0), len(st["rows"])):
                own = st["rows"][: n + 1]
                us, i, kw, v, a = own[-1]
                if len(own) < model.length:
                    out[i] = ("buffering", len(own))
                    continue
                cells = []
                for k in range(len(own) - model.length, len(own)):
                    x = [r[2] for r in own[: k + 1]]
                    d = [own[k][c] - own[k - 1][c] if k else 0.0 for c in (2, 3)]
                    roll = [f(x[-w:]) for w in (3, 6) for f in (np.mean, lambda y: np.std(y, ddof=1) if len(y) > 1 else 0.0)]
                    hour = own[k][0] // 3_600_000_000 % 24
                    row = [*own[k][2:], *d, *roll, np.sin(2 * np.pi * hour / 24), np.cos(2 * np.pi * hour / 24)]
                    cells.append([((p - q) / r) ** 2 for p, q, r in zip(row, model.mean, model.scale)])
                cells = np.array(cells)
                score, history = cells.mean(), st["scores"][-500:]
                threshold = np.mean(history) + 3 * np.std(history) if len(history) >= 30 else model.fallback
                by = dict(zip(dt.FEATURES, cells.mean(axis=0)))
                top = sorted(by, key=lambda c: (-by[c], c))[:3]
                hit = score >= threshold
                again = hit and st["alert"] is not None and us - st["alert"] < model.cooldown_us
                if hit and not again:
                    st["alert"] = us
                if not hit:
                    st["scores"].append(score)
                out[i] = ("scored", model.length, score, threshold, hit, dt.attack_class(top, kw, v, a) if hit else "normal", ",".join(top), int(np.argmax(cells.mean(axis=1))), bool(again))
            st["done"] = len(st["rows"])
            if st["rows"]:
                st["last"] = st["rows"][-1][:2]
    return out


def run(spark, tmp_path, batches, **options):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", s.ROCKSDB)
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    return s.drain_to_table(dt.stream_detection(stream, MODEL, ttl_days=None, **options), "t-detect")


def assert_equal(got, expected):
    assert {r.event_id for r in got} == set(expected) and len(got) == len(expected)
    for r in got:
        e = expected[r.event_id]
        assert (r.status, r.buffer_fill) == e[:2], r
        if r.status == "scored":
            assert (r.score, r.threshold) == pytest.approx(e[2:4], rel=1e-9)
            assert (r.is_anomaly, r.attack_type, r.top_features, r.critical_step, r.deduplicated) == e[4:], r
            assert r.confidence == pytest.approx(min(1.0, e[2] / e[3]))


def test_batches_with_unordered_and_late_rows(spark, tmp_path):
    rows = readings()
    rng = random.Random(2)
    batches = [rows[k: k + 80] for k in range(0, 400, 80)]
    for k in range(4):  # some readings arrive a batch late, all are shuffled inside their batch
        late = [r for r in batches[k] if rng.random() < 0.06]
        batches[k] = [r for r in batches[k] if r not in late]
        batches[k + 1] = batches[k + 1] + late
    for b in batches:
        rng.shuffle(b)
    expected = plain(batches, MODEL)
    kinds = {e[0] for e in expected.values()}
    assert kinds == {"late", "buffering", "scored"} and {True, False} == {e[8] for e in expected.values() if e[0] == "scored" and e[4]}
    assert_equal(run(spark, tmp_path, batches).collect(), expected)


def test_seeded_buffers(spark, tmp_path):
    rows = readings(120, 5)
    seeded = run(spark, tmp_path, [rows[60:]], seed=spark.createDataFrame(rows[:60], SCHEMA).na.fill(0.0)).collect()
    whole = plain([rows[:60], rows[60:]], MODEL)
    fresh = plain([rows[60:]], MODEL)
    assert {r.status for r in seeded} == {"scored"} and "buffering" in {e[0] for e in fresh.values()}
    for r in seeded:  # scores continue the history, thresholds start anew
        assert r.score == pytest.approx(whole[r.event_id][2])


def test_state_stays_bounded():
    state, rows = dt.MeterState(), readings(700, 3)
    frame = pd.DataFrame(rows, columns=["event_id", "meter_id", "ts", *dt.RAW])
    frame["us"] = frame.ts.map(lambda t: round(t.timestamp()) * 10 ** 6)
    for k in range(0, 700, 35):
        dt.detect("a", state, frame.iloc[k: k + 35], MODEL)
        assert len(state.rows) <= MODEL.length + dt.HISTORY and len(state.scores) <= 500


def test_time_to_live(spark, tmp_path):
    """With a time to live the stream runs on triggers; results are the same while nothing expires."""
    rows = readings(60, 7)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", s.ROCKSDB)
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = dt.stream_detection(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in"), MODEL, ttl_days=1)
    q = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(processingTime="2 seconds").start()
    try:
        for _ in range(60):
            if q.lastProgress and q.lastProgress["batchId"] >= 1:
                break
            q.awaitTermination(1)
    finally:
        q.stop()
    assert_equal(spark.read.parquet(f"{tmp_path}/out").collect(), plain([rows], MODEL))


def test_null_meters_are_sealed_over_batches(spark, tmp_path):
    """Rows of a null meter keep their numbers from batch to batch and are sealed like those of any other."""
    rows = [(i, None if i % 2 else "m1", dtm.datetime(2024, 1, 1) + dtm.timedelta(minutes=i), "NORMAL") for i in range(60)]
    for k in range(3):
        batch = spark.createDataFrame(rows[k * 20: k * 20 + 20], "event_id long, meter_id string, ts timestamp, statut string")
        m.seal_batch(batch, k, str(tmp_path), 5, NODES, "readings", {"event_id": F.col("event_id"), "meter_id": l.text("meter_id")})
    sealed = spark.read.parquet(f"{tmp_path}/out").collect()
    for meter in ("m1", None):
        own = sorted((r.block_index, r.row_start, r.row_end) for r in sealed if r.meter_id == meter)
        assert own == [(k + 1, 5 * k + 1, 5 * k + 5) for k in range(6)]
        links = {r.block_index: r for r in sealed if r.meter_id == meter}
        assert all(links[k + 1].previous_hash == links[k].block_hash for k in range(1, 6))
    assert spark.read.parquet(f"{tmp_path}/pending/batch=2").count() == 0


def test_queries(spark, folder):
    """Sinks and detections agree."""
    found = entry.queries()["stream_detection"](spark, folder).toPandas()
    sinks = entry.queries()["stream_detection_sinks"](spark, folder).toPandas()
    passed = set(found[found.is_anomaly & ~found.deduplicated].event_id)
    assert set(sinks[sinks.sink == "alerts"].event_id) == passed and set(sinks[sinks.sink == "ledger"].event_id) <= passed
    assert compare(found, found) == []
