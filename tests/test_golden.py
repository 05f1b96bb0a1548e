"""Small hand-made cases with known results."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from wattloom.operators import consumers as c, evaluate as e, ledger as l, perturb as p
from wattloom.operators.folds import LastEmitted, emit_with_cooldown
from wattloom.sources.files import read_csv_safe, reading_kind, wide_day_columns

DAY = dt.date(2024, 1, 1)


def test_melt_keeps_rows_and_flags(spark):
    wide = spark.createDataFrame([(1, 0, 1.0, None, 3.0), (2, 1, 4.0, 5.0, 6.0)], "cons_no long, flag int, `2014/1/1` double, `2014/1/2` double, `2014/1/3` double")
    long = c.wide_to_long(wide, wide_day_columns(wide.columns)).collect()
    assert len(long) == 6 and {(x["cons_no"], x["flag"]) for x in long} == {(1, 0), (2, 1)}


def test_days_sort_by_calendar():
    assert wide_day_columns(["CONS_NO", "FLAG", "2014/1/1", "2014/1/10", "2014/1/2"]) == ["2014/1/1", "2014/1/2", "2014/1/10"]


@pytest.mark.parametrize("values, filled, frac", [([1.0, None, 3.0, None, None], [1, 2, 3, 3, 3], 0.6), ([None] * 5, [0] * 5, 1.0), ([None, 2.0], [2, 2], 0.5)])
def test_linear_impute(spark, values, filled, frac):
    rows = [(1, DAY + dt.timedelta(days=i), v) for i, v in enumerate(values)]
    got = c.linear_impute(spark.createDataFrame(rows, "cons_no long, day date, kwh double")).orderBy("day").collect()
    assert [x["filled"] for x in got] == filled and all(abs(x["missing_frac"] - frac) < 1e-12 for x in got)


def test_zero_consumer_has_no_nan(spark):
    rows = [(1, 0, DAY + dt.timedelta(days=i), 0.0) for i in range(10)]
    df = c.linear_impute(spark.createDataFrame(rows, "cons_no long, flag int, day date, kwh double"))
    got = c.consumer_aggregates(df).first()
    assert got["cv"] == 0.0 and got["acf1"] == 0.0 and all(math.isfinite(got[x]) for x in c.AGGREGATES)


def test_consumer_means(spark):
    df = spark.createDataFrame([("c0", 1.0), ("c0", 3.0), ("c1", 10.0)], "k string, s double")
    assert {x["k"]: x["score_mean"] for x in c.consumer_scores(df, "k", "s").collect()} == {"c0": 2.0, "c1": 10.0}


def test_row_windows(spark):
    from wattloom.operators.features import tumbling_rows

    df = spark.range(60).select(F.lit("a").alias("k"), "id")
    assert tumbling_rows(df, ["k"], ["id"], 30).select("window_no").distinct().count() == 2


SCORES = "score double, label int"


def test_auc_of_one_class_is_half(spark):
    got = e.curve_areas(spark.createDataFrame([(0.1, 0), (0.9, 0)], SCORES), [], "score", "label").first()
    assert got["roc_auc"] == 0.5


def test_auc_perfect_worst_and_ties(spark):
    def auc(rows):
        return e.curve_areas(spark.createDataFrame(rows, SCORES), [], "score", "label").first()["roc_auc"]

    assert auc([(0.1, 0), (0.9, 1)]) == 1.0 and auc([(0.9, 0), (0.1, 1)]) == 0.0 and auc([(0.5, 0), (0.5, 1)]) == 0.5


def test_threshold_without_attacks(spark):
    got = e.f1_threshold(spark.createDataFrame([(1.0, 0), (3.0, 0)], SCORES), "score", "label").first()
    assert got["threshold"] == 2.0 + 3 * 1.0 and got["f1"] == 0.0


def test_mcnemar_identical(spark):
    df = spark.createDataFrame([(0.9, 1), (0.2, 0)], SCORES)
    got = e.mcnemar(df, "label", "score > 0.5", "score > 0.5").first()
    assert (got["b01"], got["b10"], got["statistic"], got["odds_ratio"]) == (0, 0, 0.0, 1.0)


def test_calibration_bounds(spark):
    perfect = spark.createDataFrame([(0.0, 0)] * 20 + [(1.0, 1)] * 20, SCORES)
    got = e.calibration_error(perfect, [], "score", "label").first()
    assert got["ece"] == 0.0 and got["brier"] == 0.0
    tiny = spark.createDataFrame([(0.0, 0)] * 20 + [(0.99, 0)], SCORES)
    got = e.calibration_error(tiny, [], "score", "label").first()
    assert got["mce"] > 0.9 and got["mce_robust"] == 0.0


def test_temperature_prefers_the_true_scale(spark):
    rows = [(x / 10.0, int(x > 5)) for x in range(11)]
    grid = e.temperature_grid(spark.createDataFrame(rows, SCORES), "score", "label").orderBy("nll").first()
    assert abs(grid["T"] - 0.05) < 1e-9  # separable: the sharpest sigmoid wins


METER = "event_id long, ts timestamp_ntz, meter_id string, x double, is_alert int"


def meter_rows(spark, values, alerts=None):
    t0 = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(i, t0 + dt.timedelta(minutes=i), "m", float(v), (alerts or [0] * len(values))[i]) for i, v in enumerate(values)], METER)


def test_lost_packets_repeat_the_last_delivered(spark):
    df = meter_rows(spark, range(1, 101))
    got = p.packet_loss(df, ["x"], 0.3, 5).orderBy("event_id").collect()
    last = 0.0
    for i, row in enumerate(got):
        last = last if row["lost"] else float(i + 1)
        assert row["x"] == last
    assert any(r["lost"] for r in got) and not all(r["lost"] for r in got)


def test_concept_drift_identity_and_direction(spark):
    df = meter_rows(spark, [1, 2, 30, 40], [0, 0, 1, 1])
    assert [r["x"] for r in p.concept_drift(df, ["x"], "is_alert", 0.0).orderBy("event_id").collect()] == [1, 2, 30, 40]
    assert [r["x"] for r in p.concept_drift(df, ["x"], "is_alert", 1.0).orderBy("event_id").collect()] == [1, 2, 1.5, 1.5]


def test_sensor_failure_touches_targets_only(spark):
    got = p.sensor_failure(meter_rows(spark, [1, 2]), ["x"]).collect()
    assert all(r["x"] == 0.0 for r in got) and sorted(r["event_id"] for r in got) == [0, 1]


def test_midnight_wrap(spark):
    incidents = spark.createDataFrame([(1, "Z", 22, 3)], "incident_id int, zone string, start_hour int, end_hour int")
    rows = spark.createDataFrame([(h, dt.datetime(2024, 1, 1, h), "Z") for h in (1, 3, 12, 22)], "event_id long, ts timestamp_ntz, zone string")
    got = {r["event_id"]: r["incident_id"] for r in p.active_incident(rows, incidents).collect()}
    assert got == {1: 1, 3: 0, 12: 0, 22: 1}


def test_genesis():
    import hashlib

    g = l.genesis(["a", "b"])
    assert g["transaction_root"] == hashlib.sha256(b"GENESIS").hexdigest() and g["previous_hash"] == "0" * 64


def test_anchor_rules(spark):
    rows = [(1, "b", 5, "h"), (2, "b", 5, "h"), (3, "b", 9, ""), (4, "b", 6, "h"), (5, "b", 2, "h")]
    df = spark.createDataFrame(rows, "id long, k string, idx long, hash string")
    got = {r["id"]: r["accepted"] for r in l.anchor_audit(df, ["k"], ["id"], "idx", "hash").collect()}
    assert got == {1: True, 2: False, 3: False, 4: True, 5: False}


def test_cooldown_measures_from_the_last_emitted():
    import numpy as np

    state = LastEmitted()
    assert emit_with_cooldown(state, np.array([0, 200, 400, 500, 700]), 300).tolist() == [True, False, True, False, True]
    assert emit_with_cooldown(state, np.array([900, 1000]), 300).tolist() == [False, True]


def test_missing_csv_is_an_empty_table(spark, tmp_path):
    from pyspark.sql import types as T

    df = read_csv_safe(spark, str(tmp_path / "nothing"), T.StructType([T.StructField("a", T.LongType())]))
    assert df.count() == 0 and df.columns == ["a"]


def test_reading_kind(spark):
    assert reading_kind(spark.createDataFrame([(1.0, 2.0, 3.0)], "consommation_kw double, tension_v double, courant_a double")) == "meter"
    assert reading_kind(spark.range(1)) == "generic"
