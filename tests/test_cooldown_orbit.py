"""Cooldown of keys that are never silent: pointers doubled over the alerts against the plain fold."""

import random

import numpy as np
import pandas as pd

from wattloom.operators import detect
from wattloom.operators.folds import LastEmitted, emit_with_cooldown


def alerts(rng, n):
    """A hot key without a pause, one with pauses, a null key, ties in time."""
    rows, clock = [], {"hot": 0, "calm": 0, None: 0}
    for i in range(n):
        key = "hot" if rng.random() < 0.7 else rng.choice(["calm", None])
        clock[key] += rng.choice([0, 0, 3, 20, 59] if key == "hot" else [5, 40, 200])
        rows.append((key, 5000 - i if i % 3 else 9000 + i, pd.Timestamp(clock[key], unit="s").to_pydatetime()))
    return rows


def plain(rows, cooldown_s):
    out = {}
    for key in {k for k, _, _ in rows}:
        own = sorted((t, i) for k, i, t in rows if k == key)
        us = np.array([round(t.timestamp() * 10 ** 6) for t, _ in own])
        out |= {i: bool(e) for (_, i), e in zip(own, emit_with_cooldown(LastEmitted(), us, cooldown_s * 10 ** 6))}
    return out


def test_orbit_equals_the_fold(spark, split_everything, monkeypatch):
    rows = alerts(random.Random(4), 900)
    used = []
    orbit = detect._orbit
    monkeypatch.setattr(detect, "_orbit", lambda runs, *a: used.append(runs.count()) or orbit(runs, *a))
    df = spark.createDataFrame(rows, "k string, id long, at timestamp").repartition(4)
    for cooldown in (60, 61, 300):
        got = detect.alert_cooldown(df, "k", "at", "id", cooldown).collect()
        assert len(got) == 900 and {r.id: r.emitted for r in got} == plain(rows, cooldown)
    assert len(used) == 3 and 500 < used[0] <= used[2] <= 900  # runs above the limit went this way


def test_no_alerts(spark, split_everything):
    assert detect.alert_cooldown(spark.createDataFrame([], "k string, id long, at timestamp"), "k", "at", "id", 60).count() == 0
