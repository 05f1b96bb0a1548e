"""Live detection as one stateful operator per meter: buffer, features, window score, adaptive threshold, attack class, cooldown.

A meter's state holds its last ``length + HISTORY`` readings, its last normal scores and the time of its last alert; each variable expires
``ttl`` after its last change. Features are computed anew over the buffer, so the rows before a window give its first
rows their differences and rolling statistics, and the window is cut off afterwards.

Every reading gives one row with a status: ``buffering`` (not enough readings yet), ``scored``, or ``late`` (older than a reading the meter has
sent in an earlier batch; it changes no state). Within a batch readings are put in order first. A null meter is a meter like others.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.detect import ThresholdState
from ..operators.features import METER, ORDER, diff, rolling_mean, rolling_std
from ..operators.folds import LastEmitted, emit_with_cooldown
from ..operators.series import over_series

RAW = ["consommation_kw", "tension_v", "courant_a"]
ROLLS, HISTORY, TOP = (3, 6), 6, 3
FEATURES = [*RAW, "consommation_kw_diff", "tension_v_diff",
            *[f"consommation_kw_rolling_{n}_{k}" for k in ROLLS for n in ("mean", "std")], "hour_sin", "hour_cos"]
BUFFER = "us long, event_id long, " + ", ".join(f"{c} double" for c in RAW)
SCHEMA = ("event_id long, meter_id string, us long, status string, buffer_fill int, score double, threshold double, is_anomaly boolean, confidence double, "
          "attack_type string, top_features string, critical_step int, deduplicated boolean")


@dataclass
class Model:
    """What scoring needs: window length, mean and scale of each feature, threshold before there is a history, cooldown."""

    length: int
    mean: list[float]
    scale: list[float]
    fallback: float
    cooldown_us: int


def feature_frame(readings: DataFrame) -> DataFrame:
    """The same features over stored readings."""
    def build(w):
        out = {"consommation_kw_diff": diff(w, "consommation_kw"), "tension_v_diff": diff(w, "tension_v")}
        for k in ROLLS:
            out |= {f"consommation_kw_rolling_mean_{k}": rolling_mean(w, "consommation_kw", k), f"consommation_kw_rolling_std_{k}": rolling_std(w, "consommation_kw", k)}
        return out

    angle = F.hour("ts") * (2 * np.pi / 24)
    return over_series(readings, METER, ORDER, build, back=max(ROLLS) - 1).withColumns({"hour_sin": F.sin(angle), "hour_cos": F.cos(angle)})


def fit_model(normal: DataFrame, length: int, fallback: float, cooldown_s: int) -> Model:
    """Means and deviations of the features of normal readings; a feature without spread scales by one."""
    row = normal.agg(*[F.avg(c).alias(f"{c}_m") for c in FEATURES], *[F.stddev_pop(c).alias(f"{c}_s") for c in FEATURES]).first()
    return Model(length, [float(row[f"{c}_m"] or 0.0) for c in FEATURES], [float(row[f"{c}_s"] or 0.0) or 1.0 for c in FEATURES], fallback, cooldown_s * 1_000_000)


def lagged(x: np.ndarray, k: int) -> np.ndarray:
    """k rows: the value and the k - 1 before it, NaN before the first."""
    out = np.full((k, len(x)), np.nan)
    for i in range(min(k, len(x))):
        out[i, i:] = x[: len(x) - i]
    return out


def features(us: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Rows x ``FEATURES`` for readings in order; ``raw`` has the columns ``RAW``."""
    kw, v = raw[:, 0], raw[:, 1]
    step = lambda x: np.nan_to_num(np.diff(x, prepend=np.nan))
    out = [*raw.T, step(kw), step(v)]
    for k in ROLLS:
        near = lagged(kw, k)
        count = np.maximum((~np.isnan(near)).sum(axis=0), 1)
        mean = np.nansum(near, axis=0) / count
        out += [mean, np.sqrt(np.nansum((near - mean) ** 2, axis=0) / np.maximum(count - 1, 1))]
    angle = us // 3_600_000_000 % 24 * (2 * np.pi / 24)
    return np.stack([*out, np.sin(angle), np.cos(angle)], axis=1)


def attack_class(top: list[str], kw: float, v: float, a: float) -> str:
    """Attack class from the leading features and the raw reading, as ``operators.detect.classify_attack``."""
    if any("tension" in f for f in top[:2]):
        return "fdia"
    kva = v * a / 1000.0
    if {"zone_consumption_mean", "consommation_kw_diff"} & set(top) and kw > 5.0 and (kw / kva if kva > 0 else 1.0) < 0.5:
        return "fraud"
    return "fault" if v < 180.0 or a > 50.0 else "dos"


@dataclass
class MeterState:
    """What a meter is known by between two batches."""

    rows: list[tuple] = field(default_factory=list)
    scores: list[float] = field(default_factory=list)
    alert_us: int | None = None


def detect(meter: str | None, state: MeterState, new: pd.DataFrame, model: Model) -> pd.DataFrame:
    """One result for each new reading; ``state`` moves on. Missing measures count as 0."""
    new = new.sort_values(["us", "event_id"])
    last = state.rows[-1][:2] if state.rows else (-(1 << 62), 0)
    keys = list(zip(new["us"].tolist(), new["event_id"].tolist()))
    late = np.array([k < last for k in keys], bool)
    out = pd.DataFrame({"event_id": new["event_id"].to_numpy(), "meter_id": meter, "us": new["us"].to_numpy(), "status": "late", "buffer_fill": np.int32(0),
                        "score": np.nan, "threshold": np.nan, "is_anomaly": False, "confidence": np.nan, "attack_type": None, "top_features": None,
                        "critical_step": np.int32(-1), "deduplicated": False})
    fresh = np.flatnonzero(~late)
    if not len(fresh):
        return out
    old = len(state.rows)
    us = np.array([r[0] for r in state.rows] + [keys[i][0] for i in fresh], np.int64)
    raw = np.concatenate([np.array([r[2:] for r in state.rows], float).reshape(old, len(RAW)), np.nan_to_num(new[RAW].to_numpy(float)[fresh])])
    z = (features(us, raw) - np.array(model.mean)) / np.array(model.scale)
    errors = z * z
    fill = np.minimum(np.arange(old + 1, len(us) + 1), model.length)
    out.loc[out.index[fresh], "buffer_fill"] = fill.astype(np.int32)
    known = ThresholdState()
    known.scores.extend(state.scores)
    alert = LastEmitted()
    alert.at = state.alert_us
    found: dict[str, list] = {c: [] for c in out.columns[3:]}
    for n, size in enumerate(fill.tolist()):
        at = old + n
        if size < model.length:
            row = ("buffering", size, np.nan, np.nan, False, np.nan, None, None, -1, False)
        else:
            cells = errors[at - model.length + 1: at + 1]
            score = float(cells.mean())
            threshold, hit = known.decide(score, model.fallback)
            by_feature = cells.mean(axis=0)
            top = [FEATURES[k] for k in sorted(range(len(FEATURES)), key=lambda k: (-by_feature[k], FEATURES[k]))[:TOP]]
            passed = bool(hit and emit_with_cooldown(alert, us[at: at + 1], model.cooldown_us)[0])
            row = ("scored", size, score, threshold, hit, min(1.0, score / max(threshold, 1e-9)), attack_class(top, *raw[at]) if hit else "normal",
                   ",".join(top), int(np.argmax(cells.mean(axis=1))), hit and not passed)
        for c, value in zip(found, row):
            found[c].append(value)
    for c, values in found.items():
        out[c] = out[c].astype(object)
        out.iloc[fresh, out.columns.get_loc(c)] = values
    keep = model.length + HISTORY
    rows = state.rows + [(*keys[i], *map(float, r)) for i, r in zip(fresh[-keep:], raw[old:][-keep:])]
    state.rows, state.scores, state.alert_us = rows[-keep:], [float(x) for x in known.scores], alert.at
    return out.astype({"buffer_fill": "int32", "critical_step": "int32", "score": float, "threshold": float, "confidence": float, "is_anomaly": bool, "deduplicated": bool})


class Detector(StatefulProcessor):
    """Keeps ``MeterState`` in three state variables with a time to live."""

    def __init__(self, model: Model, ttl_ms: int | None) -> None:
        self.model, self.ttl = model, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rows = handle.getListState("rows", BUFFER, self.ttl)
        self.scores = handle.getValueState("scores", "scores array<double>", self.ttl)
        self.alert = handle.getValueState("alert", "us long", self.ttl)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        """Earlier readings fill the buffer; nothing is scored."""
        seed = initialState.sort_values(["us", "event_id"]).tail(self.model.length + HISTORY)
        self.rows.put([(int(r.us), int(r.event_id), *(float(getattr(r, c)) for c in RAW)) for r in seed.itertuples()])

    def handleInputRows(self, key, rows, timerValues):
        parts = [p for p in rows if len(p)]
        if not parts:
            return
        state = MeterState([tuple(r) for r in self.rows.get()] if self.rows.exists() else [], list(self.scores.get()[0]) if self.scores.exists() else [],
                           int(self.alert.get()[0]) if self.alert.exists() else None)
        out = detect(key[0], state, pd.concat(parts), self.model)
        if state.rows:
            self.rows.put(state.rows)
            self.scores.update((state.scores,))
        if state.alert_us is not None:
            self.alert.update((state.alert_us,))
        yield out

    def close(self) -> None:
        pass


def _rows(readings: DataFrame) -> DataFrame:
    return readings.select("meter_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "event_id", *[F.col(c).cast("double").alias(c) for c in RAW])


def stream_detection(readings: DataFrame, model: Model, seed: DataFrame | None = None, ttl_days: int | None = 30) -> DataFrame:
    """One row per live reading; ``seed`` holds stored readings that fill the buffers first.

    A key's rows of one micro-batch are held by one worker; the trigger's size bounds them. The time to live is kept in processing time,
    for which Spark goes on making batches: a stream that is to end with its source (``availableNow``) takes None.
    """
    processor = Detector(model, ttl_days * 86_400_000 if ttl_days else None)
    first = _rows(seed).groupBy("meter_id") if seed is not None else None
    return _rows(readings).groupBy("meter_id").transformWithStateInPandas(processor, SCHEMA, "Append", "ProcessingTime" if ttl_days else "None", initialState=first)


def notarized(detections: DataFrame) -> DataFrame:
    """The alerts: anomalies that the cooldown lets through, with the columns a ledger needs."""
    passed = detections.filter("is_anomaly AND NOT deduplicated")
    return passed.withColumn("ts", F.timestamp_micros("us")).withColumn("statut", F.lit("ALERTE"))
