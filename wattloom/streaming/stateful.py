"""Keyed state handlers: cooldown, rolling buffers, adaptive thresholds.

A key's rows of one micro-batch are put in event-time order before they meet the state; the trigger size
bounds how many there can be. No watermark drops rows on the way here.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.detect import ADAPTIVE_SCHEMA, ThresholdState, allow, decide_rows, with_budget
from ..operators.folds import LastEmitted, emit_with_cooldown


def in_order(rows: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    parts = [p for p in rows if len(p)]
    return pd.concat(parts).sort_values(by) if parts else pd.DataFrame()


class Cooldown(StatefulProcessor):
    """Emits at most one alert per key and cooldown. An alert older than the last one emitted does not pass; none is lost."""

    def __init__(self, cooldown_us: int, ttl_ms: int | None) -> None:
        self.cooldown, self.ttl = cooldown_us, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last_emitted", "us long", self.ttl)

    def handleInputRows(self, key, rows, timerValues):
        pdf = in_order(rows, ["us", "id"])
        if pdf.empty:
            return
        state = LastEmitted()
        state.at = int(self.last.get()[0]) if self.last.exists() else None
        emitted = emit_with_cooldown(state, pdf["us"].to_numpy(), self.cooldown)
        if state.at is not None:
            self.last.update((state.at,))
        yield pd.DataFrame({"meter_id": key[0], "id": pdf["id"].to_numpy(), "emitted": emitted})

    def close(self) -> None:
        pass


def stream_cooldown(alerts: DataFrame, cooldown_s: int, ttl_days: int | None = None) -> DataFrame:
    """Every alert with its decision; the state is one number for each key.

    ``ttl_days`` forgets silent keys, for streams that run on processing-time triggers; it should exceed the cooldown.
    """
    rows = alerts.select("meter_id", "id", F.unix_micros("created_at").alias("us"))
    processor = Cooldown(cooldown_s * 1_000_000, ttl_days * 86_400_000 if ttl_days else None)
    return rows.groupBy("meter_id").transformWithStateInPandas(
        processor, "meter_id string, id long, emitted boolean", "Append", "ProcessingTime" if ttl_days else "None")


WINDOW_SCHEMA = "event_id long, meter_id string, kw_mean double, v_min double, n_steps int, buffer_fill int"


class RollingBuffer(StatefulProcessor):
    """Last rows per meter; every reading reports how full the buffer is and, once full, its window."""

    def __init__(self, length: int) -> None:
        self.length = length

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rows = handle.getListState("rows", "us long, event_id long, kw double, v double")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self._store(initialState.sort_values(["us", "event_id"])[["us", "event_id", "kw", "v"]])

    def _store(self, pdf: pd.DataFrame) -> None:
        kept = [tuple(x) for x in pdf.tail(self.length - 1).astype(object).itertuples(index=False)]
        if kept:
            self.rows.put(kept)

    def handleInputRows(self, key, rows, timerValues):
        new = in_order(rows, ["us", "event_id"])
        if len(new):
            old = [tuple(x) for x in self.rows.get()] if self.rows.exists() else []
            kept, out = roll_windows(key[0], old, new, self.length)
            self.rows.put(kept)
            yield out

    def close(self) -> None:
        pass


def roll_windows(meter: str, old: list[tuple], new: pd.DataFrame, length: int) -> tuple[list[tuple], pd.DataFrame]:
    """The rows to keep and one output row per new reading."""
    cols = {c: np.concatenate([np.array([row[i] for row in old], dtype=new[c].dtype), new[c].to_numpy()]) for i, c in enumerate(("us", "event_id", "kw", "v"))}
    kw, v = pd.Series(cols["kw"].astype(float)), pd.Series(cols["v"].astype(float))
    n, at = len(kw), len(old)
    out = pd.DataFrame({
        "event_id": cols["event_id"][at:], "meter_id": meter,
        "kw_mean": kw.rolling(length, min_periods=1).apply(np.mean, raw=True).to_numpy()[at:],
        "v_min": v.rolling(length, min_periods=1).min().to_numpy()[at:],
        "n_steps": np.int32(length), "buffer_fill": np.minimum(np.arange(at + 1, n + 1), length).astype("int32")})
    first = max(n - length + 1, 0)
    kept = list(zip(cols["us"][first:].tolist(), cols["event_id"][first:].tolist(), kw[first:].tolist(), v[first:].tolist()))
    return kept, out


def _buffer_rows(readings: DataFrame) -> DataFrame:
    return readings.select("meter_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "event_id",
                           F.col("consommation_kw").alias("kw"), F.col("tension_v").alias("v"))


def stream_windows(readings: DataFrame, length: int) -> DataFrame:
    """Sliding windows over live readings; the state is one array of the meter's last rows."""

    def update(key, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        new = in_order(rows, ["us", "event_id"])
        if len(new):
            kept, out = roll_windows(key[0], [tuple(x) for x in state.get[0]] if state.exists else [], new, length)
            state.update((kept,))
            yield out

    return _buffer_rows(readings).groupBy("meter_id").applyInPandasWithState(
        update, WINDOW_SCHEMA, "rows array<struct<us:bigint,event_id:bigint,kw:double,v:double>>", "append", GroupStateTimeout.NoTimeout)


def stream_seeded_windows(readings: DataFrame, length: int, seed: DataFrame) -> DataFrame:
    """Sliding windows that continue a batch of earlier readings."""
    return _buffer_rows(readings).groupBy("meter_id").transformWithStateInPandas(
        RollingBuffer(length), WINDOW_SCHEMA, "Append", "None", initialState=_buffer_rows(seed).groupBy("meter_id"))


def stream_adaptive(scored: DataFrame, fallback: float) -> DataFrame:
    """Adaptive threshold with the meter's last normal scores as state."""

    def update(key, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = ThresholdState()
        if state.exists:
            known.scores.extend(state.get[0])
        pdf = in_order(rows, ["us", "event_id"])
        if len(pdf):
            yield pd.DataFrame(decide_rows(known, {c: pdf[c].to_numpy() for c in pdf.columns}, fallback))
            state.update(([float(x) for x in known.scores],))

    rows = scored.select("meter_id", "event_id", "score", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return rows.groupBy("meter_id").applyInPandasWithState(
        update, ADAPTIVE_SCHEMA, "scores array<double>", "append", GroupStateTimeout.NoTimeout)


LIMIT_SCHEMA = "client string, id long, budget string, allowed boolean"


class Limiter(StatefulProcessor):
    """The passed requests of one client and budget that are still in the window; at most ``limit`` times."""

    def __init__(self, span_us: int, ttl_ms: int | None) -> None:
        self.span, self.ttl = span_us, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.hits = handle.getValueState("hits", "us array<long>", self.ttl)

    def handleInputRows(self, key, rows, timerValues):
        pdf = in_order(rows, ["us", "id"])
        if pdf.empty:
            return
        hits = deque(int(x) for x in self.hits.get()[0]) if self.hits.exists() else deque()
        # a request older than the last passed one is judged as if it came with it
        at = np.maximum.accumulate(np.maximum(pdf["us"].to_numpy(), hits[-1] if hits else pdf["us"].iloc[0]))
        allowed = [allow(hits, int(now), self.span, int(most)) for now, most in zip(at, pdf["most"])]
        self.hits.update((list(hits),))
        yield pd.DataFrame({"client": key[0], "id": pdf["id"].to_numpy(), "budget": key[1], "allowed": allowed})

    def close(self) -> None:
        pass


def stream_limiter(requests: DataFrame, client: str, ts: str, ident: str, path: str, window_s: int, limit: int, own: dict[str, int],
                   exempt: tuple[str, ...] = (), ttl_days: int | None = None) -> DataFrame:
    """Live limiter with a budget for each path in ``own``; exempt paths pass without state.

    With ``ttl_days`` windows of silent clients are forgotten (for streams that run on processing-time triggers).
    """
    rows = with_budget(requests.select(F.col(client).cast("string").alias("client"), F.col(ident).cast("long").alias("id"), F.col(path).alias("path"),
                                       F.unix_micros(F.col(ts).cast("timestamp")).alias("us")), "path", limit, own, exempt).drop("path")
    rows = rows.withColumnsRenamed({"__budget": "budget", "__limit": "most"})
    judged = rows.filter("budget is not null").groupBy("client", "budget").transformWithStateInPandas(
        Limiter(window_s * 1_000_000, ttl_days * 86_400_000 if ttl_days else None), LIMIT_SCHEMA, "Append", "ProcessingTime" if ttl_days else "None")
    if not exempt:
        return judged
    return judged.unionByName(rows.filter("budget is null").select("client", "id", F.lit(None).cast("string").alias("budget"), F.lit(True).alias("allowed")))
