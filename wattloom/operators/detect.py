"""Anomaly rules, scores, thresholds and alerting."""

from __future__ import annotations

import bisect
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from ..functions.expr import div0, first_max_name, micros
from .features import METER, ORDER, diff, pct_change, scaler_stats, temporal
from .folds import Arrays, LastEmitted, emit_with_cooldown, ordered_fold
from .profile import grouped_baseline
from .quantiles import percentiles, with_scalars
from .series import ALL, HALO, SLICE, carry_forward, fits_one_task, islands, null_safe_join, ordinal, over_series, running, slice_series, split_rows, stored

# fixed values: electrical limits
V_NOMINAL, V_MIN, V_MAX, V_CRIT_MIN, V_CRIT_MAX = 230.0, 207.0, 253.0, 200.0, 260.0
F_MIN, F_MAX, F_TOLERANCE, PF_MIN = 59.5, 60.5, 0.5, 0.85
SPIKE_FACTOR, RATE_LIMIT = 3.0, 5.0
# fixed values: weight of each criterion, in tie-breaking order
WEIGHTS = {"reconstruction": 0.20, "voltage": 0.20, "consumption": 0.15, "power_factor": 0.15,
           "frequency": 0.15, "temporal": 0.10, "rate_change": 0.05}
ANOMALY_LEVEL = 0.2

# ---- the seven criteria ----------------------------------------------------

def voltage_rule(v: Column) -> tuple[Column, Column]:
    dev = F.abs(v - V_NOMINAL) / V_NOMINAL
    critical, outside = (v < V_CRIT_MIN) | (v > V_CRIT_MAX), (v < V_MIN) | (v > V_MAX)
    base = F.when(critical, 1.0).when(outside, 0.7).otherwise(0.0)
    score = F.when(dev > 0.05, F.greatest(base, dev * 2)).otherwise(base)
    kind = (F.when(v < V_CRIT_MIN, "critical_under_voltage").when(v < V_MIN, "under_voltage")
            .when(v > V_CRIT_MAX, "critical_over_voltage").when(v > V_MAX, "over_voltage").otherwise("normal"))
    return score, kind


def consumption_rule(kw: Column, kind: Column, hour: Column, mean: Column, std: Column, q95: Column) -> tuple[Column, Column]:
    """``mean``, ``std`` and ``q95`` are those of the consumer type."""
    idle_industry = (kw == 0) & (kind == "industriel") & hour.between(6, 22)
    idle_shop = (kw == 0) & (kind == "commercial") & hour.between(8, 18)
    spike, high = kw > mean * SPIKE_FACTOR, kw > q95
    base = F.when(idle_industry, 0.8).when(idle_shop, 0.7).when(spike, 0.9).when(high, 0.6).otherwise(0.0)
    z = F.abs(kw - mean) / (std + 1e-6)
    score = F.when(z > 3, F.greatest(base, F.least(z / 5, F.lit(1.0)))).otherwise(base)
    name = (F.when(z > 3, "statistical_outlier").when(idle_industry | idle_shop, "unexpected_zero_consumption")
            .when(spike, "consumption_spike").when(high, "high_consumption").otherwise("normal"))
    return score, name


def power_factor_rule(kw: Column, v: Column, a: Column) -> tuple[Column, Column]:
    kva = v * a / 1000
    pf = F.least(kw / (kva + 1e-6), F.lit(1.0))
    dead, impossible, low = (v <= 0) | (a <= 0) | (kva == 0), kw > kva * 1.05, pf < PF_MIN
    score = F.when(dead, 0.0).when(impossible, 0.9).when(low, (PF_MIN - pf) / PF_MIN).otherwise(0.0)
    kind = F.when(dead, "normal").when(impossible, "impossible_power_factor").when(low, "low_power_factor").otherwise("normal")
    return score, kind


def frequency_rule(hz: Column) -> tuple[Column, Column]:
    over = F.when(hz < F_MIN, F_MIN - hz).when(hz > F_MAX, hz - F_MAX).otherwise(0.0)
    score = F.least(over / F_TOLERANCE, F.lit(1.0))
    return score, F.when(hz < F_MIN, "low_frequency").when(hz > F_MAX, "high_frequency").otherwise("normal")


def temporal_rule(kw: Column, kind: Column, hour: Column, weekend: Column, mean: Column) -> tuple[Column, Column]:
    """``mean`` is the mean over all readings."""
    night = (kind == "residentiel") & hour.between(0, 5) & (kw > mean * 1.5)
    shop_weekend = (kind == "commercial") & (weekend == 1) & (kw > mean)
    shop_off = (kind == "commercial") & (hour.between(0, 6) | hour.between(20, 23)) & (kw > mean)
    shutdown = (kind == "industriel") & hour.between(8, 18) & (kw < mean * 0.3)
    score = F.when(night | shutdown, 0.6).when(shop_weekend | shop_off, 0.5).otherwise(0.0)
    name = (F.when(night, "unusual_night_consumption").when(shop_weekend, "weekend_commercial_activity")
            .when(shop_off, "off_hours_commercial_activity").when(shutdown, "unexpected_industrial_shutdown").otherwise("normal"))
    return score, name


def rate_change_rule(step: Column, rate: Column) -> tuple[Column, Column]:
    sudden, rapid = F.abs(step) > RATE_LIMIT, F.abs(rate) > 2.0
    base = F.when(sudden, F.least(F.abs(step) / (2 * RATE_LIMIT), F.lit(1.0))).otherwise(0.0)
    score = F.when(rapid, F.greatest(base, F.least(F.abs(rate) / 5.0, F.lit(1.0)))).otherwise(base)
    return score, F.when(rapid, "rapid_fluctuation").when(sudden, "sudden_change").otherwise("normal")


def reconstruction_criterion(error: Column, p95: Column) -> Column:
    return F.when(error > p95, 1.0).otherwise(error / p95)


def with_type_stats(df: DataFrame) -> DataFrame:
    """Attach mean_t, std_t, q95_t of the consumer type (global ones for unknown types) and the global mean.

    The statistics have one row per consumer type, a fixed enumeration, and arrive as one map value.
    """
    stats = grouped_baseline(df)
    values = F.struct("mean", "std", "q95")
    known = (F.col("overall") == 0) & F.col("type").isNotNull()
    table = stats.filter(known).agg(F.map_from_entries(F.collect_list(F.struct(F.col("type").alias("key"), values.alias("value")))))
    everyone = stats.filter("overall = 1").select(values)
    s = F.coalesce(F.try_element_at(F.col("__t"), F.col("type")), F.col("__all"))
    return df.withColumns({"__t": table.scalar(), "__all": everyone.scalar()}).withColumns({
        "mean_t": s["mean"], "std_t": s["std"], "q95_t": s["q95"], "mean_all": F.col("__all.mean")}).drop("__t", "__all")


def rate_inputs(df: DataFrame) -> DataFrame:
    c = "consommation_kw"
    return over_series(df, METER, ORDER, lambda w: {"kw_diff": diff(w, c), "kw_rate": pct_change(w, c)}, back=1)


def enhanced_detection(df: DataFrame, error: str = "recon_error") -> DataFrame:
    """Seven weighted criteria per reading: scores, total, decision, leading criterion and confidence."""
    p95 = percentiles(df, [], {"p95": (error, 0.95)})
    df = rate_inputs(with_type_stats(temporal(df)))
    df = df.withColumn("__p95", p95.scalar())
    kw, v, a, hz = (F.col(c) for c in ("consommation_kw", "tension_v", "courant_a", "frequency_hz"))
    kind, hour = F.col("type"), F.col("hour")
    scores = {
        "reconstruction": reconstruction_criterion(F.col(error), F.col("__p95")),
        "voltage": voltage_rule(v)[0],
        "consumption": consumption_rule(kw, kind, hour, F.col("mean_t"), F.col("std_t"), F.col("q95_t"))[0],
        "power_factor": power_factor_rule(kw, v, a)[0],
        "frequency": frequency_rule(hz)[0],
        "temporal": temporal_rule(kw, kind, hour, F.col("is_weekend"), F.col("mean_all"))[0],
        "rate_change": rate_change_rule(F.col("kw_diff"), F.col("kw_rate"))[0],
    }
    df = df.withColumns({f"{n}_score": s for n, s in scores.items()})
    named = {n: F.col(f"{n}_score") for n in WEIGHTS}
    total_score = None
    for n, w in WEIGHTS.items():
        total_score = named[n] * w if total_score is None else total_score + named[n] * w
    df = df.withColumn("total_score", total_score).withColumn("is_anomaly", F.col("total_score") > ANOMALY_LEVEL)
    return df.withColumns({
        "anomaly_type": F.when(F.col("is_anomaly"), first_max_name(named)).otherwise("normal"),
        "confidence": F.when(F.col("is_anomaly"), F.greatest(*named.values())).otherwise(1.0 - F.col("total_score")),
    })


def anomaly_breakdown(detected: DataFrame) -> DataFrame:
    hits = detected.filter("is_anomaly").groupBy("anomaly_type").agg(F.count(F.lit(1)).alias("n"))
    return with_scalars(hits, hits.agg(F.sum("n").alias("all"))).select("anomaly_type", "n", (100.0 * F.col("n") / F.col("all")).alias("pct"))


def criterion_contribution(detected: DataFrame) -> DataFrame:
    cols = [f"{n}_score" for n in WEIGHTS]
    long = detected.select(*cols).unpivot([], cols, "criterion", "score")
    hit = (F.col("score") > 0.5).cast("long")
    return long.groupBy("criterion").agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"), F.max("score").alias("max"),
                                         F.sum(hit).alias("triggered"), (100.0 * F.avg(hit)).alias("triggered_pct"))


def domain_rules(v: Column, hz: Column, pf: Column) -> Column:
    hz, pf = F.coalesce(hz, F.lit(60.0)), F.coalesce(pf, F.lit(0.9))
    return F.array_compact(F.array(
        F.when(v < V_MIN, "Voltage_too_low").when(v > V_MAX, "Voltage_too_high"),
        F.when(hz < F_MIN, "Frequency_too_low").when(hz > F_MAX, "Frequency_too_high"),
        F.when(pf < PF_MIN, "Low_power_factor")))


# ---- thresholds ------------------------------------------------------------

def static_thresholds(normal: DataFrame, score: str, percentile: float = 0.95, k: float = 3.0) -> DataFrame:
    q = percentiles(normal, [], {"percentile_threshold": (score, percentile)})
    sigma = normal.agg((F.avg(score) + k * F.stddev_pop(score)).alias("sigma_threshold"))
    return with_scalars(sigma, q)


def threshold_strategies(normal: DataFrame, score: str) -> DataFrame:
    """p95, p99, median + 3·1.4826·MAD and mean + 3·std of the normal scores."""
    q = percentiles(normal, [], {"p95": (score, 0.95), "p99": (score, 0.99), "med": (score, 0.5)})
    away = with_scalars(normal.select(score), q.select("med")).withColumn("dev", F.abs(F.col(score) - F.col("med")))
    mad = percentiles(away, [], {"mad": ("dev", 0.5)})
    sigma = normal.agg((F.avg(score) + 3 * F.stddev_pop(score)).alias("adaptive"))
    out = with_scalars(with_scalars(sigma, q), mad)
    return out.select("p95", "p99", (F.col("med") + 3 * 1.4826 * F.col("mad")).alias("mad"), "adaptive")


def rolling_threshold(df: DataFrame, score: str, fallback: float, history: int = 500, least: int = 30, k: float = 3.0) -> DataFrame:
    """mean + k·std of the meter's previous scores; the fallback until enough are there."""
    def build(w: WindowSpec) -> dict[str, Column]:
        before = w.rowsBetween(-history, -1)
        own = F.avg(score).over(before) + k * F.stddev_pop(score).over(before)
        return {"threshold": F.when(F.count(score).over(before) >= least, own).otherwise(F.lit(fallback))}

    out = over_series(df, METER, ORDER, build, back=history)
    return out.withColumns({"is_anomaly": F.col(score) >= F.col("threshold"), "confidence": confidence(F.col(score), F.col("threshold"))})


def confidence(score: Column, threshold: Column) -> Column:
    return F.least(F.lit(1.0), score / F.greatest(threshold, F.lit(1e-9)))


class ThresholdState:
    """The last normal scores of one meter."""

    MIN_SAMPLES, K_SIGMA, HISTORY = 30, 3.0, 500

    def __init__(self) -> None:
        self.scores: deque[float] = deque(maxlen=self.HISTORY)
        self.known: np.ndarray | None = None  # the same scores as an array, until the next normal one

    def threshold(self, fallback: float) -> float:
        if len(self.scores) < self.MIN_SAMPLES:
            return fallback
        if self.known is None:
            self.known = np.fromiter(self.scores, dtype=float, count=len(self.scores))
        mean = self.known.sum() / len(self.known)
        gap = self.known - mean
        return float(mean + self.K_SIGMA * np.sqrt(gap.dot(gap) / len(gap)))

    def decide(self, score: float, fallback: float) -> tuple[float, bool]:
        """Threshold before this score, and whether it is reached; a normal score joins the history."""
        threshold = self.threshold(fallback)
        hit = score >= threshold
        if not hit:
            self.scores.append(score)
            self.known = None
        return threshold, hit


ADAPTIVE_SCHEMA = "meter_id string, event_id long, score double, threshold double, is_anomaly boolean, confidence double"


def decide_rows(state: ThresholdState, rows: Arrays, fallback: float) -> Arrays:
    scores = rows["score"]
    decided = [state.decide(float(x), fallback) for x in scores]
    thr = np.array([d[0] for d in decided])
    return {"meter_id": rows["meter_id"], "event_id": rows["event_id"], "score": scores, "threshold": thr,
            "is_anomaly": np.array([d[1] for d in decided]), "confidence": np.minimum(1.0, scores / np.maximum(thr, 1e-9))}


def adaptive_threshold(df: DataFrame, fallback: float, warmup: int = 4 * ThresholdState.HISTORY) -> DataFrame:
    """Per-meter threshold fed by the meter's own normal decisions.

    Each decision depends on the ones before it. A meter's rows stream through one task with 500 numbers of
    state; meters too large for that run as slices, see ``_sliced_adaptive``.
    """
    rows = df.select("meter_id", "event_id", "ts", F.col("score").cast("double").alias("score"))
    sliced = slice_series(rows, METER, ORDER, back=warmup, sized_by=df)
    if sliced.split:
        return _sliced_adaptive(sliced.frame, fallback)
    return ordered_fold(rows, METER, ORDER, ThresholdState, lambda s, rows: decide_rows(s, rows, fallback), ADAPTIVE_SCHEMA)


class SliceState(ThresholdState):
    """State inside one slice: which scores it was entered with, and how many pieces were seen."""

    def __init__(self) -> None:
        super().__init__()
        self.entered: list[float] | None = None
        self.pieces = 0


SLICED_SCHEMA = f"{ADAPTIVE_SCHEMA}, slice long, piece int, entered array<double>, left array<double>"


def _decide_slice(state: SliceState, rows: Arrays, fallback: float) -> Arrays:
    """Decisions of the slice's own rows, and one more row with the state it was entered with and left in."""
    kept, thresholds, hits, entered = [], [], [], None
    for i, (seed, halo, score) in enumerate(zip(rows["seed"], rows[HALO].tolist(), rows["score"].tolist())):
        if seed is not None:
            state.scores.extend(float(x) for x in seed)
            state.known = None
            continue
        if not halo and state.entered is None:
            state.entered = entered = list(state.scores)
        threshold, hit = state.decide(score, fallback)
        if not halo:
            kept.append(i)
            thresholds.append(threshold)
            hits.append(hit)
    n = len(kept)
    thr, score = np.array([*thresholds, 0.0]), np.array([*rows["score"][kept], 0.0])
    lists = {"entered": np.full(n + 1, None, dtype=object), "left": np.full(n + 1, None, dtype=object)}
    lists["entered"][n], lists["left"][n] = entered, list(state.scores)
    state.pieces += 1
    return {"meter_id": rows["meter_id"][[*kept, 0]], "event_id": np.array([*rows["event_id"][kept], 0], dtype="int64"), "score": score,
            "threshold": thr, "is_anomaly": np.array([*hits, False]), "confidence": np.minimum(1.0, score / np.maximum(thr, 1e-9)),
            "slice": rows[SLICE][[*kept, 0]], "piece": np.array([*([-1] * n), state.pieces], dtype="int32"), **lists}


def _sliced_adaptive(frame: DataFrame, fallback: float) -> DataFrame:
    """The same decisions with large meters cut into slices that run in parallel.

    A slice first replays its halo rows, which normally brings it to the true state. Whether it
    did is checked exactly: the scores it was entered with must be the ones its predecessor was left with.
    Slices that fail start again from their predecessor's state, until all agree; the first failing slice
    of a meter is right after every round, so the rounds end.
    """
    keys = ["meter_id", SLICE]
    base = frame.select(
        *keys, HALO, "ts", "event_id", "score", F.lit(None).cast("array<double>").alias("seed"))

    def run(frame: DataFrame, number: int) -> DataFrame:
        folded = ordered_fold(frame, keys, ORDER, SliceState, lambda s, part: _decide_slice(s, part, fallback), SLICED_SCHEMA)
        return stored(folded.withColumnRenamed("slice", SLICE).withColumn("round", F.lit(number)), "adaptive")

    def ends(results: DataFrame) -> DataFrame:
        return results.filter("piece >= 0").groupBy(*keys, "round").agg(
            F.max_by("entered", F.when(F.col("entered").isNotNull(), -F.col("piece"))).alias("entered"), F.max_by("left", "piece").alias("left"))

    rounds = [run(base, 0)]
    states = stored(ends(rounds[0]), "adaptive-states")
    while True:
        before = F.lag("left").over(Window.partitionBy("meter_id").orderBy(SLICE))
        wrong = stored(states.withColumn("seed", before).filter(F.col("seed").isNotNull() & (F.col("seed") != F.col("entered"))).select(*keys, "seed"), "adaptive-wrong")
        if wrong.isEmpty():
            break
        marks = wrong.select(*keys, F.lit(True).alias(HALO), F.lit(None).cast(dict(base.dtypes)["ts"]).alias("ts"),
                             F.lit(0).cast("long").alias("event_id"), F.lit(0.0).alias("score"), "seed")
        again = null_safe_join(base.filter(~F.col(HALO)), wrong.select(*keys), keys, "left_semi").unionByName(marks)
        rounds.append(run(again, len(rounds)))
        states = stored(null_safe_join(states, wrong.select(*keys), keys, "left_anti").unionByName(ends(rounds[-1])), "adaptive-states")
    names = [c.split()[0] for c in ADAPTIVE_SCHEMA.split(", ")]
    out = None
    for results in rounds:
        part = null_safe_join(results.filter("piece < 0"), states.select(*keys, "round"), [*keys, "round"], "left_semi").select(*names)
        out = part if out is None else out.unionByName(part)
    return out


def global_threshold(df: DataFrame, bootstrap: float, pool: int = 5000, least: int = 200, every: int = 50, p: float = 98.0) -> DataFrame:
    """Cold-start threshold: percentile of the latest scores of all meters, refreshed as the pool fills.

    The pool reaches back a fixed number of rows, so a slice of the timeline with its halo is enough.
    """
    s = slice_series(df.select("event_id", "ts", "score"), [], ORDER, back=pool, sized_by=df)
    frame = s.frame if s.split else s.frame.withColumns({SLICE: F.lit(0).cast("long"), HALO: F.lit(False)})
    frame = frame.select("event_id", "ts", "score", SLICE, HALO)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, recent, ordered, threshold = None, deque(), [], bootstrap
        for batch in batches:
            out = np.empty(len(batch))
            for i, (piece, score) in enumerate(zip(batch[SLICE].to_numpy(), batch["score"].to_numpy())):
                if piece != current:
                    current, recent, ordered, threshold = piece, deque(), [], bootstrap
                out[i] = threshold
                if len(recent) == pool:
                    ordered.pop(bisect.bisect_left(ordered, recent.popleft()))
                recent.append(score)
                bisect.insort(ordered, score)
                n = len(ordered)
                if n >= least and n % every == 0:
                    at = (n - 1) * p / 100.0
                    low = int(at)
                    high = min(low + 1, n - 1)
                    threshold = ordered[low] + (ordered[high] - ordered[low]) * (at - low)
            core = ~batch[HALO].to_numpy()
            yield pd.DataFrame({"event_id": batch["event_id"].to_numpy()[core], "score": batch["score"].to_numpy()[core], "threshold": out[core]})

    ready = frame.repartition(SLICE).sortWithinPartitions(SLICE, *ORDER)
    return ready.mapInPandas(run, "event_id long, score double, threshold double")


# ---- classification, ensemble, alerts --------------------------------------

def classify_attack(top: Column, kw: Column, v: Column, a: Column) -> Column:
    """Attack class from the names of the leading features (most important first) and the raw reading."""
    lead = F.exists(F.slice(top, 1, 2), lambda x: x.contains("tension"))
    load = F.array_contains(top, "zone_consumption_mean") | F.array_contains(top, "consommation_kw_diff")
    kva = v * a / 1000.0
    pf = F.when(kva > 0, kw / kva).otherwise(1.0)
    return (F.when(lead, "fdia").when(load & (kw > 5.0) & (pf < 0.5), "fraud")
            .when((v < 180.0) | (a > 50.0), "fault").otherwise("dos"))


def ensemble(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """The first detector raises the alarm, the second one grades it; scores are averaged."""
    both = first.join(second, key)
    blended = 0.5 * F.col("score") + 0.5 * F.col("score_b")
    alarm, agree = F.col("score") >= F.col("threshold"), F.col("score_b") >= F.col("threshold_b")
    return both.select(key, alarm.alias("is_anomaly"), F.when(alarm & agree, "HIGH").when(alarm, "MEDIUM").otherwise("NONE").alias("confidence_label"),
                       blended.alias("anomaly_score"), confidence(blended, F.col("threshold")).alias("confidence"))


def alert_cooldown(alerts: DataFrame, key: str, ts: str, ident: str, cooldown_s: int) -> DataFrame:
    """Which alerts pass when a key stays silent for ``cooldown_s`` after each alert it emitted.

    An alert at least one cooldown after its predecessor always passes, so the runs between such gaps are independent. Runs that one
    task can hold are gone through in order; a larger run (a key that is never silent) is resolved by ``_orbit``.
    """
    step = cooldown_s * 1_000_000
    timed = alerts.select(key, ident, ts, micros(ts).alias("us"))
    runs = islands(timed, [key], [ts, ident], lambda w: F.col("us") - F.lag("us").over(w) >= step, out="run").select(key, "run", "us", ident)
    kind = dict(alerts.dtypes)

    def fold(state: LastEmitted, rows: Arrays) -> Arrays:
        return {key: rows[key], ident: rows[ident], "emitted": emit_with_cooldown(state, rows["us"], step)}

    def in_order(rows: DataFrame) -> DataFrame:
        return ordered_fold(rows, [key, "run"], ["us", ident], LastEmitted, fold, f"{key} {kind[key]}, {ident} {kind[ident]}, emitted boolean")

    if fits_one_task(alerts):
        return in_order(runs)
    runs = stored(runs, "alert-runs")
    large = stored(runs.groupBy(key, "run").agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > split_rows(alerts)).drop("__n"), "large-runs")
    if large.isEmpty():
        return in_order(runs)
    hot = null_safe_join(runs, large, [key, "run"], "left_semi")
    return in_order(null_safe_join(runs, large, [key, "run"], "left_anti")).unionByName(_orbit(hot, key, ident, step))


def _orbit(runs: DataFrame, key: str, ident: str, step: int) -> DataFrame:
    """Cooldown of runs of any size: what the first alert of a run reaches by going to the next alert out of cooldown.

    Each alert points to the first one at least ``step`` later; pointers come from one pass that carries alerts back in time. They
    are doubled each round, so the alerts that pass are found in as many rounds as the logarithm of the longest chain, by joins on the
    alert and without any fold.
    """
    node = [key, ident]
    alerts = runs.select(key, ident, (-F.col("us")).alias("__back"), F.lit(0).alias("__kind"), F.struct("us", F.col(ident).alias("id")).alias("__at"))
    asks = runs.select(key, ident, (-F.col("us") - step).alias("__back"), F.lit(1).alias("__kind"), F.lit(None).cast(alerts.schema["__at"].dataType).alias("__at"))
    # at one time the alerts come first, the smallest id last, so that the question meets it
    both = alerts.unionByName(asks).withColumn("__order", -F.col(ident).cast("long"))
    seen = carry_forward(both, [key], ["__back", "__kind", "__order"], {"__next": F.col("__at")}, sized_by=runs)
    hops = stored(seen.filter("__kind = 1").select(*node, F.col("__next.id").alias("__to")).filter("__to is not null"), "hops")
    first = runs.groupBy(key, "run").agg(F.min_by(ident, F.struct("us", ident)).alias(ident))
    reached = stored(first.select(*node), "reached")
    while not hops.isEmpty():
        stepped = null_safe_join(reached, hops, node).select(key, F.col("__to").alias(ident))
        reached = stored(reached.unionByName(stepped).distinct(), "reached")
        after = hops.select(key, F.col(ident).alias("__to"), F.col("__to").alias("__then"))
        hops = stored(null_safe_join(hops, after, [key, "__to"]).select(*node, F.col("__then").alias("__to")), "hops")
    found = null_safe_join(runs.select(*node), reached.withColumn("emitted", F.lit(True)), node, "left")
    return found.withColumn("emitted", F.coalesce("emitted", F.lit(False)))


def bus_confidence(attack_type: Column) -> Column:
    return F.when(attack_type == "fdia", 0.8).otherwise(0.7)


def severity(conf: Column) -> Column:
    return F.when(conf > 0.8, "critical").otherwise("warning")


def rate_violations(df: DataFrame, client: str, ts: str, ident: str, window_s: int, limit: int) -> DataFrame:
    """Requests that are beyond ``limit`` in the trailing window of their client."""
    span = window_s * 1_000_000
    rows = df.select(client, ident, ts, micros(ts).alias("us"))
    if fits_one_task(df):
        w = Window.partitionBy(client).orderBy("us").rangeBetween(-span, 0)
        return rows.withColumn("recent", F.count(F.lit(1)).over(w)).filter(F.col("recent") > limit).drop("us")
    # requests in force: counts that come in at their instant and go out a window later, as running sums
    counted = rows.groupBy(client, "us").agg(F.count(F.lit(1)).alias("c"))
    points = counted.select(client, "us", F.lit(0).alias("kind"), "c").unionByName(
        counted.select(client, (F.col("us") + span).alias("us"), F.lit(1).alias("kind"), (-F.col("c")).alias("c")))
    in_force = running(points, [client], ["us", "kind"], {"recent": F.col("c")}, sized_by=df).filter("kind = 0").select(client, "us", "recent")
    return null_safe_join(rows, in_force, [client, "us"]).filter(F.col("recent") > limit).drop("us")


def allow(hits: deque, now: int, span: int, limit: int) -> bool:
    """Whether a request passes; only passed ones stay in ``hits``."""
    while hits and now - hits[0] > span:
        hits.popleft()
    if len(hits) >= limit:
        return False
    hits.append(now)
    return True


def rate_limit_exact(df: DataFrame, client: str, ts: str, ident: str, window_s: int, limit: int) -> DataFrame:
    """The limiter itself: rejected requests do not count against the client.

    A pause longer than the window empties it, so the runs between such pauses are independent.
    """
    return rate_limit_budgets(df.withColumn("__path", F.lit("")), client, ts, ident, "__path", window_s, limit, {}).select(client, ident, "allowed")


def with_budget(df: DataFrame, path: str, limit: int, own: dict[str, int], exempt: tuple[str, ...]) -> DataFrame:
    """``__budget`` (a path with a limit of its own, else empty; null for exempt paths) and ``__limit`` of each request."""
    budget, most = F.lit(""), F.lit(limit)
    for name, n in own.items():
        budget, most = F.when(F.col(path) == name, F.lit(name)).otherwise(budget), F.when(F.col(path) == name, F.lit(n)).otherwise(most)
    free = F.coalesce(F.col(path).isin(*exempt), F.lit(False)) if exempt else F.lit(False)
    return df.withColumns({"__budget": F.when(~free, budget), "__limit": most})


def rate_limit_budgets(df: DataFrame, client: str, ts: str, ident: str, path: str, window_s: int, limit: int, own: dict[str, int],
                       exempt: tuple[str, ...] = ()) -> DataFrame:
    """(client, id, budget, allowed): paths in ``own`` have a limit and a window of their own, exempt paths always pass and count nowhere.

    A null path counts against the common budget, a null client is a client.
    """
    span = window_s * 1_000_000
    kind = dict(df.dtypes)

    def fold(hits: deque, rows: Arrays) -> Arrays:
        allowed = np.array([allow(hits, now, span, most) for now, most in zip(rows["us"].tolist(), rows["__limit"].tolist())], dtype=bool)
        return {client: rows[client], ident: rows[ident], "budget": rows["__budget"], "allowed": allowed}

    rows = with_budget(df.select(client, ident, ts, path, micros(ts).alias("us")), path, limit, own, exempt).drop(path)
    runs = islands(rows.filter("__budget is not null"), [client, "__budget"], [ts, ident], lambda w: F.col("us") - F.lag("us").over(w) > span, out="run").drop(ts)
    judged = ordered_fold(runs, [client, "__budget", "run"], ["us", ident], deque, fold, f"{client} {kind[client]}, {ident} {kind[ident]}, budget string, allowed boolean")
    if not exempt:
        return judged
    return judged.unionByName(rows.filter("__budget is null").select(client, ident, F.lit(None).cast("string").alias("budget"), F.lit(True).alias("allowed")))


# ---- explanations ----------------------------------------------------------

def z_scores(df: DataFrame, columns: list[str]) -> DataFrame:
    stats = with_scalars(df, scaler_stats(df, columns), "__")
    z = {f"{c}_z": F.coalesce(F.try_divide(F.col(c) - F.col(f"__{c}_mean"), F.col(f"__{c}_scale")), F.lit(0.0)) for c in columns}
    return stats.withColumns(z).drop(*[f"__{c}_{s}" for c in columns for s in ("mean", "scale")])


def ranked_contributions(columns: list[str]) -> Column:
    """Array of (contribution, feature), largest first; contribution is the squared deviation in sigmas."""
    items = F.array(*[F.struct((-F.pow(F.col(f"{c}_z"), 2)).alias("neg"), F.lit(c).alias("feature")) for c in columns])
    return F.transform(F.array_sort(items), lambda x: F.struct(x["feature"].alias("feature"), (-x["neg"]).alias("contribution")))


def global_importance(df: DataFrame, columns: list[str]) -> DataFrame:
    z = z_scores(df, columns)
    wide = z.agg(*[F.avg(F.abs(F.col(f"{c}_z"))).alias(c) for c in columns])
    return wide.unpivot([], columns, "feature", "importance").orderBy(F.desc("importance"))


def critical_timesteps(errors: Column, k: int = 3) -> Column:
    """0-based positions of the largest step errors of a window, largest first."""
    items = F.transform(errors, lambda x, i: F.struct((-x).alias("neg"), i.alias("i")))
    return F.slice(F.transform(F.array_sort(items), lambda s: s["i"]), 1, k)
