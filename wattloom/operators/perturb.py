"""Perturbations, imputation studies and what-if overlays. Random draws come from row ids."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, WindowSpec, functions as F

from ..functions.expr import mix_factor, MIX_MODULUS, mix_uniform
from .features import METER, ORDER
from .quantiles import with_scalars
from .series import carry_forward, ordinal, over_series, running


def gaussian(ident: str, seed: int) -> Column:
    """Standard normal from two id-mixed uniforms."""
    u, v = mix_uniform(ident, seed) + 0.5 / MIX_MODULUS, mix_uniform(ident, seed + 1)
    return F.sqrt(-2.0 * F.log(u)) * F.cos(2 * math.pi * v)


def missing_imputations(df: DataFrame, value: str, frac: float, seed: int, ident: str = "event_id") -> DataFrame:
    """The value after masking a share of the cells and filling them in four ways.

    Forward fill and neighbour average keep the first reading of a meter, the latter also the last one.
    """
    df = df.withColumn("masked", mix_uniform(ident, seed) < frac)
    mean = df.agg(F.avg(value))
    near = over_series(df, METER, ORDER, lambda w: {"__prev": F.lag(value).over(w), "__next": F.lead(value).over(w)}, back=1, ahead=1)
    mask, first = F.col("masked"), F.col("__prev").isNull()
    edge = first | F.col("__next").isNull()
    out = near.withColumns({
        "zero": F.when(mask, 0.0).otherwise(F.col(value)),
        "mean": F.when(mask, mean.scalar()).otherwise(F.col(value)),
        "neighbours": F.when(mask & ~edge, (F.col("__prev") + F.col("__next")) / 2.0).otherwise(F.col(value)),
        "__kept": F.when(~mask | first, F.col(value)),
    })
    return carry_forward(out, METER, ORDER, {"ffill": F.col("__kept")}, sized_by=df).drop("__prev", "__next", "__kept")


def packet_loss(df: DataFrame, values: list[str], frac: float, seed: int, ident: str = "event_id") -> DataFrame:
    """Lost readings repeat the last delivered one; 0 before the first delivery."""
    df = df.withColumn("lost", mix_uniform(ident, seed) < frac)
    held = carry_forward(df, METER, ORDER, {f"__{v}": F.when(~F.col("lost"), F.col(v)) for v in values})
    return held.withColumns({v: F.coalesce(F.col(f"__{v}"), F.lit(0.0)) for v in values}).drop(*[f"__{v}" for v in values])


def quantize(value: Column, step: float) -> Column:
    step = max(step, 1e-6)
    return F.rint(value / step) * step


def with_step(df: DataFrame, length: int, out: str = "step") -> DataFrame:
    """0-based position inside consecutive windows of ``length`` rows of a meter."""
    return ordinal(df, METER, ORDER, rn="__rn").withColumn(out, (F.col("__rn") - 1) % length).drop("__rn")


def ramp(step: Column, length: int, magnitude: float) -> Column:
    return step * (magnitude / (length - 1))


def sensor_failure(df: DataFrame, targets: list[str]) -> DataFrame:
    return df.withColumns({t: F.lit(0.0) for t in targets})


def random_channel(channels: list[str], seed: int) -> str:
    """The channel that a seed lets fail."""
    return channels[mix_factor(seed) % MIX_MODULUS % len(channels)]


def sensor_spike(value: Column, ident: str, magnitude: float, seed: int, share: float = 0.02) -> Column:
    return value + F.when(mix_uniform(ident, seed) < share, gaussian(ident, seed + 2) * (magnitude * 5)).otherwise(0.0)


def jitter_pairs(df: DataFrame, values: list[str], prob: float, seed: int, ident: str = "event_id") -> DataFrame:
    """Swap the values of neighbouring readings (1st with 2nd, 3rd with 4th ...) with probability ``prob``."""
    df = ordinal(df, METER, ORDER, rn="__rn").withColumn("__u", mix_uniform(ident, seed))

    def build(w: WindowSpec) -> dict[str, Column]:
        out = {"__pu": F.lag("__u").over(w), "__nid": F.lead(ident).over(w)}
        for v in values:
            out |= {f"__p_{v}": F.lag(v).over(w), f"__n_{v}": F.lead(v).over(w)}
        return out

    near = over_series(df, METER, ORDER, build, back=1, ahead=1)
    odd = F.col("__rn") % 2 == 1
    with_next = odd & (F.col("__u") < prob) & F.col("__nid").isNotNull()
    with_prev = ~odd & (F.col("__pu") < prob)
    swapped = {v: F.when(with_next, F.col(f"__n_{v}")).when(with_prev, F.col(f"__p_{v}")).otherwise(F.col(v)) for v in values}
    return near.withColumns(swapped).drop("__rn", "__u", "__pu", "__nid", *[f"__{s}_{v}" for v in values for s in ("p", "n")])


def concept_drift(df: DataFrame, values: list[str], label: str, level: float) -> DataFrame:
    """Attack rows move toward the normal mean; level 0 changes nothing, level 1 hides them."""
    means = df.filter(F.col(label) == 0).agg(*[F.avg(v).alias(v) for v in values])
    out = with_scalars(df, means, "__m_")
    return out.withColumns({
        v: F.when(F.col(label) == 1, F.col(v) * (1 - level) + F.coalesce(F.col(f"__m_{v}"), F.col(v)) * level).otherwise(F.col(v)) for v in values
    }).drop(*[f"__m_{v}" for v in values])


def unknown_attack(step: Column, value: Column, kind: str, length: int, sign: int = 1) -> Column:
    """Attack shapes outside the known ones, on a standardised value."""
    if kind == "slow_ramp":
        return value + ramp(step, length, 2.0)
    if kind == "combined_inverse":
        return value + sign * 1.5
    return value + 0.8 * F.sin(2 * math.pi * step / 3)


def out_of_distribution(value: Column, ident: str, level: float, seed: int) -> Column:
    return value + F.when(mix_uniform(ident, seed) < 0.5, -level).otherwise(level)


# ---- overlays --------------------------------------------------------------

OVERLAY = "struct<start_ts:timestamp_ntz,duration_s:long,magnitude:double,attack_id:long,attack_type:string>"


def attack_overlay(readings: DataFrame, attacks: DataFrame) -> DataFrame:
    """Change the readings a bus sends while its latest attack lasts: ``fdia`` scales the measures, ``dos`` only marks them.

    A new attack replaces the one before it, so each reading needs the latest start on its bus only: both
    tables are laid along the bus's time and the last attack is carried forward. No pairs are formed. Attacks of other types are
    reported as active and change nothing.
    """
    own = F.col("attack_type") if "attack_type" in readings.columns else F.lit("normal")
    rows = readings.withColumns({"__kind": F.lit(1), "__attack": F.lit(None).cast(OVERLAY), "attack_type": own})
    marks = attacks.select("bus_id", F.col("start_ts").alias("ts"), F.col("attack_id").alias("event_id"), F.lit(0).alias("__kind"),
                           F.struct("start_ts", "duration_s", "magnitude", "attack_id", "attack_type").cast(OVERLAY).alias("__attack"))
    both = rows.unionByName(marks, allowMissingColumns=True)
    out = carry_forward(both, ["bus_id"], ["ts", "__kind", "event_id"], {"__last": F.col("__attack")}, sized_by=readings).filter("__kind = 1")
    last = F.col("__last")
    age = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(last["start_ts"].cast("timestamp"))
    active = F.coalesce(age <= last["duration_s"] * 1_000_000, F.lit(False))
    kind = F.when(active, last["attack_type"])
    m = F.when(kind == "fdia", last["magnitude"]).otherwise(0.0)
    return out.withColumns({
        "active_attack": F.when(active, last["attack_id"]).otherwise(F.lit(-1).cast("long")),
        "tension_v": F.col("tension_v") * (1.0 + m * 0.2),
        "consommation_kw": F.col("consommation_kw") * (1.0 + m),
        "courant_a": F.col("courant_a") * (1.0 + m),
        "attack_type": F.when(kind.isin("fdia", "dos"), kind).otherwise(F.col("attack_type")),
    }).drop("__kind", "__attack", "__last")


def active_overlays(readings: DataFrame, attacks: DataFrame) -> DataFrame:
    """How many attacks are running on the bus at each reading: starts minus ends, as running sums."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    start = F.unix_micros(F.col("start_ts").cast("timestamp"))
    points = (
        readings.select("bus_id", us.alias("us"), F.lit(1).alias("kind"), "event_id", F.lit(0).cast("long").alias("step"))
        .unionByName(attacks.select("bus_id", start.alias("us"), F.lit(0).alias("kind"), F.col("attack_id").alias("event_id"), F.lit(1).cast("long").alias("step")))
        .unionByName(attacks.select("bus_id", (start + F.col("duration_s") * 1_000_000).alias("us"), F.lit(2).alias("kind"),
                                    F.col("attack_id").alias("event_id"), F.lit(-1).cast("long").alias("step")))
    )
    out = running(points, ["bus_id"], ["us", "kind", "event_id"], {"active": F.col("step")}, sized_by=readings)
    return out.filter("kind = 1").select("event_id", "bus_id", "active")


# fixed values: per scheduled label the range each measure's factor or value is drawn from
SIGNATURES = {
    "Surcharge": {"consommation_kw": ("scale", 1.6, 2.6), "courant_a": ("scale", 1.6, 2.6), "tension_v": ("minus", 3.0, 10.0), "frequency_hz": ("minus", 0.10, 0.35)},
    "Tension hors norme": {"tension_v": ("either", (185.0, 205.0), (248.0, 265.0))},
    "Pic soudain": {"consommation_kw": ("scale", 2.0, 4.0), "courant_a": ("scale", 2.0, 4.0), "frequency_hz": ("minus", 0.05, 0.25)},
    "Consommation nulle suspecte": {"consommation_kw": ("value", 0.0, 0.12), "courant_a": ("value", 0.0, 0.6), "power_factor": ("value", 0.50, 0.75)},
    "Fraude": {"consommation_kw": ("scale", 0.20, 0.55), "courant_a": ("scale", 0.20, 0.55), "power_factor": ("value", 0.55, 0.80)},
}


def signature_overlay(readings: DataFrame, schedule: DataFrame, seed: int = 3) -> DataFrame:
    """Apply the electrical signature of the attack scheduled for (ts, meter); of several the first by name."""
    schedule = schedule.groupBy("ts", "meter_id").agg(F.min("attack").alias("attack"))
    out = readings.join(schedule, ["ts", "meter_id"], "left")
    u = mix_uniform("event_id", seed)
    columns = sorted({c for sig in SIGNATURES.values() for c in sig})
    changed = {}
    for c in columns:
        expr = F.col(c)
        for label, sig in SIGNATURES.items():
            if c in sig:
                kind, lo, hi = sig[c]
                if kind == "either":
                    new = F.when(u < 0.5, lo[0] + (lo[1] - lo[0]) * u * 2).otherwise(hi[0] + (hi[1] - hi[0]) * (u * 2 - 1))
                else:
                    draw = lo + (hi - lo) * u
                    new = {"scale": F.col(c) * draw, "minus": F.col(c) - draw, "value": draw}[kind]
                expr = F.when(F.col("attack") == label, new).otherwise(expr)
        changed[c] = expr
    # out-of-range voltage: the current follows from power and the new voltage
    changed["courant_a"] = F.when(F.col("attack") == "Tension hors norme", F.col("consommation_kw") * 1000.0 / F.greatest(changed["tension_v"], F.lit(1.0))).otherwise(changed["courant_a"])
    changed["statut"] = F.when(F.col("attack").isNotNull(), "ALERTE").otherwise("NORMAL")
    return out.withColumns(changed)


def stealth_overlay(df: DataFrame, length: int = 20) -> DataFrame:
    """Consumption and voltage under the four scripted manipulations, by position in runs of 20 readings."""
    df = with_step(df, length)
    kw, v, a = F.col("consommation_kw"), F.col("tension_v"), F.col("courant_a")
    growth = 1.0 + F.col("step") * 0.03
    return df.withColumns({
        "naive_v": v * 1.25, "naive_kw": kw * 1.30, "naive_a": a * 1.20, "stealthy_v": v * 1.06,
        "ramp_kw": kw * growth, "ramp_a": a * growth, "coordinated_kw": kw * 1.20})


def active_incident(readings: DataFrame, incidents: DataFrame) -> DataFrame:
    """First incident (in list order) of the reading's zone whose hour window, maybe past midnight, is open.

    The catalogue of incident definitions is a hand-written list and travels as one array value.
    """
    listed = incidents.agg(F.array_sort(F.collect_list(F.struct("incident_id", "zone", "start_hour", "end_hour"))))
    hour = F.hour("ts")

    def open_now(i: Column) -> Column:
        inside = F.when(i["start_hour"] <= i["end_hour"], (hour >= i["start_hour"]) & (hour < i["end_hour"])).otherwise(
            (hour >= i["start_hour"]) | (hour < i["end_hour"]))
        return (i["zone"] == F.col("zone")) & inside

    out = readings.withColumn("__list", listed.scalar())
    first = F.try_element_at(F.filter("__list", open_now), F.lit(1))
    return out.withColumn("incident_id", F.coalesce(first["incident_id"], F.lit(0))).drop("__list")
