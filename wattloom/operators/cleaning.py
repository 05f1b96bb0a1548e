"""Cleaning, validation and normalisation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.expr import clip, col, dbl, div0
from .quantiles import percentiles, with_scalars

# fixed values: labels that mean "no anomaly"
NORMAL_LABELS = ["normal", "stable", "0", "false", "benign"]
# fixed values: security zone -> bus
ZONE_BUS = {"sector_a": 5, "sector_b": 8, "sector_c": 11, "sector_d": 14, "perimeter": 6, "garage": 4, "entrance": 3}
# fixed values: bounds of a live reading
READING_BOUNDS = {
    "consommation_kw": (0.0, 1e5),
    "tension_v": (0.0, 1000.0),
    "courant_a": (0.0, 1e5),
    "power_factor": (0.0, 1.2),
    "frequency_hz": (0.0, 100.0),
}
MEASURES = ["consommation_kw", "tension_v", "courant_a"]
NOMINAL_V = 230.0


def drop_incomplete(df: DataFrame, measures: list[str] = MEASURES) -> DataFrame:
    return df.dropna(subset=measures)


def sigma_clip(df: DataFrame, measures: list[str] = MEASURES, k: float = 5.0) -> DataFrame:
    """Keep rows within mean ± k·std, one measure after the other on what the last one left."""
    for m in measures:
        stats = df.agg(F.avg(m).alias("mean"), F.stddev_samp(m).alias("std"))
        lo, hi = F.col("__mean") - k * F.col("__std"), F.col("__mean") + k * F.col("__std")
        df = with_scalars(df, stats, "__").filter((F.col(m) >= lo) & (F.col(m) <= hi)).drop("__mean", "__std")
    return df


def median_fill(df: DataFrame, columns: list[str]) -> DataFrame:
    """Text that is no number becomes null, nulls become the column median."""
    numeric = df.withColumns({c: F.expr(f"try_cast(`{c}` AS double)") for c in columns})
    medians = percentiles(numeric, [], {c: (c, 0.5) for c in columns})
    filled = with_scalars(numeric, medians, "__med_")
    return filled.withColumns({c: F.coalesce(c, f"__med_{c}") for c in columns}).drop(*[f"__med_{c}" for c in columns])


def is_anomalous_label(label) -> Column:
    return (~F.lower(F.trim(col(label))).isin(NORMAL_LABELS)).cast("int")


def any_flag(flags: list) -> Column:
    return reduce(lambda a, b: F.greatest(a, b), [col(f).cast("int") for f in flags])


def clean_text(text, default: str = "") -> Column:
    trimmed = F.trim(col(text))
    return F.when(trimmed.isNull() | (trimmed == "") | (F.lower(trimmed) == "nan"), F.lit(default)).otherwise(trimmed)


def validation_reasons(bounds: dict[str, tuple[float, float]] = READING_BOUNDS, meter_id: str = "meter_id") -> Column:
    """Names of the violated checks of a reading."""
    checks = [F.when(~F.length(meter_id).between(1, 64) | F.col(meter_id).isNull(), F.lit(meter_id))]
    checks += [F.when(~F.col(c).between(lo, hi), F.lit(c)) for c, (lo, hi) in bounds.items()]
    return F.array_compact(F.array(*checks))


def with_reading_defaults(df: DataFrame) -> DataFrame:
    """Optional fields of a live reading get their defaults."""
    return df.withColumns({
        "power_factor": F.coalesce("power_factor", F.lit(0.9)),
        "frequency_hz": F.coalesce("frequency_hz", F.lit(60.0)),
    })


def union_timestamp(text, now: Column) -> Column:
    """Null means now, a number counts seconds since the epoch, anything else is parsed."""
    text = col(text)
    seconds = text.try_cast("double")
    parsed = F.when(seconds.isNotNull(), F.timestamp_seconds(seconds)).otherwise(F.try_to_timestamp(text))
    return F.when(text.isNull(), now.cast("timestamp")).otherwise(parsed).cast("timestamp_ntz")


def per_unit_voltage(volts) -> Column:
    """Values above 10 are volts, smaller ones are per unit already."""
    v = dbl(volts)
    return F.when(v > 10, v / NOMINAL_V).otherwise(v)


def zone_key(zone) -> Column:
    return F.translate(F.lower(F.trim(col(zone))), " -", "__")


def zone_bus(zone, mapping: dict[str, int] = ZONE_BUS) -> Column:
    """Bus of a zone text, null for unknown zones."""
    pairs = [x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))]
    return F.try_element_at(F.create_map(*pairs), zone_key(zone))


def meter_bus(meter_id) -> Column:
    """First run of digits if it names a bus 1..14, else bus 1."""
    n = F.regexp_extract(col(meter_id), r"(\d+)", 1).try_cast("int")
    return F.coalesce(F.when(n.between(1, 14), n), F.lit(1))


def bus_current(kw, per_unit) -> Column:
    v = dbl(per_unit)
    return F.when(v <= 0, 0.0).otherwise(dbl(kw) * 1000.0 / (NOMINAL_V * F.greatest(v, F.lit(0.1))))


def grid_state(df: DataFrame) -> DataFrame:
    """Bus-level reading rows (kW, per-unit volts, Hz) as grid state rows."""
    return df.select(
        "bus_id",
        F.round("voltage_pu", 4).alias("voltage"),
        F.round(bus_current("consumption_kw", "voltage_pu"), 2).alias("current"),
        F.round("frequency_hz", 3).alias("frequency"),
        F.round("consumption_kw", 3).alias("consumption"),
        "consumer_type",
        F.when(F.col("attack_type") == "attack", "fdia").otherwise(F.col("attack_type")).alias("attack_type"),
        *[c for c in df.columns if c in ("event_id", "ts")],
    )


def clamp_severity(severity) -> Column:
    return clip(dbl(severity), 0.01, 1.0)


def severity_class(severity) -> Column:
    return F.when(clamp_severity(severity) < 0.75, "fdia").otherwise("dos")


def zone_event_state(df: DataFrame) -> DataFrame:
    """Security events (zone, motion, severity, optional volts and kW) as bus rows; unknown zones drop out."""
    sev, motion = clamp_severity("severity"), F.col("motion_detected")
    volts = F.coalesce("voltage_v", F.when(motion, 228.0).otherwise(230.0))
    kw = F.coalesce("consumption_kw", F.when(motion, F.round(2.0 + 8.0 * sev, 3)).otherwise(1.2))
    return df.withColumn("bus_id", zone_bus("zone")).filter("bus_id is not null").select(
        "event_id",
        "bus_id",
        F.round(per_unit_voltage(volts), 4).alias("voltage"),
        F.round(F.when(motion, kw * 1000.0 / F.greatest(volts, F.lit(1.0))).otherwise(2.5), 2).alias("current"),
        kw.alias("consumption"),
        F.when(motion, severity_class("severity")).otherwise("normal").alias("attack_type"),
        F.when(motion, F.round(0.5 + 0.5 * sev, 2)).alias("confidence"),
        F.when(motion, F.round(10.0 + 40.0 * sev, 1)).alias("duration_s"),
    )


def complete_domain(df: DataFrame, domain: DataFrame, key: str, defaults: dict[str, Column]) -> DataFrame:
    """Every key of the small domain table appears; missing ones carry the defaults."""
    joined = domain.join(df, key, "left")
    return joined.withColumns({c: F.coalesce(F.col(c), d) for c, d in defaults.items()})


def merge_sources(clean: DataFrame, attack: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """Clean rows tagged normal, attack rows tagged attack unless typed, absent columns filled."""
    clean = clean.withColumn("attack_type", F.lit("normal"))
    if "attack_type" not in attack.columns:
        attack = attack.withColumn("attack_type", F.lit("attack"))
    both = clean.unionByName(attack, allowMissingColumns=True)
    for c, d in defaults.items():
        both = both.withColumn(c, d if c not in both.columns else F.coalesce(F.col(c), d))
    return both


def insert_ignore(target: DataFrame, batch: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Rows of the batch with a new key (first one in ``order`` wins) appended to the target."""
    packed = F.struct(*batch.columns)
    first = batch.groupBy(key).agg(F.min_by(packed, F.struct(*order)).alias("r")).select("r.*")
    return target.unionByName(first.join(target.select(key), key, "left_anti"))


def upsert(target: DataFrame, batch: DataFrame, key: str, order: list[str] | None = None) -> DataFrame:
    """Update by key where the batch has a value, keep the old one where it is null, insert new keys.

    Of repeated keys in the batch the last row in ``order`` wins (without one, the largest by its values).
    """
    values = [c for c in target.columns if c != key]
    batch = batch.groupBy(key).agg(F.max_by(F.struct(*values), F.struct(*(order or values))).alias("r")).select(key, "r.*")
    new = batch.select(key, *[F.col(c).alias(f"__new_{c}") for c in values])
    joined = target.join(new, key, "full")
    return joined.select(key, *[F.coalesce(f"__new_{c}", c).alias(c) for c in values])
