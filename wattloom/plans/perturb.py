"""Perturbation, imputation-study and overlay queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expr import MIX_MODULUS, r
from ..operators import features as f, perturb as p
from ..operators.evaluate import curve_areas
from ..operators.detect import z_scores
from ..sources.readings import Tables
from .evaluate import auc_sql
from .registry import R, mix, query, view

KW, V, A = "consommation_kw", "tension_v", "courant_a"
MINI = ["event_id", "ts", "meter_id", KW, V, A]
W = "WINDOW w AS (PARTITION BY meter_id ORDER BY ts, event_id)"


def gauss(seed: int) -> str:
    return f"(sqrt(-2 * ln({mix(seed)} + 0.5::double / {MIX_MODULUS})) * cos(2 * pi() * {mix(seed + 1)}))"


@query("impute_compare", f"""
WITH a AS (SELECT event_id, ts, meter_id, {KW} AS x, {mix(1)} < 0.2::double AS masked, lag({KW}) OVER w AS px, lead({KW}) OVER w AS nx, row_number() OVER w AS rn, avg({KW}) OVER () AS mu FROM readings {W})
SELECT event_id, masked, {R('CASE WHEN masked THEN 0 ELSE x END')} AS zero, {R('CASE WHEN masked THEN mu ELSE x END')} AS mean,
  {R('CASE WHEN masked AND px IS NOT NULL AND nx IS NOT NULL THEN (px + nx) / 2 ELSE x END')} AS neighbours,
  {R('last_value(CASE WHEN NOT masked OR rn = 1 THEN x END IGNORE NULLS) OVER (PARTITION BY meter_id ORDER BY ts, event_id)')} AS ffill FROM a""")
def impute_compare(t: Tables):
    out = p.missing_imputations(t.readings.select(*MINI), KW, 0.2, 1)
    return out.select("event_id", "masked", *[r(c).alias(c) for c in ("zero", "mean", "neighbours", "ffill")])


@query("noise", f"SELECT event_id, {R(f'{KW} + 0.05 * {gauss(11)}')} AS {KW} FROM readings")
def noise(t: Tables):
    return t.readings.select("event_id", r(F.col(KW) + 0.05 * p.gaussian("event_id", 11)).alias(KW))


@query("sensor_noise", f"""SELECT event_id, {R(f'{KW} + 0.3 * ({mix(21, 'cast(substr(meter_id, 4) as bigint)')} - 0.5)')} AS offset_kw,
  {R(f'{V} + CASE WHEN {mix(21)} < 0.02::double THEN {gauss(23)} * 5 ELSE 0 END')} AS spike_v FROM readings""")
def sensor_noise(t: Tables):
    # one offset per sensor, spikes on two percent of the readings
    sensor = F.substring("meter_id", 4, 10).cast("long")
    return t.readings.select("event_id", r(F.col(KW) + 0.3 * (p.mix_uniform(sensor, 21) - 0.5)).alias("offset_kw"),
                             r(p.sensor_spike(F.col(V), "event_id", 1.0, 21)).alias("spike_v"))


@query("quantize", f"SELECT event_id, {R(f'round_even({KW} / 0.25, 0) * 0.25')} AS {KW}, {R(f'round_even({V} / 3, 0) * 3')} AS {V} FROM readings")
def quantize(t: Tables):
    return t.readings.select("event_id", r(p.quantize(F.col(KW), 0.25)).alias(KW), r(p.quantize(F.col(V), 3.0)).alias(V))


@query("drift_ramp", f"SELECT event_id, {R(f'{KW} + ((row_number() OVER w - 1) % 8) * (2.0::double / 7)')} AS {KW} FROM readings {W}")
def drift_ramp(t: Tables):
    out = p.with_step(t.readings.select(*MINI), 8)
    return out.select("event_id", r(F.col(KW) + p.ramp(F.col("step"), 8, 2.0)).alias(KW))


@query("sensor_failure", f"SELECT event_id, 0.0::double AS {KW}, 0.0::double AS {V}, {R(A)} AS {A} FROM readings")
def sensor_failure(t: Tables):
    return p.sensor_failure(t.readings.select(*MINI), [KW, V]).select("event_id", KW, V, r(A).alias(A))


FAILED = p.random_channel([KW, V, A], 5)


@query("random_channel_failure", "SELECT event_id, " + ", ".join("0.0::double AS " + c if c == FAILED else f"{R(c)} AS {c}" for c in (KW, V, A)) + " FROM readings")
def random_channel_failure(t: Tables):
    return p.sensor_failure(t.readings.select(*MINI), [FAILED]).select("event_id", *[r(c).alias(c) for c in (KW, V, A)])


@query("packet_loss", f"""SELECT event_id, lost, {R('coalesce(last_value(CASE WHEN NOT lost THEN x END IGNORE NULLS) OVER w, 0)')} AS {KW} FROM (
  SELECT event_id, ts, meter_id, {KW} AS x, {mix(2)} < 0.1::double AS lost FROM readings) {W}""")
def packet_loss(t: Tables):
    return p.packet_loss(t.readings.select(*MINI), [KW, V], 0.1, 2).select("event_id", "lost", r(KW).alias(KW))


@query("jitter_pairs", f"""SELECT event_id, {R(f'CASE WHEN rn % 2 = 1 AND u < 0.3::double AND nx IS NOT NULL THEN nx WHEN rn % 2 = 0 AND pu < 0.3::double THEN px ELSE {KW} END')} AS {KW} FROM (
  SELECT event_id, {KW}, row_number() OVER w AS rn, u, lag(u) OVER w AS pu, lag({KW}) OVER w AS px, lead({KW}) OVER w AS nx FROM (SELECT *, {mix(4)} AS u FROM readings) {W})""")
def jitter_pairs(t: Tables):
    return p.jitter_pairs(t.readings.select(*MINI), [KW], 0.3, 4).select("event_id", r(KW).alias(KW))


view("zreadings", f"SELECT r.*, ({KW} - m1) / s1 AS kw_z, ({V} - m2) / s2 AS v_z, ({A} - m3) / s3 AS a_z, row_number() OVER (PARTITION BY meter_id ORDER BY ts, event_id) AS rn FROM readings r, (SELECT avg({KW}) m1, stddev_pop({KW}) s1, avg({V}) m2, stddev_pop({V}) s2, avg({A}) m3, stddev_pop({A}) s3 FROM readings) q")


def zed(t: Tables):
    out = z_scores(t.readings.select(*MINI, "is_alert"), [KW, V, A])
    return out.withColumnsRenamed({f"{KW}_z": "kw_z", f"{V}_z": "v_z", f"{A}_z": "a_z"})


@query("data_drift", f"SELECT event_id, {R('kw_z + 0.55')} AS kw_z, {R('v_z + 0.45')} AS v_z FROM zreadings")
def data_drift(t: Tables):
    return zed(t).select("event_id", r(F.col("kw_z") + 0.55).alias("kw_z"), r(F.col("v_z") + 0.45).alias("v_z"))


@query("concept_drift", f"SELECT event_id, {R('CASE WHEN is_alert = 1 THEN kw_z * 0.4 + (SELECT avg(kw_z) FROM zreadings WHERE is_alert = 0) * 0.6 ELSE kw_z END')} AS kw_z FROM zreadings")
def concept_drift(t: Tables):
    return p.concept_drift(zed(t), ["kw_z"], "is_alert", 0.6).select("event_id", r("kw_z").alias("kw_z"))


@query("unknown_attack", f"""SELECT event_id, {R('kw_z + ((rn - 1) % 8) * (2.0::double / 7)')} AS slow_ramp, {R('v_z + 1.5')} AS inverse_v, {R('a_z - 1.5')} AS inverse_a,
  {R('kw_z + 0.8 * sin(2 * pi() * ((rn - 1) % 8) / 3)')} AS oscillation FROM zreadings WHERE is_alert = 0""")
def unknown_attack(t: Tables):
    z, s = p.with_step(zed(t), 8).filter("is_alert = 0"), F.col("step")
    return z.select("event_id", r(p.unknown_attack(s, F.col("kw_z"), "slow_ramp", 8)).alias("slow_ramp"),
                    r(p.unknown_attack(s, F.col("v_z"), "combined_inverse", 8)).alias("inverse_v"),
                    r(p.unknown_attack(s, F.col("a_z"), "combined_inverse", 8, -1)).alias("inverse_a"),
                    r(p.unknown_attack(s, F.col("kw_z"), "oscillation", 8)).alias("oscillation"))


@query("ood_shift", f"SELECT event_id, {R(f'kw_z + CASE WHEN {mix(5)} < 0.5::double THEN -6 ELSE 6 END')} AS kw_z FROM zreadings")
def ood_shift(t: Tables):
    return zed(t).select("event_id", r(p.out_of_distribution(F.col("kw_z"), "event_id", 6.0, 5)).alias("kw_z"))


FEATURES = ("kw_z", "v_z", "a_z")


def _corrupted(j: str) -> str:
    return " + ".join(f"power({gauss(31) if f_ == j else f_}, 2)" for f_ in FEATURES)


@query("feature_scan", " UNION ALL ".join(
    f"SELECT '{j}' AS feature, {R('auc', 5)} AS roc_auc FROM ({auc_sql(f'(SELECT is_alert, round({_corrupted(j)}, 9) AS s FROM zreadings)', 's', '', 'is_alert')})" for j in FEATURES))
def feature_scan(t: Tables):
    z = zed(t)
    score = {j: F.round(sum((F.pow(p.gaussian("event_id", 31) if c == j else F.col(c), 2) for c in FEATURES), F.lit(0.0)), 9) for j in FEATURES}
    long = z.select("is_alert", F.inline(F.array(*[F.struct(F.lit(j).alias("feature"), s.alias("s")) for j, s in score.items()])))
    return curve_areas(long, ["feature"], "s", "is_alert").select("feature", r("roc_auc", 5).alias("roc_auc")).orderBy("roc_auc")


@query("attack_overlay", f"""SELECT r.event_id, {R(f'{V} * (1 + m * 0.2)')} AS {V}, {R(f'{KW} * (1 + m)')} AS {KW}, {R(f'{A} * (1 + m)')} AS {A}, active_attack, coalesce(kind, 'normal') AS attack_type FROM (
  SELECT r.*, CASE WHEN epoch_us(r.ts) - epoch_us(a.start_ts) <= a.duration_s * 1000000 AND a.attack_type = 'fdia' THEN a.magnitude ELSE 0 END AS m,
    CASE WHEN epoch_us(r.ts) - epoch_us(a.start_ts) <= a.duration_s * 1000000 THEN a.attack_type END AS kind,
    CASE WHEN epoch_us(r.ts) - epoch_us(a.start_ts) <= a.duration_s * 1000000 THEN a.attack_id ELSE -1 END AS active_attack
  FROM readings r ASOF LEFT JOIN attack_schedule a ON r.bus_id = a.bus_id AND r.ts >= a.start_ts) r""")
def attack_overlay(t: Tables):
    out = p.attack_overlay(t.readings.select(*MINI, "bus_id"), t.attack_schedule)
    return out.select("event_id", r(V).alias(V), r(KW).alias(KW), r(A).alias(A), "active_attack", "attack_type")


@query("interval_matches", """SELECT r.event_id, r.bus_id, count(a.attack_id) AS active FROM readings r LEFT JOIN attack_schedule a ON r.bus_id = a.bus_id AND r.ts >= a.start_ts AND epoch_us(r.ts) <= epoch_us(a.start_ts) + a.duration_s * 1000000
GROUP BY r.event_id, r.bus_id""")
def interval_matches(t: Tables):
    return p.active_overlays(t.readings, t.attack_schedule)


SIG_U = mix(3)


@query("signature_overlay", f"""WITH s AS (SELECT ts, meter_id, min(anomalies) AS attack FROM readings WHERE is_alert = 1 AND attack_type = 'fdia' GROUP BY ts, meter_id),
j AS (SELECT r.*, s.attack, {SIG_U} AS u FROM readings r LEFT JOIN s ON r.ts = s.ts AND r.meter_id = s.meter_id),
k AS (SELECT *, CASE attack WHEN 'Surcharge' THEN {V} - (3 + 7 * u) WHEN 'Tension hors norme' THEN CASE WHEN u < 0.5::double THEN 185 + 20 * u * 2 ELSE 248 + 17 * (u * 2 - 1) END ELSE {V} END AS v2 FROM j)
SELECT event_id, {R('v2')} AS {V}, {R(f"CASE attack WHEN 'Surcharge' THEN {KW} * (1.6 + (2.6::double - 1.6::double) * u) WHEN 'Pic soudain' THEN {KW} * (2 + 2 * u) WHEN 'Fraude' THEN {KW} * (0.2::double + (0.55::double - 0.2::double) * u) WHEN 'Consommation nulle suspecte' THEN 0.12 * u ELSE {KW} END")} AS {KW},
  {R(f"CASE attack WHEN 'Surcharge' THEN {A} * (1.6 + (2.6::double - 1.6::double) * u) WHEN 'Pic soudain' THEN {A} * (2 + 2 * u) WHEN 'Fraude' THEN {A} * (0.2::double + (0.55::double - 0.2::double) * u) WHEN 'Consommation nulle suspecte' THEN 0.6 * u WHEN 'Tension hors norme' THEN {KW} * 1000 / greatest(v2, 1) ELSE {A} END")} AS {A},
  {R("CASE attack WHEN 'Surcharge' THEN frequency_hz - (0.1::double + (0.35::double - 0.1::double) * u) WHEN 'Pic soudain' THEN frequency_hz - (0.05::double + (0.25::double - 0.05::double) * u) ELSE frequency_hz END")} AS frequency_hz,
  {R("CASE attack WHEN 'Fraude' THEN 0.55::double + (0.8::double - 0.55::double) * u WHEN 'Consommation nulle suspecte' THEN 0.5 + 0.25 * u ELSE power_factor END")} AS power_factor, CASE WHEN attack IS NULL THEN 'NORMAL' ELSE 'ALERTE' END AS statut FROM k""")
def signature_overlay(t: Tables):
    schedule = t.readings.filter("is_alert = 1 AND attack_type = 'fdia'").select("ts", "meter_id", F.col("anomalies").alias("attack"))
    out = p.signature_overlay(t.readings, schedule)
    return out.select("event_id", *[r(x).alias(x) for x in (V, KW, A, "frequency_hz", "power_factor")], "statut")


STEALTH = {"naive_v": f"{V} * 1.25", "naive_kw": f"{KW} * 1.3", "naive_a": f"{A} * 1.2", "stealthy_v": f"{V} * 1.06", "ramp_kw": f"{KW} * (1 + i * 0.03)", "ramp_a": f"{A} * (1 + i * 0.03)", "coordinated_kw": f"{KW} * 1.2"}


@query("stealth_overlay", "SELECT event_id, " + ", ".join(f"{R(x)} AS {n}" for n, x in STEALTH.items()) + f" FROM (SELECT *, (row_number() OVER w - 1) % 20 AS i FROM readings {W})")
def stealth_overlay(t: Tables):
    return p.stealth_overlay(t.readings.select(*MINI)).select("event_id", *[r(c).alias(c) for c in STEALTH])


view("in_incident", """SELECT r.event_id, r.meter_id, r.zone, r.ts, cast(coalesce(min(i.incident_id), 0) as int) AS incident_id FROM readings r LEFT JOIN incidents i ON r.zone = i.zone AND
  CASE WHEN start_hour <= end_hour THEN hour(ts) >= start_hour AND hour(ts) < end_hour ELSE hour(ts) >= start_hour OR hour(ts) < end_hour END GROUP BY r.event_id, r.meter_id, r.zone, r.ts""")


@query("active_incident", "SELECT event_id, zone, incident_id FROM in_incident")
def active_incident(t: Tables):
    return p.active_incident(t.readings.select("event_id", "ts", "zone"), t.incidents).select("event_id", "zone", "incident_id")


@query("first_alert", "SELECT incident_id, meter_id, arg_min(event_id, ts) AS event_id, min(ts) AS alerted_at FROM in_incident WHERE incident_id > 0 GROUP BY incident_id, meter_id")
def first_alert(t: Tables):
    rows = p.active_incident(t.readings.select("event_id", "ts", "zone", "meter_id"), t.incidents).filter("incident_id > 0")
    return rows.groupBy("incident_id", "meter_id").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id"), F.min("ts").alias("alerted_at"))
