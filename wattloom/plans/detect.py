"""Detection, threshold and alerting queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expr import r
from ..operators import detect as d, features as f
from ..operators.quantiles import percentiles
from ..session import scratch_dir
from ..sources.readings import Tables
from .registry import BODIES, R, query, view

WIN = "WINDOW w AS (PARTITION BY meter_id ORDER BY ts, event_id)"

view("featured", f"""SELECT *, kw_raw_diff AS kw_diff, CASE WHEN kw_prev IS NULL OR kw_prev = 0 THEN 0 ELSE (consommation_kw - kw_prev) / kw_prev END AS kw_rate FROM (
  SELECT r.*, hour(r.ts) AS hour, isodow(r.ts) >= 6 AS is_weekend, lag(consommation_kw) OVER w AS kw_prev, coalesce(consommation_kw - lag(consommation_kw) OVER w, 0) AS kw_raw_diff,
    ts.mean AS mean_t, ts.std AS std_t, ts.q95 AS q95_t, g.mean AS mean_all
  FROM readings r JOIN type_stats ts ON r.type = ts.type, global_stats g WINDOW w AS (PARTITION BY meter_id ORDER BY r.ts, event_id))""")
view("ruled", """SELECT *,
  CASE WHEN abs(tension_v - 230) / 230 > 0.05 THEN greatest(v_base, abs(tension_v - 230) / 230 * 2) ELSE v_base END AS voltage_score,
  CASE WHEN z > 3 THEN greatest(c_base, least(z / 5, 1)) ELSE c_base END AS consumption_score,
  CASE WHEN z > 3 THEN 'statistical_outlier' WHEN idle THEN 'unexpected_zero_consumption' WHEN consommation_kw > mean_t * 3 THEN 'consumption_spike'
    WHEN consommation_kw > q95_t THEN 'high_consumption' ELSE 'normal' END AS consumption_type,
  CASE WHEN tension_v <= 0 OR courant_a <= 0 THEN 0 WHEN consommation_kw > kva * 1.05 THEN 0.9 WHEN pf < 0.85 THEN (0.85 - pf) / 0.85 ELSE 0 END AS power_factor_score,
  CASE WHEN tension_v <= 0 OR courant_a <= 0 THEN 'normal' WHEN consommation_kw > kva * 1.05 THEN 'impossible_power_factor' WHEN pf < 0.85 THEN 'low_power_factor' ELSE 'normal' END AS power_factor_type,
  CASE WHEN frequency_hz < 59.5::double THEN least((59.5::double - frequency_hz) / 0.5, 1) WHEN frequency_hz > 60.5::double THEN least((frequency_hz - 60.5::double) / 0.5, 1) ELSE 0 END AS frequency_score,
  CASE WHEN type = 'residentiel' AND hour <= 5 AND consommation_kw > mean_all * 1.5 THEN 0.6
    WHEN type = 'commercial' AND consommation_kw > mean_all AND (is_weekend OR hour <= 6 OR hour >= 20) THEN 0.5
    WHEN type = 'industriel' AND hour BETWEEN 8 AND 18 AND consommation_kw < mean_all * 0.3 THEN 0.6 ELSE 0 END AS temporal_score,
  CASE WHEN abs(kw_rate) > 2 THEN greatest(r_base, least(abs(kw_rate) / 5, 1)) ELSE r_base END AS rate_change_score
FROM (SELECT *, least(consommation_kw / (kva + 1e-6), 1) AS pf,
  CASE WHEN tension_v < 200 OR tension_v > 260 THEN 1.0::double WHEN tension_v < 207 OR tension_v > 253 THEN 0.7::double ELSE 0 END AS v_base,
  CASE WHEN idle AND type = 'industriel' THEN 0.8::double WHEN idle THEN 0.7 WHEN consommation_kw > mean_t * 3 THEN 0.9 WHEN consommation_kw > q95_t THEN 0.6 ELSE 0 END AS c_base,
  CASE WHEN abs(kw_diff) > 5 THEN least(abs(kw_diff) / 10, 1) ELSE 0 END AS r_base FROM (
  SELECT *, tension_v * courant_a / 1000 AS kva, abs(consommation_kw - mean_t) / (std_t + 1e-6) AS z,
    consommation_kw = 0 AND ((type = 'industriel' AND hour BETWEEN 6 AND 22) OR (type = 'commercial' AND hour BETWEEN 8 AND 18)) AS idle FROM featured))""")
CRITERIA = list(d.WEIGHTS)
view("enhanced", "SELECT *, " + "CASE WHEN total_score > 0.2::double THEN CASE greatest(" + ", ".join(f"{c}_score" for c in CRITERIA) + ") "
     + " ".join(f"WHEN {c}_score THEN '{c}'" for c in CRITERIA) + " END ELSE 'normal' END AS anomaly_type, "
     + "CASE WHEN total_score > 0.2::double THEN greatest(" + ", ".join(f"{c}_score" for c in CRITERIA) + ") ELSE 1 - total_score END AS confidence, "
     + "total_score > 0.2::double AS is_anomaly FROM (SELECT *, "
     + " + ".join(f"{c}_score * {w}::double" for c, w in d.WEIGHTS.items())
     + " AS total_score FROM (SELECT x.*, CASE WHEN score > p95 THEN 1 ELSE score / p95 END AS reconstruction_score "
     + "FROM (SELECT u.*, s.score FROM ruled u JOIN scored s ON u.event_id = s.event_id) x, (SELECT quantile_cont(score, 0.95) AS p95 FROM scored) q))")


def featured(t: Tables):
    return d.rate_inputs(d.with_type_stats(f.temporal(t.readings)))


def detected(t: Tables):
    cols = ["event_id", "meter_id", "ts", "zone", "type", "consommation_kw", "tension_v", "courant_a", "frequency_hz", "is_alert"]
    score = ((F.col("event_id") * 37 % 1000 + F.col("is_alert") * 300).cast("double") / 1300.0).alias("recon_error")
    return d.enhanced_detection(t.readings.select(*cols, score))


def _rule(name: str, kind: str | None = None) -> str:
    return f"SELECT event_id, {R(name + '_score')} AS score{', ' + kind + ' AS kind' if kind else ''} FROM ruled"


def _ruled(df, rule):
    score, kind = rule
    return df.select("event_id", r(score).alias("score"), kind.alias("kind"))


@query("rule_voltage", f"""SELECT event_id, {R('voltage_score')} AS score, CASE WHEN tension_v < 200 THEN 'critical_under_voltage' WHEN tension_v < 207 THEN 'under_voltage'
  WHEN tension_v > 260 THEN 'critical_over_voltage' WHEN tension_v > 253 THEN 'over_voltage' ELSE 'normal' END AS kind FROM ruled""")
def rule_voltage(t: Tables):
    return _ruled(t.readings, d.voltage_rule(F.col("tension_v")))


@query("rule_consumption", _rule("consumption", "consumption_type"))
def rule_consumption(t: Tables):
    df = d.with_type_stats(f.temporal(t.readings))
    return _ruled(df, d.consumption_rule(*[F.col(c) for c in ("consommation_kw", "type", "hour", "mean_t", "std_t", "q95_t")]))


@query("rule_power_factor", _rule("power_factor", "power_factor_type"))
def rule_power_factor(t: Tables):
    return _ruled(t.readings, d.power_factor_rule(*[F.col(c) for c in ("consommation_kw", "tension_v", "courant_a")]))


@query("rule_frequency", f"""SELECT event_id, {R('frequency_score')} AS score, CASE WHEN frequency_hz < 59.5::double THEN 'low_frequency' WHEN frequency_hz > 60.5::double THEN 'high_frequency' ELSE 'normal' END AS kind FROM ruled""")
def rule_frequency(t: Tables):
    return _ruled(t.readings, d.frequency_rule(F.col("frequency_hz")))


@query("rule_temporal", f"""SELECT event_id, {R('temporal_score')} AS score, CASE WHEN temporal_score = 0 THEN 'normal' WHEN type = 'residentiel' THEN 'unusual_night_consumption'
  WHEN type = 'industriel' THEN 'unexpected_industrial_shutdown' WHEN is_weekend THEN 'weekend_commercial_activity' ELSE 'off_hours_commercial_activity' END AS kind FROM ruled""")
def rule_temporal(t: Tables):
    df = d.with_type_stats(f.temporal(t.readings))
    return _ruled(df, d.temporal_rule(*[F.col(c) for c in ("consommation_kw", "type", "hour", "is_weekend", "mean_all")]))


@query("rule_rate_change", f"""SELECT event_id, {R('rate_change_score')} AS score, CASE WHEN abs(kw_rate) > 2 THEN 'rapid_fluctuation' WHEN abs(kw_diff) > 5 THEN 'sudden_change' ELSE 'normal' END AS kind FROM ruled""")
def rule_rate_change(t: Tables):
    return _ruled(d.rate_inputs(t.readings), d.rate_change_rule(F.col("kw_diff"), F.col("kw_rate")))


SCORES = [f"{c}_score" for c in CRITERIA]


@query("enhanced_detection", "SELECT event_id, meter_id, is_anomaly, anomaly_type, " + ", ".join(f"{R(c)} AS {c}" for c in (*SCORES, "total_score", "confidence")) + " FROM enhanced")
def enhanced_detection(t: Tables):
    return detected(t).select("event_id", "meter_id", "is_anomaly", "anomaly_type", *[r(c).alias(c) for c in (*SCORES, "total_score", "confidence")])


@query("criterion_table", BODIES["enhanced_detection"])
def criterion_table(t: Tables):
    """The result table of every criterion, stored by decision and read back."""
    path = scratch_dir(t.spark, "criteria")
    out = enhanced_detection(t)
    out.write.partitionBy("is_anomaly").parquet(path)
    return t.spark.read.schema(out.schema).parquet(path)


@query("recon_criterion", f"SELECT event_id, {R('CASE WHEN score > p95 THEN 1 ELSE score / p95 END')} AS score FROM scored, (SELECT quantile_cont(score, 0.95) AS p95 FROM scored) q")
def recon_criterion(t: Tables):
    p95 = percentiles(t.scored, [], {"p95": ("score", 0.95)})
    df = t.scored.select("event_id", "score").withColumn("p95", p95.scalar())
    return df.select("event_id", r(d.reconstruction_criterion(F.col("score"), F.col("p95"))).alias("score"))


@query("anomaly_breakdown", f"SELECT anomaly_type, count(*) AS n, {R('100.0 * count(*) / (SELECT count(*) FROM enhanced WHERE is_anomaly)')} AS pct FROM enhanced WHERE is_anomaly GROUP BY anomaly_type")
def anomaly_breakdown(t: Tables):
    return d.anomaly_breakdown(detected(t)).select("anomaly_type", "n", r("pct").alias("pct"))


@query("criterion_contribution", " UNION ALL ".join(
    f"SELECT '{c}' AS criterion, {R(f'avg({c})')} AS mean, {R(f'stddev_pop({c})')} AS std, {R(f'max({c})')} AS max, cast(sum(cast({c} > 0.5 as int)) as bigint) AS triggered, {R(f'100.0 * avg(cast({c} > 0.5 as int))')} AS triggered_pct FROM enhanced"
    for c in SCORES))
def criterion_contribution(t: Tables):
    out = d.criterion_contribution(detected(t))
    return out.select("criterion", "triggered", *[r(c).alias(c) for c in ("mean", "std", "max", "triggered_pct")])


@query("recent_detections", f"""SELECT event_id, meter_id, ts, anomaly_type, {R('total_score')} AS total_score, {R('voltage_score')} AS voltage_score, {R('consumption_score')} AS consumption_score
FROM enhanced WHERE is_anomaly ORDER BY ts DESC, event_id DESC LIMIT 500""")
def recent_detections(t: Tables):
    out = detected(t).filter("is_anomaly").withColumn("criteria", F.struct(*[F.col(c) for c in SCORES]))
    out = out.orderBy(F.desc("ts"), F.desc("event_id")).limit(500)
    return out.select("event_id", "meter_id", "ts", "anomaly_type", r("total_score").alias("total_score"),
                      r("criteria.voltage_score").alias("voltage_score"), r("criteria.consumption_score").alias("consumption_score"))


@query("domain_rules", """SELECT event_id, reasons, reasons <> '' AS is_anomaly FROM (SELECT event_id, concat_ws(',',
  CASE WHEN tension_v < 207 THEN 'Voltage_too_low' WHEN tension_v > 253 THEN 'Voltage_too_high' END,
  CASE WHEN frequency_hz < 59.5::double THEN 'Frequency_too_low' WHEN frequency_hz > 60.5::double THEN 'Frequency_too_high' END,
  CASE WHEN power_factor < 0.85::double THEN 'Low_power_factor' END) AS reasons FROM readings)""")
def domain_rules(t: Tables):
    why = d.domain_rules(F.col("tension_v"), F.col("frequency_hz"), F.col("power_factor"))
    df = t.readings.withColumn("why", why)
    return df.select("event_id", F.array_join("why", ",").alias("reasons"), (F.size("why") > 0).alias("is_anomaly"))


view("normal_scores", "SELECT score FROM scored WHERE label = 0")


@query("static_threshold", f"SELECT {R('quantile_cont(score, 0.95)')} AS percentile_threshold, {R('avg(score) + 3 * stddev_pop(score)')} AS sigma_threshold FROM normal_scores")
def static_threshold(t: Tables):
    out = d.static_thresholds(t.scored.filter("label = 0").select("score"), "score")
    return out.select(*[r(c).alias(c) for c in ("percentile_threshold", "sigma_threshold")])


@query("threshold_strategies", f"""SELECT {R('quantile_cont(score, 0.95)')} AS p95, {R('quantile_cont(score, 0.99)')} AS p99,
  {R('quantile_cont(score, 0.5) + 3 * 1.4826 * (SELECT quantile_cont(abs(score - (SELECT quantile_cont(score, 0.5) FROM normal_scores)), 0.5) FROM normal_scores)')} AS mad,
  {R('avg(score) + 3 * stddev_pop(score)')} AS adaptive FROM normal_scores""")
def threshold_strategies(t: Tables):
    out = d.threshold_strategies(t.scored.filter("label = 0").select("score"), "score")
    return out.select(*[r(c).alias(c) for c in ("p95", "p99", "mad", "adaptive")])


@query("score_summary", f"""SELECT type, count(*) AS n, {R('avg(cast(score >= 0.6::double as double))')} AS rate, {R('avg(score)')} AS mean, {R('stddev_pop(score)')} AS std, {R('max(score)')} AS max, {R('min(score)')} AS min FROM scored GROUP BY type""")
def score_summary(t: Tables):
    s = F.col("score")
    return t.scored.groupBy("type").agg(F.count(F.lit(1)).alias("n"), r(F.avg((s >= 0.6).cast("double"))).alias("rate"), r(F.avg(s)).alias("mean"),
                                        r(F.stddev_pop(s)).alias("std"), r(F.max(s)).alias("max"), r(F.min(s)).alias("min"))


ADAPTIVE_SQL = f"""
WITH RECURSIVE o AS (SELECT meter_id, event_id, score, row_number() OVER (PARTITION BY meter_id ORDER BY ts, event_id) AS rn FROM scored),
f AS (SELECT meter_id, event_id, score, rn, 0.9::double AS threshold, CASE WHEN score < 0.9::double THEN [score] ELSE []::double[] END AS known FROM o WHERE rn = 1
  UNION ALL SELECT meter_id, event_id, score, rn, thr, CASE WHEN score < thr THEN list_append(known, score)[-500:] ELSE known END FROM (
    SELECT o.*, f.known, CASE WHEN len(f.known) >= 30 THEN list_avg(f.known) + 3 * list_stddev_pop(f.known) ELSE 0.9::double END AS thr FROM f JOIN o ON o.meter_id = f.meter_id AND o.rn = f.rn + 1))
SELECT meter_id, event_id, {R('score')} AS score, {R('threshold')} AS threshold, score >= threshold AS is_anomaly, {R('least(1, score / greatest(threshold, 1e-9))')} AS confidence FROM f"""


@query("adaptive_threshold", ADAPTIVE_SQL)
def adaptive_threshold(t: Tables):
    return rounded_adaptive(d.adaptive_threshold(t.scored, 0.9))


def rounded_adaptive(df):
    return df.select("meter_id", "event_id", "is_anomaly", *[r(c).alias(c) for c in ("score", "threshold", "confidence")])


@query("global_threshold", f"""
WITH o AS (SELECT event_id, score, row_number() OVER (ORDER BY ts, event_id) AS i, quantile_cont(score, 0.98) OVER (ORDER BY ts, event_id ROWS BETWEEN 4999 PRECEDING AND CURRENT ROW) AS q, ts FROM scored),
u AS (SELECT *, CASE WHEN i >= 200 AND (i % 50 = 0 OR i >= 5000) THEN q END AS fresh FROM o)
SELECT event_id, {R('score')} AS score, {R('coalesce(last_value(fresh IGNORE NULLS) OVER (ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.9)')} AS threshold FROM u""")
def global_threshold(t: Tables):
    return d.global_threshold(t.scored, 0.9).select("event_id", r("score").alias("score"), r("threshold").alias("threshold"))


@query("rolling_threshold", f"""
SELECT event_id, {R('thr')} AS threshold, score >= thr AS is_anomaly, {R('least(1, score / greatest(thr, 1e-9))')} AS confidence FROM (
  SELECT event_id, score, CASE WHEN count(*) OVER h >= 30 THEN avg(score) OVER h + 3 * stddev_pop(score) OVER h ELSE 0.9::double END AS thr FROM scored
  WINDOW h AS (PARTITION BY meter_id ORDER BY ts, event_id ROWS BETWEEN 500 PRECEDING AND 1 PRECEDING))""")
def rolling_threshold(t: Tables):
    out = d.rolling_threshold(t.scored.select("event_id", "meter_id", "ts", "score"), "score", 0.9)
    return out.select("event_id", r("threshold").alias("threshold"), "is_anomaly", r("confidence").alias("confidence"))


XF = ["consommation_kw", "tension_v", "courant_a", "frequency_hz", "consommation_kw_diff", "zone_consumption_mean"]
view("explained0", f"""SELECT *, coalesce(consommation_kw - lag(consommation_kw) OVER (PARTITION BY meter_id ORDER BY ts, event_id), 0) AS consommation_kw_diff,
  avg(consommation_kw) OVER (PARTITION BY date_trunc('hour', ts), zone) AS zone_consumption_mean FROM readings""")
view("explained", "SELECT e.*, " + ", ".join(f"coalesce(({c} - m_{c}) / nullif(s_{c}, 0), 0) AS {c}_z" for c in XF) + " FROM explained0 e, (SELECT "
     + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in XF) + " FROM explained0) q")
view("contrib", "SELECT event_id, feature, c, row_number() OVER (PARTITION BY event_id ORDER BY c DESC, feature) AS k FROM ("
     + " UNION ALL ".join(f"SELECT event_id, '{c}' AS feature, power({c}_z, 2) AS c FROM explained" for c in XF) + ")")
view("toplist", "SELECT event_id, string_agg(feature, ',' ORDER BY k) AS features, max(CASE WHEN k = 1 THEN c END) AS c1 FROM contrib WHERE k <= 3 GROUP BY event_id")


def explained(t: Tables):
    base = d.over_series(t.readings, f.METER, f.ORDER, lambda w: {"consommation_kw_diff": f.diff(w, "consommation_kw")}, back=1)
    base = f.zone_mean(base, F.date_trunc("hour", "ts"))
    return d.z_scores(base, XF).withColumn("top", F.slice(d.ranked_contributions(XF), 1, 3))


@query("feature_contributions", f"SELECT event_id, features, {R('c1', 5)} AS top_contribution FROM toplist")
def feature_contributions(t: Tables):
    names = F.transform("top", lambda x: x["feature"])
    return explained(t).select("event_id", F.array_join(names, ",").alias("features"), r(F.col("top")[0]["contribution"], 5).alias("top_contribution"))


@query("classify_attack", """
SELECT e.event_id, CASE WHEN split_part(features, ',', 1) LIKE '%tension%' OR split_part(features, ',', 2) LIKE '%tension%' THEN 'fdia'
  WHEN (contains(features, 'zone_consumption_mean') OR contains(features, 'consommation_kw_diff')) AND consommation_kw > 5 AND
    CASE WHEN tension_v * courant_a / 1000 > 0 THEN consommation_kw / (tension_v * courant_a / 1000) ELSE 1 END < 0.5 THEN 'fraud'
  WHEN tension_v < 180 OR courant_a > 50 THEN 'fault' ELSE 'dos' END AS attack_class FROM explained e JOIN toplist t ON e.event_id = t.event_id""")
def classify_attack(t: Tables):
    names = F.transform("top", lambda x: x["feature"])
    return explained(t).select("event_id", d.classify_attack(names, F.col("consommation_kw"), F.col("tension_v"), F.col("courant_a")).alias("attack_class"))


@query("global_importance", " UNION ALL ".join(f"SELECT '{c}' AS feature, {R(f'avg(abs({c}_z))')} AS importance FROM explained" for c in XF))
def global_importance(t: Tables):
    base = d.over_series(t.readings, f.METER, f.ORDER, lambda w: {"consommation_kw_diff": f.diff(w, "consommation_kw")}, back=1)
    out = d.global_importance(f.zone_mean(base, F.date_trunc("hour", "ts")), XF)
    return out.select("feature", r("importance").alias("importance"))


view("step_errors", """SELECT event_id, meter_id, ts, power((consommation_kw - m1) / s1, 2) + power((tension_v - m2) / s2, 2) AS e FROM readings,
  (SELECT avg(consommation_kw) m1, stddev_pop(consommation_kw) s1, avg(tension_v) m2, stddev_pop(tension_v) s2 FROM readings) q""")
view("window_steps", """SELECT w.event_id, list(s.e ORDER BY s.ts, s.event_id) AS errors FROM
  (SELECT event_id, meter_id, row_number() OVER (PARTITION BY meter_id ORDER BY ts, event_id) AS rn FROM step_errors) w
  JOIN (SELECT *, row_number() OVER (PARTITION BY meter_id ORDER BY ts, event_id) AS rn FROM step_errors) s ON w.meter_id = s.meter_id AND s.rn BETWEEN w.rn - 7 AND w.rn
  WHERE w.rn >= 8 GROUP BY w.event_id""")


def window_errors(t: Tables):
    z = d.z_scores(t.readings, ["consommation_kw", "tension_v"])
    z = z.withColumn("e", F.pow("consommation_kw_z", 2) + F.pow("tension_v_z", 2))
    cols = ["event_id", "ts", "meter_id", "zone", "type", "is_alert", "e"]
    return f.sliding_windows(z.select(*cols), f.METER, 8, ["e"]).withColumn("errors", F.transform("steps", lambda s: s["e"]))


@query("critical_timestep", f"""SELECT event_id, cast(step as int) AS critical_step, {R('e', 5)} AS step_error FROM (
  SELECT event_id, step, e, row_number() OVER (PARTITION BY event_id ORDER BY e DESC, step) AS k FROM (SELECT event_id, unnest(errors) AS e, unnest(range(0, 8)) AS step FROM window_steps)) WHERE k = 1""")
def critical_timestep(t: Tables):
    out = window_errors(t).withColumn("k", d.critical_timesteps(F.col("errors")))
    return out.select("event_id", F.col("k")[0].alias("critical_step"), r(F.array_max("errors"), 5).alias("step_error"))


@query("explanation_text", """
SELECT w.event_id, concat('Anomalie detectee a t=', k1, '; causes: ', features, '; evenements: t', k1, ', t', k2, ', t', k3, '; Meter ID: ', meter_id, '; Zone: ', zone) AS summary FROM (
  SELECT event_id, max(CASE WHEN k = 1 THEN step END) AS k1, max(CASE WHEN k = 2 THEN step END) AS k2, max(CASE WHEN k = 3 THEN step END) AS k3 FROM (
    SELECT event_id, step, row_number() OVER (PARTITION BY event_id ORDER BY e DESC, step) AS k FROM (SELECT event_id, unnest(errors) AS e, unnest(range(0, 8)) AS step FROM window_steps)) GROUP BY event_id) w
JOIN toplist t ON w.event_id = t.event_id JOIN readings r ON w.event_id = r.event_id""")
def explanation_text(t: Tables):
    steps = window_errors(t).select("event_id", d.critical_timesteps(F.col("errors")).alias("k"))
    why = explained(t).select("event_id", "meter_id", "zone", F.transform("top", lambda x: x["feature"]).alias("names"))
    where = F.array_join(F.transform("k", lambda i: F.concat(F.lit("t"), i.cast("string"))), ", ")
    text = F.concat(F.lit("Anomalie detectee a t="), F.col("k")[0].cast("string"), F.lit("; causes: "), F.array_join("names", ","),
                    F.lit("; evenements: "), where, F.lit("; Meter ID: "), F.col("meter_id"), F.lit("; Zone: "), F.col("zone"))
    return steps.join(why, "event_id").select("event_id", text.alias("summary"))


@query("ensemble", f"""SELECT event_id, score >= 0.6::double AS is_anomaly, CASE WHEN score >= 0.6::double AND score_b >= 0.5::double THEN 'HIGH' WHEN score >= 0.6::double THEN 'MEDIUM' ELSE 'NONE' END AS confidence_label,
  {R('0.5 * score + 0.5 * score_b')} AS anomaly_score, {R('least(1, (0.5 * score + 0.5 * score_b) / 0.6)')} AS confidence FROM scored""")
def ensemble(t: Tables):
    first = t.scored.select("event_id", "score", F.lit(0.6).alias("threshold"))
    second = t.scored.select("event_id", "score_b", F.lit(0.5).alias("threshold_b"))
    out = d.ensemble(first, second, "event_id")
    return out.select("event_id", "is_anomaly", "confidence_label", r("anomaly_score").alias("anomaly_score"), r("confidence").alias("confidence"))


COOLDOWN_SQL = """
WITH RECURSIVE a AS (SELECT {key}, id, epoch_us(created_at) AS us, row_number() OVER (PARTITION BY {key} ORDER BY created_at, id) AS rn FROM alerts),
f AS (SELECT {key}, id, us, rn, us AS last_us, true AS emitted FROM a WHERE rn = 1
  UNION ALL SELECT a.{key}, a.id, a.us, a.rn, CASE WHEN a.us - f.last_us >= {us} THEN a.us ELSE f.last_us END, a.us - f.last_us >= {us}
  FROM f JOIN a ON a.{key} = f.{key} AND a.rn = f.rn + 1)
SELECT {key}, id, emitted FROM f"""


@query("alert_cooldown", COOLDOWN_SQL.format(key="meter_id", us=86_400_000_000))
def alert_cooldown(t: Tables):
    return d.alert_cooldown(t.alerts, "meter_id", "created_at", "id", 86_400)


@query("bus_alert_cooldown", COOLDOWN_SQL.format(key="bus_id", us=300_000_000))
def bus_alert_cooldown(t: Tables):
    return d.alert_cooldown(t.alerts, "bus_id", "created_at", "id", 300)


@query("alert_severity", """SELECT id, CASE WHEN confidence > 0.8::double THEN 'critical' ELSE 'warning' END AS severity,
  CASE WHEN attack_type = 'fdia' THEN 0.8::double ELSE 0.7::double END AS bus_confidence FROM alerts""")
def alert_severity(t: Tables):
    return t.alerts.select("id", d.severity(F.col("confidence")).alias("severity"), d.bus_confidence(F.col("attack_type")).alias("bus_confidence"))


@query("alert_message", """SELECT a.id, concat('ALERT for ', meter_id, ' at bus ', bus_id, ': ', attack_type, ' detected. ', upper(severity)) AS message FROM alerts a""")
def alert_message(t: Tables):
    text = F.concat(F.lit("ALERT for "), "meter_id", F.lit(" at bus "), F.col("bus_id").cast("string"), F.lit(": "), "attack_type", F.lit(" detected. "), F.upper("severity"))
    return t.alerts.select("id", text.alias("message"))


@query("rate_window", """SELECT user_id, event_id, ts, recent FROM (SELECT *, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW) AS recent FROM events) WHERE recent > 3""")
def rate_window(t: Tables):
    # one day and 3 requests instead of one minute and 120: the test log is sparse
    return d.rate_violations(t.events, "user_id", "ts", "event_id", 86_400, 3)


@query("rate_limit_exact", """
WITH RECURSIVE o AS (SELECT user_id, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
f AS (SELECT user_id, event_id, us, rn, true AS allowed, [us] AS hits FROM o WHERE rn = 1
  UNION ALL SELECT user_id, event_id, us, rn, len(kept) < 3, CASE WHEN len(kept) < 3 THEN list_append(kept, us) ELSE kept END FROM (
    SELECT o.*, [h for h in f.hits if o.us - h <= 86400000000] AS kept FROM f JOIN o ON o.user_id = f.user_id AND o.rn = f.rn + 1))
SELECT user_id, event_id, allowed FROM f""")
def rate_limit_exact(t: Tables):
    return d.rate_limit_exact(t.events, "user_id", "ts", "event_id", 86_400, 3)


# the test log has event types instead of paths: purchases have a budget of their own, errors are exempt
PATHS = {"limit": 3, "own": {"purchase": 1}, "exempt": ("error",)}
_HELD = "[h for h in f.hits if o.us - h <= 86400000000]"
_MOST = "CASE WHEN o.budget = 'purchase' THEN 1 ELSE 3 END"


@query("rate_limit_budgets", f"""
WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY user_id, budget ORDER BY ts, event_id) AS rn FROM (
    SELECT user_id, event_id, ts, epoch_us(ts) AS us, CASE WHEN event_type = 'purchase' THEN 'purchase' ELSE '' END AS budget FROM events WHERE event_type <> 'error')),
f AS (SELECT user_id, budget, event_id, us, rn, true AS allowed, [us] AS hits FROM o WHERE rn = 1
  UNION ALL SELECT user_id, budget, event_id, us, rn, len(kept) < most, CASE WHEN len(kept) < most THEN list_append(kept, us) ELSE kept END FROM (
    SELECT o.*, {_HELD} AS kept, {_MOST} AS most FROM f JOIN o ON o.user_id = f.user_id AND o.budget = f.budget AND o.rn = f.rn + 1))
SELECT user_id, event_id, budget, allowed FROM f UNION ALL SELECT user_id, event_id, NULL, true FROM events WHERE event_type = 'error'""")
def rate_limit_budgets(t: Tables):
    return d.rate_limit_budgets(t.events, "user_id", "ts", "event_id", "event_type", 86_400, **PATHS)
