"""Profiling, dashboard and rollup queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expr import div0, r
from ..operators import cleaning, profile as p
from ..operators.quantiles import percentiles
from ..session import scratch_dir
from ..sources.files import export_csv
from ..sources.readings import Tables
from .registry import BODIES, R, query, view

NUM = ["consommation_kw", "tension_v", "courant_a", "frequency_hz"]


def _union(parts):
    return " UNION ALL ".join(parts)


@query("describe", _union(
    f"SELECT '{c}' AS feature, count({c})::double AS n, {R(f'avg({c})')} AS mean, {R(f'stddev_samp({c})')} AS std, {R(f'min({c})')} AS min, {R(f'max({c})')} AS max, "
    f"{R(f'quantile_cont({c}, 0.25)')} AS q25, {R(f'quantile_cont({c}, 0.5)')} AS q50, {R(f'quantile_cont({c}, 0.75)')} AS q75 FROM readings" for c in NUM))
def describe(t: Tables):
    out = p.describe(t.readings, NUM)
    return out.select("feature", "n", *[r(c).alias(c) for c in ("mean", "std", "min", "max", "q25", "q50", "q75")])


GAPS = {"consommation_kw": "CASE WHEN attack_type = 'fdia' THEN NULL ELSE consommation_kw END",
        "tension_v": "CASE WHEN type = 'industriel' AND is_alert = 1 THEN NULL ELSE tension_v END", "courant_a": "courant_a"}


@query("missing_profile", _union(
    f"SELECT '{c}' AS feature, cast(sum(cast(({e}) IS NULL as int)) as bigint) AS missing, {R(f'100.0 * sum(cast(({e}) IS NULL as int)) / count(*)')} AS missing_pct FROM readings"
    for c, e in GAPS.items()))
def missing_profile(t: Tables):
    out = p.missing_profile(t.readings.select(*[F.expr(e).alias(c) for c, e in GAPS.items()]), list(GAPS))
    return out.select("feature", "missing", r("missing_pct").alias("missing_pct"))


CATS = ["zone", "type", "statut"]


@query("value_counts", _union(
    f"SELECT '{c}' AS feature, {c} AS value, count(*) AS n, {R('100.0 * count(*) / (SELECT count(*) FROM readings)')} AS pct FROM readings GROUP BY {c}" for c in CATS))
def value_counts(t: Tables):
    out = p.value_counts(t.readings, CATS)
    return out.select("feature", "value", "n", r("pct").alias("pct"))


@query("hourly_profile", f"SELECT cast(hour(ts) as int) AS hour, {R('avg(consommation_kw)')} AS kw, {R('avg(tension_v)')} AS v FROM readings GROUP BY 1")
def hourly_profile(t: Tables):
    return t.readings.groupBy(F.hour("ts").alias("hour")).agg(r(F.avg("consommation_kw")).alias("kw"), r(F.avg("tension_v")).alias("v"))


@query("hourly_by_type", f"SELECT type, cast(hour(ts) as int) AS hour, {R('avg(consommation_kw)')} AS kw FROM readings GROUP BY 1, 2")
def hourly_by_type(t: Tables):
    return t.readings.groupBy("type", F.hour("ts").alias("hour")).agg(r(F.avg("consommation_kw")).alias("kw"))


@query("anomaly_rate_hour", f"SELECT cast(hour(ts) as int) AS hour, {R('100 * avg(is_alert)')} AS rate FROM readings GROUP BY 1")
def anomaly_rate_hour(t: Tables):
    return t.readings.groupBy(F.hour("ts").alias("hour")).agg(r(100 * F.avg("is_alert")).alias("rate"))


@query("correlation", _union(f"SELECT '{a}' AS a, '{b}' AS b, {R(f'corr({a}, {b})')} AS corr FROM readings"
                             for i, a in enumerate(NUM) for b in NUM[i + 1:]))
def correlation(t: Tables):
    return p.correlation_matrix(t.readings, NUM).select("a", "b", r("corr").alias("corr"))


@query("iqr_outliers", _union(
    f"SELECT '{c}' AS feature, cast(sum(cast({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1) as int)) as bigint) AS outliers, "
    f"{R(f'100.0 * sum(cast({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1) as int)) / count(*)')} AS pct, "
    f"{R('max(q1 - 1.5 * (q3 - q1))')} AS lower_bound, {R('max(q3 + 1.5 * (q3 - q1))')} AS upper_bound "
    f"FROM readings, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM readings) q" for c in NUM))
def iqr_outliers(t: Tables):
    out = p.iqr_outliers(t.readings, NUM)
    return out.select("feature", "outliers", *[r(c).alias(c) for c in ("pct", "lower_bound", "upper_bound")])


@query("histogram", """SELECT is_alert, cast(least(floor((tension_v - lo) / ((hi - lo) / 50)), 49) as int) AS bin, count(*) AS n
FROM readings, (SELECT min(tension_v) lo, max(tension_v) hi FROM readings) q GROUP BY 1, 2""")
def histogram(t: Tables):
    return p.histogram(t.readings, "tension_v", 50, ["is_alert"])


@query("log_histogram", """WITH l AS (SELECT log10(greatest(consommation_kw, 1e-9)) AS x FROM readings)
SELECT cast(least(floor((x - lo) / ((hi - lo) / 100)), 99) as int) AS bin, count(*) AS n FROM l, (SELECT min(x) lo, max(x) hi FROM l) q GROUP BY 1""")
def log_histogram(t: Tables):
    return p.log_histogram(t.readings, "consommation_kw", 100)


view("type_stats", """SELECT type, avg(consommation_kw) AS mean, stddev_samp(consommation_kw) AS std, quantile_cont(consommation_kw, 0.95) AS q95 FROM readings GROUP BY type""")
view("global_stats", """SELECT avg(consommation_kw) AS mean, stddev_samp(consommation_kw) AS std, quantile_cont(consommation_kw, 0.95) AS q95 FROM readings""")


@query("baseline_stats", f"""SELECT type, {R('mean')} AS mean, {R('std')} AS std, {R('q95')} AS q95 FROM type_stats
UNION ALL SELECT 'ALL', {R('mean')}, {R('std')}, {R('q95')} FROM global_stats""")
def baseline_stats(t: Tables):
    out = p.baseline_stats(t.readings)
    return out.select(F.coalesce("type", F.lit("ALL")).alias("type"), *[r(c).alias(c) for c in ("mean", "std", "q95")])


@query("grid_status", f"""SELECT count(*) AS total_meters, cast(sum(cast(status = 'online' as int)) as bigint) AS online_meters,
  cast(sum(cast(status = 'offline' as int)) as bigint) AS offline_meters, {R('avg(voltage)', 2)} AS avg_voltage, {R('sum(power)', 2)} AS total_power,
  (SELECT count(*) FROM alerts WHERE NOT is_resolved) AS active_alerts FROM meters""")
def grid_status(t: Tables):
    return p.grid_status(t.meters, t.alerts)


@query("meter_status", f"""SELECT count(*) AS total_readings, cast(sum(is_alert) as bigint) AS total_alerts, {R('100.0 * sum(is_alert) / count(*)', 2)} AS alert_rate,
  (SELECT string_agg(statut || '=' || n, ',' ORDER BY statut) FROM (SELECT statut, count(*) n FROM readings GROUP BY statut)) AS status_counts,
  (SELECT string_agg(type || '=' || n, ',' ORDER BY type) FROM (SELECT type, count(*) n FROM readings GROUP BY type)) AS meter_types FROM readings""")
def meter_status(t: Tables):
    def text(c):
        return F.array_join(F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias(c)

    return p.meter_status(t.readings).select("total_readings", "total_alerts", "alert_rate", text("status_counts"), text("meter_types"))


view("bus_latest", """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY bus_id ORDER BY ts DESC, event_id DESC) AS rn FROM readings) WHERE rn = 1""")
BUS = ["bus_id", "ts", "event_id", "type", "consommation_kw", "tension_v", "frequency_hz", "attack_type"]


@query("grid_totals", f"""SELECT {R('sum(consommation_kw)')} AS total_kw, {R('avg(tension_v)')} AS avg_voltage, {R('avg(frequency_hz)')} AS avg_frequency,
  cast(sum(cast(attack_type <> 'normal' as int)) as bigint) AS attacks FROM bus_latest""")
def grid_totals(t: Tables):
    out = p.grid_totals(t.readings.select(*BUS))
    return out.select(*[r(c).alias(c) for c in ("total_kw", "avg_voltage", "avg_frequency")], "attacks")


@query("load_mix", f"SELECT type, {R('sum(consommation_kw)')} AS kw FROM bus_latest GROUP BY type")
def load_mix(t: Tables):
    return p.load_mix(t.readings.select(*BUS)).select("type", r("kw").alias("kw"))


@query("threat_level", """SELECT zone, CASE WHEN sum(cast(attack_type = 'dos' AND tension_v > 265 as int)) > 0 THEN 'critical' WHEN sum(cast(attack_type = 'fdia' as int)) > 0 THEN 'warning' ELSE 'ok' END AS level,
  cast(ts as date) AS day FROM readings GROUP BY zone, cast(ts as date)""")
def threat_level(t: Tables):
    attacks = F.sum(((F.col("attack_type") == "dos") & (F.col("tension_v") > 265)).cast("int"))
    alerts = F.sum((F.col("attack_type") == "fdia").cast("int"))
    return t.readings.groupBy("zone", F.col("ts").cast("date").alias("day")).agg(p.threat_level(attacks, alerts).alias("level"))


@query("consumption_by_type", f"SELECT CASE WHEN is_alert = 1 THEN 'attack' ELSE 'clean' END AS source, type, {R('avg(consommation_kw)')} AS kw FROM readings GROUP BY 1, 2")
def consumption_by_type(t: Tables):
    source = F.when(F.col("is_alert") == 1, "attack").otherwise("clean").alias("source")
    return t.readings.groupBy(source, "type").agg(r(F.avg("consommation_kw")).alias("kw"))


@query("attack_distribution", "SELECT attack_type, anomalies, count(*) AS n FROM readings WHERE is_alert = 1 GROUP BY 1, 2")
def attack_distribution(t: Tables):
    return t.readings.filter("is_alert = 1").groupBy("attack_type", "anomalies").agg(F.count(F.lit(1)).alias("n"))


@query("dataset_metadata", f"""SELECT count(*) AS total_rows, cast(sum(1 - is_alert) as bigint) AS clean_rows, cast(sum(is_alert) as bigint) AS attack_rows, {R('100.0 * sum(is_alert) / count(*)')} AS attack_pct,
  count(DISTINCT bus_id) AS buses, count(DISTINCT meter_id) AS meters, min(ts) AS first_ts, max(ts) AS last_ts FROM readings""")
def dataset_metadata(t: Tables):
    n = F.count(F.lit(1))
    alerts = F.sum("is_alert").cast("long")
    # distinct counts over already distinct pairs: the readings shuffle one row per (bus, meter) and task
    pairs = t.readings.select("bus_id", "meter_id").distinct()
    d = pairs.agg(F.countDistinct("bus_id").alias("buses"), F.countDistinct("meter_id").alias("meters"))
    out = t.readings.agg(n.alias("total_rows"), (n - alerts).alias("clean_rows"), alerts.alias("attack_rows"),
                         r(100.0 * alerts / n).alias("attack_pct"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    return p.with_scalars(out, d)


@query("load_by_bus", f"""SELECT cast(b.bus_id as int) AS bus_id, coalesce({R('x.mw')}, 0.0) AS mw FROM (SELECT unnest(range(1, 15)) AS bus_id) b
LEFT JOIN (SELECT bus_id, sum(consommation_kw) / 1000 AS mw FROM readings WHERE hour(ts) = 18 GROUP BY bus_id) x ON b.bus_id = x.bus_id""")
def load_by_bus(t: Tables):
    mw = t.readings.filter(F.hour("ts") == 18).groupBy("bus_id").agg(r(F.sum("consommation_kw") / 1000).alias("mw"))
    buses = t.spark.range(1, 15).select(F.col("id").cast("int").alias("bus_id"))
    return cleaning.complete_domain(mw, buses, "bus_id", {"mw": F.lit(0.0)})


view("rollup", """SELECT l_orderkey, sum(l_quantity) AS declared_kw, cast(sum(cast(l_returnflag <> 'N' as int)) as bigint) AS active_devices, max(l_quantity) AS peak_kw FROM lineitem GROUP BY l_orderkey""")


def _rollup(t: Tables):
    return p.device_rollup(t.raw("lineitem").select("l_orderkey", "l_quantity", "l_returnflag"), ["l_orderkey"], "l_quantity", F.col("l_returnflag") != "N")


@query("device_rollup", "SELECT * FROM rollup")
def device_rollup(t: Tables):
    return _rollup(t)


@query("unexplained_load", f"""SELECT o_orderkey, {R('greatest(o_totalprice / 1000 - (d.declared_kw - d.active_devices), 0)')} AS unexplained_kw
FROM orders JOIN rollup d ON o_orderkey = d.l_orderkey""")
def unexplained_load(t: Tables):
    joined = t.raw("orders").select("o_orderkey", "o_totalprice").join(_rollup(t), F.col("o_orderkey") == F.col("l_orderkey"))
    return joined.select("o_orderkey", r(p.unexplained(F.col("o_totalprice") / 1000, F.col("declared_kw"), F.col("active_devices").cast("double"))).alias("unexplained_kw"))


@query("latency_percentiles", "SELECT event_type, " + ", ".join(f"{R(f'quantile_cont(value, {x / 100})')} AS p{x}" for x in (50, 90, 95, 99)) + " FROM events GROUP BY event_type")
def latency_percentiles(t: Tables):
    out = percentiles(t.events, ["event_type"], {f"p{x}": ("value", x / 100) for x in (50, 90, 95, 99)})
    return out.select("event_type", *[r(f"p{x}").alias(f"p{x}") for x in (50, 90, 95, 99)])


@query("telemetry_summary", f"""SELECT meter_id, count(*) AS n, {R('avg(consommation_kw)')} AS avg, {R('max(consommation_kw)')} AS peak, {R('arg_min(consommation_kw, ts)')} AS start,
  {R('arg_max(consommation_kw, ts)')} AS "end", {R('arg_max(consommation_kw, ts) - arg_min(consommation_kw, ts)')} AS growth FROM readings GROUP BY meter_id""")
def telemetry_summary(t: Tables):
    out = p.telemetry(t.readings, ["meter_id"], "consommation_kw", ["ts", "event_id"])
    return out.select("meter_id", "n", *[r(c).alias(c) for c in ("avg", "peak", "start", "end", "growth")])


@query("bottleneck", f"""WITH m AS (SELECT event_type, avg(value) AS mean FROM events GROUP BY event_type)
SELECT arg_max(event_type, mean) AS slowest, {R('max(mean)')} AS slowest_mean, arg_min(event_type, mean) AS fastest, {R('min(mean)')} AS fastest_mean, {R('max(mean) / min(mean)')} AS ratio FROM m""")
def bottleneck(t: Tables):
    out = p.bottleneck(t.events, "event_type", "value")
    return out.select("slowest", r("slowest_mean").alias("slowest_mean"), "fastest", r("fastest_mean").alias("fastest_mean"), r("ratio").alias("ratio"))


def _skew_sql(x: str) -> str:
    # population skewness from central moments
    return R(f"(SELECT avg(power({x} - m, 3)) / power(avg(power({x} - m, 2)), 1.5) FROM scored, (SELECT avg({x}) AS m FROM scored) q)")


@query("score_skew", f"SELECT {_skew_sql('score')} AS raw, {_skew_sql('ln(1 + score)')} AS log1p, {_skew_sql('ln(score + 1e-6)')} AS log_eps")
def score_skew(t: Tables):
    s = F.col("score")
    return t.scored.agg(r(F.skewness(s)).alias("raw"), r(F.skewness(F.log1p(s))).alias("log1p"), r(F.skewness(F.log(s + 1e-6))).alias("log_eps"))


@query("share_entropy", f"""WITH s AS (SELECT hour(ts) AS h, sum(consommation_kw) AS part FROM readings GROUP BY 1), q AS (SELECT sum(part) AS whole, count(*) AS groups FROM s)
SELECT {R('sum(-(part / whole) * ln(part / whole + 1e-12)) / ln(max(groups))')} AS entropy, {R('avg(cast(part / whole < 0.5 / groups as double))')} AS sparsity, max(groups) AS groups FROM s, q""")
def share_entropy(t: Tables):
    out = p.normalized_entropy(t.readings.withColumn("h", F.hour("ts")), "consommation_kw", "h")
    return out.select(r("entropy").alias("entropy"), r("sparsity").alias("sparsity"), "groups")


@query("allocate_load", f"""
WITH x AS (SELECT cast(ts as date) AS key, sum(consommation_kw) AS total_kw, sum(tension_v) AS charge, sum(cast(300 as double)) AS capacity FROM readings GROUP BY 1),
y AS (SELECT key, least(greatest(total_kw * 0.34 + 10, 8), 85) AS base, least(greatest(charge / greatest(capacity, 1), 0), 1) AS ratio FROM x),
w AS (SELECT unnest(range(1, 15)) AS bus_id, unnest({p.BUS_WEIGHTS}::double[]) AS weight)
SELECT key, cast(bus_id as int) AS bus_id, {R('base * weight')} AS consumption, {R('ratio')} AS charge_ratio,
  {R('0.992 + 0.03 * ratio - 0.015 * greatest(base * weight / 10 - 1, 0)')} AS voltage FROM y, w""")
def allocate_load(t: Tables):
    x = t.readings.groupBy(F.col("ts").cast("date").alias("key")).agg(
        F.sum("consommation_kw").alias("total_kw"), F.sum("tension_v").alias("charge"), F.sum(F.lit(300.0)).alias("capacity"))
    return p.allocate_load(x).select("key", "bus_id", *[r(c).alias(c) for c in ("consumption", "charge_ratio", "voltage")])


@query("class_separation", f"""
WITH c AS (SELECT label, unnest(range(0, 64)) AS dim, unnest(embedding)::double AS x FROM embeddings),
s AS (SELECT label, dim, avg(x) AS m, stddev_pop(x) AS s FROM c GROUP BY 1, 2)
SELECT a.label AS class_a, b.label AS class_b, {R('sqrt(sum(power(a.m - b.m, 2)))', 5)} AS distance, {R('sqrt(sum(power(a.m - b.m, 2))) / ((SELECT avg(s) FROM s) + 1e-9)', 5)} AS separation
FROM s a JOIN s b ON a.dim = b.dim AND a.label < b.label GROUP BY 1, 2""")
def class_separation(t: Tables):
    rows = t.raw("embeddings").select("label", F.col("embedding").cast("array<double>").alias("v"))
    out = p.class_separation(rows, "v", "label")
    return out.select("class_a", "class_b", r("distance", 5).alias("distance"), r("separation", 5).alias("separation"))


@query("ranked_results", f"""
WITH m AS (SELECT zone, type, avg(cast((score >= 0.6) = (label = 1) as double)) AS acc FROM scored GROUP BY 1, 2), b AS (SELECT avg(cast((score >= 0.6) = (label = 1) as double)) AS acc FROM scored)
SELECT zone, type, {R('m.acc')} AS accuracy, {R('m.acc - b.acc')} AS delta FROM m, b""")
def ranked_results(t: Tables):
    right = F.avg(((F.col("score") >= 0.6) == (F.col("label") == 1)).cast("double"))
    base = t.scored.agg(right)
    out = t.scored.groupBy("zone", "type").agg(right.alias("a"))
    return out.select("zone", "type", r("a").alias("accuracy"), r(F.col("a") - base.scalar()).alias("delta")).orderBy(F.desc("delta"))


@query("exported_results", BODIES["ranked_results"])
def exported_results(t: Tables):
    """The comparison table as a CSV export, read back."""
    return export_csv(ranked_results(t), scratch_dir(t.spark, "results"))


@query("threshold_coverage", f"""WITH n AS (SELECT meter_id, count(*) AS n FROM scored WHERE label = 0 GROUP BY meter_id)
SELECT count(*) AS meters, cast(sum(cast(n >= 30 as int)) as bigint) AS adaptive_meters, {R('(SELECT quantile_cont(score, 0.98) FROM scored WHERE label = 0)')} AS global_threshold FROM n""")
def threshold_coverage(t: Tables):
    normal = t.scored.filter("label = 0").select("meter_id", "score")
    glob = percentiles(normal, [], {"q": ("score", 0.98)})
    per = normal.groupBy("meter_id").agg(F.count(F.lit(1)).alias("n"))
    out = per.agg(F.count(F.lit(1)).alias("meters"), p.total(F.col("n") >= 30).alias("adaptive_meters"))
    return out.select("meters", "adaptive_meters", r(glob.scalar()).alias("global_threshold"))
