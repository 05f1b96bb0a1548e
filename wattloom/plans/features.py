"""Feature and time-series queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expr import clip, r
from ..operators import features as f
from ..operators.series import over_series
from ..sources.readings import Tables
from .registry import R, query, view

MEASURES = ["consommation_kw", "tension_v", "courant_a"]
TRAINED = ["consommation_kw", "solar_kw", "tension_v", "humidity", "power_factor"]
W = "WINDOW w AS (PARTITION BY meter_id ORDER BY ts, event_id)"


def rounded(df, keep, cols, digits=6):
    return df.select(*keep, *[r(c, digits).alias(c) for c in cols])


@query("temporal_features", f"""
SELECT event_id, cast(hour(ts) as int) AS hour, cast(isodow(ts) - 1 as int) AS day_of_week, cast(isodow(ts) >= 6 as int) AS is_weekend,
  {R('sin(2 * pi() * hour(ts) / 24)')} AS hour_sin, {R('cos(2 * pi() * hour(ts) / 24)')} AS hour_cos FROM readings""")
def temporal_features(t: Tables):
    return rounded(f.temporal(t.readings), ["event_id", "hour", "day_of_week", "is_weekend"], ["hour_sin", "hour_cos"])


@query("pseudo_time", """
SELECT l_orderkey, l_linenumber, l_suppkey, cast((rn - 1) % 24 as int) AS hour, cast(((rn - 1) // 24) % 7 as int) AS day_of_week
FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) AS rn FROM lineitem)""")
def pseudo_time(t: Tables):
    rows = t.raw("lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")
    return f.pseudo_time(rows, ["l_suppkey"], ["l_orderkey", "l_linenumber", "l_partkey"]).drop("l_partkey")


@query("electrical_features", f"""
SELECT event_id, {R('abs(tension_v - 230)')} AS voltage_deviation_230, {R('tension_v / 230')} AS voltage_nominal_ratio,
  {R('CASE WHEN tension_v = 0 THEN 0 ELSE courant_a / tension_v END')} AS current_voltage_ratio,
  {R('CASE WHEN tension_v * courant_a = 0 THEN 1.0 ELSE least(greatest(consommation_kw / (tension_v * courant_a / 1000), 0), 1.1) END')} AS power_factor,
  {R('consommation_kw * 1000 / greatest(tension_v, 1)')} AS current_from_power FROM readings""")
def electrical_features(t: Tables):
    cols = f.electrical()
    return rounded(t.readings.withColumns(cols), ["event_id"], list(cols))


@query("label_encode", """
SELECT event_id, cast(dense_rank() OVER (ORDER BY zone) - 1 as int) AS zone_encoded, cast(dense_rank() OVER (ORDER BY type) - 1 as int) AS type_encoded FROM readings""")
def label_encode(t: Tables):
    return f.label_codes(f.label_codes(t.readings, "zone", "zone_encoded"), "type", "type_encoded").select("event_id", "zone_encoded", "type_encoded")


ZONES, TYPES = ["Zone A", "Zone B", "Zone C", "Zone D"], ["commercial", "industriel", "residentiel"]


@query("one_hot", "SELECT event_id, " + ", ".join(
    [f"cast(zone = '{z}' as double) AS zone_{z.lower().replace(' ', '_')}" for z in ZONES]
    + [f"cast(type = '{x}' as double) AS type_{x}" for x in TYPES]) + " FROM readings")
def one_hot(t: Tables):
    cols = {**f.one_hot("zone", ZONES, "zone"), **f.one_hot("type", TYPES, "type")}
    return t.readings.select("event_id", *[c.alias(n) for n, c in cols.items()])


NUMERIC = ["consommation_kw", "tension_v", "frequency_hz", "power_factor", "courant_a"]


@query("feature_selection", " UNION ALL ".join(f"SELECT '{c}' AS feature, {R(f'avg({c})')} AS mean FROM readings" for c in NUMERIC))
def feature_selection(t: Tables):
    cols = f.feature_columns(t.readings, {"is_alert", "event_id", "bus_id"})
    means = t.readings.agg(*[F.avg(c).alias(c) for c in cols]).unpivot([], cols, "feature", "mean")
    return means.select("feature", r("mean").alias("mean"))


@query("align_features", f"""SELECT event_id, {R('consommation_kw')} AS consommation_kw, cast(0 as double) AS solar_kw, {R('tension_v')} AS tension_v,
  cast(0 as double) AS humidity, {R('power_factor')} AS power_factor FROM readings""")
def align_features(t: Tables):
    return rounded(f.align(t.readings.select("event_id", *MEASURES, "power_factor"), TRAINED), ["event_id"], TRAINED)


def _std_sql(source: str, stats: str, floor: str | None = None) -> str:
    def z(c):
        s = f"greatest(s_{c}, {floor})" if floor else f"CASE WHEN s_{c} = 0 THEN 1 ELSE s_{c} END"
        return R(f"({c} - m_{c}) / ({s})") + f" AS {c}"
    parts = ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in MEASURES)
    return f"SELECT event_id, {', '.join(z(c) for c in MEASURES)} FROM {source}, (SELECT {parts} FROM {stats}) q"


@query("standardize", _std_sql("readings", "readings"))
def standardize(t: Tables):
    return rounded(f.standardize(t.readings.select("event_id", *MEASURES), MEASURES), ["event_id"], MEASURES)


@query("standardize_train_only", _std_sql("readings", "(SELECT * FROM readings WHERE ts < TIMESTAMP '2024-01-22')", "1e-8"))
def standardize_train_only(t: Tables):
    rows = t.readings.select("event_id", "ts", *MEASURES)
    stats = f.scaler_stats(rows.filter("ts < TIMESTAMP_NTZ '2024-01-22 00:00:00'"), MEASURES)
    return rounded(f.standardize(rows, MEASURES, stats, floor=1e-8), ["event_id"], MEASURES)


VAR_COLS = ["consommation_kw", "tension_v", "courant_a", "frequency_hz", "power_factor"]


@query("topk_variance", "SELECT feature, variance, position FROM (SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {R(f'var_pop({c})')} AS variance, cast({i + 1} as int) AS position FROM readings" for i, c in enumerate(VAR_COLS))
    + ") ORDER BY variance DESC, position LIMIT 3)")
def topk_variance(t: Tables):
    return f.top_variance(t.readings, VAR_COLS, 3).select("feature", r("variance").alias("variance"), "position")


@query("meter_diff", f"""SELECT event_id, {R('coalesce(consommation_kw - lag(consommation_kw) OVER w, 0)')} AS kw_diff,
  {R('coalesce(tension_v - lag(tension_v) OVER w, 0)')} AS v_diff FROM readings {W}""")
def meter_diff(t: Tables):
    out = over_series(t.readings, f.METER, f.ORDER, lambda w: {"kw_diff": f.diff(w, "consommation_kw"), "v_diff": f.diff(w, "tension_v")}, back=1)
    return rounded(out, ["event_id"], ["kw_diff", "v_diff"])


@query("meter_pct_change", f"""SELECT event_id, {R('CASE WHEN p IS NULL OR p = 0 THEN 0 ELSE (consommation_kw - p) / p END')} AS kw_rate
FROM (SELECT event_id, consommation_kw, lag(consommation_kw) OVER w AS p FROM readings {W})""")
def meter_pct_change(t: Tables):
    out = over_series(t.readings, f.METER, f.ORDER, lambda w: {"kw_rate": f.pct_change(w, "consommation_kw")}, back=1)
    return rounded(out, ["event_id"], ["kw_rate"])


def _roll(fn: str, name: str, ks: tuple[int, ...]) -> str:
    cols = [f"{R(f'coalesce({fn}({c}) OVER (PARTITION BY meter_id ORDER BY ts, event_id ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW), 0)')} AS {n}_{name}_{k}"
            for c, n in (("consommation_kw", "kw"), ("tension_v", "v")) for k in ks]
    return f"SELECT event_id, {', '.join(cols)} FROM readings"


def _rolling(t: Tables, fn, name, ks):
    cols = [(c, n, k) for c, n in (("consommation_kw", "kw"), ("tension_v", "v")) for k in ks]
    out = over_series(t.readings, f.METER, f.ORDER, lambda w: {f"{n}_{name}_{k}": fn(w, c, k) for c, n, k in cols}, back=max(ks) - 1)
    return rounded(out, ["event_id"], [f"{n}_{name}_{k}" for _, n, k in cols])


@query("rolling_mean", _roll("avg", "mean", (3, 5, 6)))
def rolling_mean(t: Tables):
    return _rolling(t, f.rolling_mean, "mean", (3, 5, 6))


@query("rolling_std", _roll("stddev_samp", "std", (3, 6)))
def rolling_std(t: Tables):
    return _rolling(t, f.rolling_std, "std", (3, 6))


FEATURE_NAMES = [f"{c}_{x}" for c in MEASURES for x in ("diff", "rolling_mean_3", "rolling_std_3", "rolling_mean_6", "rolling_std_6")]


@query("meter_features", "SELECT event_id, " + ", ".join(
    f"{R(f'coalesce({c} - lag({c}) OVER (PARTITION BY meter_id ORDER BY ts, event_id), 0)')} AS {c}_diff, " + ", ".join(
        f"{R(f'coalesce({fn}({c}) OVER (PARTITION BY meter_id ORDER BY ts, event_id ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW), 0)')} AS {c}_rolling_{n}_{k}"
        for k in (3, 6) for fn, n in (("avg", "mean"), ("stddev_samp", "std"))) for c in MEASURES) + " FROM readings")
def meter_features(t: Tables):
    return rounded(f.meter_features(t.readings, MEASURES), ["event_id"], FEATURE_NAMES)


@query("generic_rolling", f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  {R('coalesce(l_quantity - lag(l_quantity) OVER w, 0)')} AS quantity_diff, {R('avg(l_quantity) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)')} AS quantity_mean_3,
  {R('coalesce(stddev_samp(l_quantity) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 0)')} AS quantity_std_3
FROM lineitem WINDOW w AS (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate)""")
def generic_rolling(t: Tables):
    rows = t.raw("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_quantity")
    out = over_series(rows, [], ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"], lambda w: {
        "quantity_diff": f.diff(w, "l_quantity"), "quantity_mean_3": f.rolling_mean(w, "l_quantity", 3), "quantity_std_3": f.rolling_std(w, "l_quantity", 3)}, back=2)
    return rounded(out, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], ["quantity_diff", "quantity_mean_3", "quantity_std_3"])


@query("zone_mean", f"""SELECT event_id, {R('avg(consommation_kw) OVER (PARTITION BY date_trunc(\'hour\', ts), zone)')} AS zone_consumption_mean,
  {R('consommation_kw - avg(consommation_kw) OVER (PARTITION BY date_trunc(\'hour\', ts), zone)')} AS meter_vs_zone_consumption FROM readings""")
def zone_mean(t: Tables):
    out = f.zone_mean(t.readings, F.date_trunc("hour", "ts"))
    return rounded(out, ["event_id"], ["zone_consumption_mean", "meter_vs_zone_consumption"])


@query("zone_asof_mean", f"""
SELECT event_id, zone_meters, s::double / 1000000 / zone_meters AS zone_asof_mean FROM (
  SELECT event_id, sum(step) OVER z AS s, cast(sum(first) OVER z as bigint) AS zone_meters FROM (
    SELECT *, cast(round(consommation_kw * 1000000) as bigint) - coalesce(lag(cast(round(consommation_kw * 1000000) as bigint)) OVER w, 0) AS step, cast(lag(consommation_kw) OVER w IS NULL as int) AS first
    FROM readings {W}) WINDOW z AS (PARTITION BY zone ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))""")
def zone_asof_mean(t: Tables):
    out = f.zone_asof_mean(t.readings.select("event_id", "ts", "zone", "meter_id", "consommation_kw"))
    return out.select("event_id", "zone_meters", "zone_asof_mean")


ACF_LAGS = 10


@query("autocorrelation", f"""
WITH s AS (SELECT meter_id, avg(consommation_kw) m, stddev_pop(consommation_kw) sd, count(*) n FROM readings GROUP BY meter_id HAVING stddev_pop(consommation_kw) >= 1e-9 AND count(*) >= 12),
x AS (SELECT r.meter_id, ts, event_id, consommation_kw - m AS x FROM readings r JOIN s ON r.meter_id = s.meter_id),
l AS (SELECT meter_id, x, k, lag(x, cast(k as int)) OVER (PARTITION BY meter_id, k ORDER BY ts, event_id) AS lx FROM x, (SELECT unnest(range(0, {ACF_LAGS + 1})) AS k))
SELECT cast(k as int) AS lag, {R('avg(a)')} AS acf FROM (SELECT meter_id, k, sum(x * lx) / sum(x * x) AS a FROM l GROUP BY meter_id, k) GROUP BY k""")
def autocorrelation(t: Tables):
    out = f.autocorrelation(t.readings.select("event_id", "ts", "meter_id", "consommation_kw"), "consommation_kw", ACF_LAGS)
    return out.select("lag", r("acf").alias("acf"))


SEQ = 8
view("window8", f"""SELECT *, count(*) OVER f AS n_in, first_value(ts) OVER f AS start_ts, first_value(zone) OVER f AS first_zone, first_value(type) OVER f AS first_type,
  avg(consommation_kw) OVER f AS kw_mean, min(tension_v) OVER f AS v_min, max(is_alert) OVER f AS label_any, cast(avg(is_alert) OVER f >= 0.5 as int) AS label_majority
FROM readings WINDOW f AS (PARTITION BY meter_id ORDER BY ts, event_id ROWS BETWEEN {SEQ - 1} PRECEDING AND CURRENT ROW)""")


def windows8(readings):
    cols = ["event_id", "ts", "meter_id", "zone", "type", "is_alert", "consommation_kw", "tension_v"]
    return f.sliding_windows(readings.select(*cols), f.METER, SEQ, ["consommation_kw", "tension_v"])


@query("sliding_windows", f"""SELECT event_id, meter_id, start_ts, ts AS end_ts, first_zone, first_type, {R('kw_mean')} AS kw_mean, {R('v_min')} AS v_min,
  {SEQ} AS n_steps FROM window8 WHERE n_in = {SEQ}""")
def sliding_windows(t: Tables):
    steps = F.col("steps")
    kw_sum = F.aggregate(steps, F.lit(0.0), lambda acc, x: acc + x["consommation_kw"])
    v_min = F.array_min(F.transform(steps, lambda x: x["tension_v"]))
    return windows8(t.readings).select("event_id", "meter_id", "start_ts", "end_ts", "first_zone", "first_type",
                                       r(kw_sum / SEQ).alias("kw_mean"), r(v_min).alias("v_min"), F.size("steps").alias("n_steps"))


@query("window_labels", f"SELECT event_id, is_alert AS label_last, label_any, label_majority FROM window8 WHERE n_in = {SEQ}")
def window_labels(t: Tables):
    return windows8(t.readings).select("event_id", "label_last", "label_any", "label_majority")


@query("tumbling_rows", f"""
SELECT meter_id, window_no, count(*) AS n, {R('sum(consommation_kw)')} AS kwh FROM (
  SELECT *, cast((row_number() OVER w - 1) // 30 as bigint) AS window_no, count(*) OVER (PARTITION BY meter_id) AS len FROM readings {W})
WHERE (window_no + 1) * 30 <= len GROUP BY meter_id, window_no""")
def tumbling_rows(t: Tables):
    out = f.tumbling_rows(t.readings.select("event_id", "ts", "meter_id", "consommation_kw"), f.METER, f.ORDER, 30)
    return out.groupBy("meter_id", "window_no").agg(F.count(F.lit(1)).alias("n"), r(F.sum("consommation_kw")).alias("kwh"))


@query("latest_per_bus", f"""SELECT bus_id, arg_max(event_id, ts) AS event_id, arg_max(meter_id, ts) AS meter_id, {R('arg_max(consommation_kw, ts)')} AS consommation_kw, max(ts) AS ts
FROM readings GROUP BY bus_id""")
def latest_per_bus(t: Tables):
    rows = t.readings.select("bus_id", "event_id", "meter_id", r("consommation_kw").alias("consommation_kw"), "ts")
    return f.latest_per_key(rows, "bus_id", ["ts", "event_id"])


@query("recent_n", "SELECT id, bus_id, severity, created_at FROM alerts WHERE NOT is_resolved ORDER BY created_at DESC, id DESC LIMIT 200")
def recent_n(t: Tables):
    return t.alerts.filter(~F.col("is_resolved")).select("id", "bus_id", "severity", "created_at").orderBy(F.desc("created_at"), F.desc("id")).limit(200)


@query("recent_n_per_key", """SELECT meter_id, event_id, ts, cast(rn as int) AS rn FROM (
  SELECT *, row_number() OVER (PARTITION BY meter_id ORDER BY ts DESC, event_id DESC) AS rn FROM readings) WHERE rn <= 8""")
def recent_n_per_key(t: Tables):
    return f.recent_per_key(t.readings.select("meter_id", "event_id", "ts"), "meter_id", f.ORDER, 8)


@query("temporal_quarters", """SELECT quarter, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM (
  SELECT ts, CASE WHEN i < n // 4 THEN 1 WHEN i < n // 2 THEN 2 WHEN i < 3 * n // 4 THEN 3 ELSE 4 END AS quarter
  FROM (SELECT ts, row_number() OVER (ORDER BY ts, event_id) - 1 AS i, count(*) OVER () AS n FROM readings)) GROUP BY quarter""")
def temporal_quarters(t: Tables):
    out = f.temporal_quarters(t.readings.select("ts", "event_id"), f.ORDER)
    return out.groupBy("quarter").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("windowed_counts", """SELECT date_trunc('hour', ts) AS hour_start, zone, statut, count(*) AS n FROM readings GROUP BY 1, 2, 3""")
def windowed_counts(t: Tables):
    hour = F.window("ts", "1 hour")["start"].cast("timestamp_ntz").alias("hour_start")
    return t.readings.groupBy(hour, "zone", "statut").agg(F.count(F.lit(1)).alias("n"))


@query("stale_runs", """
SELECT meter_id, count(*) AS run_rows, min(ts) AS start_ts, max(ts) AS end_ts, min(event_id) AS first_id FROM (
  SELECT *, sum(s) OVER (PARTITION BY meter_id ORDER BY ts, event_id) AS island FROM (
    SELECT *, coalesce(cast(abs(consommation_kw - lag(consommation_kw) OVER w) >= 2 as int), 1) AS s FROM readings WINDOW w AS (PARTITION BY meter_id ORDER BY ts, event_id)))
GROUP BY meter_id, island HAVING count(*) >= 3""")
def stale_runs(t: Tables):
    rows = t.readings.select("event_id", "ts", "meter_id", "consommation_kw")
    return f.stale_runs(rows, "consommation_kw", 2.0, 3).drop("island")


@query("alert_bursts", """
SELECT meter_id, count(*) AS burst_rows, min(ts) AS start_ts, max(ts) AS end_ts FROM (
  SELECT *, sum(s) OVER (PARTITION BY meter_id ORDER BY ts, event_id) AS island FROM (
    SELECT *, coalesce(cast(is_alert <> lag(is_alert) OVER w as int), 1) AS s FROM readings WINDOW w AS (PARTITION BY meter_id ORDER BY ts, event_id)))
WHERE is_alert = 1 GROUP BY meter_id, island""")
def alert_bursts(t: Tables):
    return f.alert_bursts(t.readings.select("event_id", "ts", "meter_id", "is_alert")).drop("island")


@query("freshness", """SELECT bus_id, max(ts) AS last_update, epoch(max(ts)) >= epoch((SELECT max(ts) FROM readings)) - 3600 AS live FROM readings GROUP BY bus_id""")
def freshness(t: Tables):
    # live: the last update lies within the hour before the newest reading of the table
    newest = t.readings.agg(F.max("ts").alias("t"))
    out = t.readings.groupBy("bus_id").agg(F.max("ts").alias("last_update"))
    return out.withColumn("live", F.col("last_update") >= newest.scalar() - F.expr("INTERVAL 1 HOUR"))


@query("series_slice", f"""(SELECT 'clean' AS source, event_id, ts, {R('consommation_kw')} AS consommation_kw FROM readings WHERE bus_id = 3 AND is_alert = 0 ORDER BY ts, event_id LIMIT 100)
UNION ALL (SELECT 'attack', event_id, ts, {R('consommation_kw')} FROM readings WHERE bus_id = 3 AND is_alert = 1 ORDER BY ts, event_id LIMIT 100)""")
def series_slice(t: Tables):
    rows = t.readings.filter("bus_id = 3").select("event_id", "ts", r("consommation_kw").alias("consommation_kw"), "is_alert")

    def first(flag, tag):
        return rows.filter(F.col("is_alert") == flag).orderBy("ts", "event_id").limit(100).select(F.lit(tag).alias("source"), "event_id", "ts", "consommation_kw")

    return first(0, "clean").unionByName(first(1, "attack"))


DAILY = ["kwh", "roll_mean_7", "roll_std_7", "diff", "dow_sin", "dow_cos", "mon_sin", "mon_cos"]


@query("daily_features", f"""
SELECT cons_no, day, {R('kwh')} AS kwh, {R('avg(kwh) OVER (w ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)')} AS roll_mean_7,
  {R('coalesce(stddev_samp(kwh) OVER (w ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 0)')} AS roll_std_7, {R('coalesce(kwh - lag(kwh) OVER w, 0)')} AS diff,
  {R('sin(2 * pi() * (isodow(day) - 1) / 7)')} AS dow_sin, {R('cos(2 * pi() * (isodow(day) - 1) / 7)')} AS dow_cos,
  {R('sin(2 * pi() * (month(day) - 1) / 12)')} AS mon_sin, {R('cos(2 * pi() * (month(day) - 1) / 12)')} AS mon_cos
FROM consumer_days WINDOW w AS (PARTITION BY cons_no ORDER BY day)""")
def daily_features(t: Tables):
    out = over_series(t.consumer_days, ["cons_no"], ["day"], lambda w: {
        "roll_mean_7": f.rolling_mean(w, "kwh", 7), "roll_std_7": f.rolling_std(w, "kwh", 7), "diff": f.diff(w, "kwh")}, back=6)
    return rounded(out.withColumns(f.cyclic_day()), ["cons_no", "day"], DAILY)
