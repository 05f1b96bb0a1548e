"""Scans, sinks, cleaning and validation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expr import r
from ..operators import cleaning as c
from ..session import scratch_dir
from ..sources import files
from ..sources.readings import Tables
from .registry import R, query, view


@query("scan_readings", f"""
SELECT event_id, ts AS "timestamp", meter_id, {R('consommation_kw')} AS consommation_kw, {R('courant_a')} AS courant_a, statut
FROM readings WHERE attack_type <> 'dos'""")
def scan_readings(t: Tables):
    # the lines of "dos" readings arrive with surplus fields: the malformed lines of the scan
    path = scratch_dir(t.spark, "readings-csv")
    line = F.concat_ws(",", *[F.col(x).cast("string") for x in (
        "event_id", "ts", "meter_id", "zone", "type", "consommation_kw", "tension_v", "courant_a", "statut")])
    t.readings.select(F.when(F.col("attack_type") == "dos", F.concat(line, F.lit(",x,y"))).otherwise(line).alias("value")).write.text(path)
    df = files.scan_readings_csv(t.spark, path, header=False)
    return df.select(
        "event_id", F.col("timestamp").cast("timestamp_ntz").alias("timestamp"), "meter_id",
        r("consommation_kw").alias("consommation_kw"), r("courant_a").alias("courant_a"), "statut")


@query("schema_dispatch", " UNION ALL ".join(f"SELECT '{n}' AS source, '{k}' AS kind, count(*) AS n FROM {n}" for n, k in (
    ("readings", "meter"), ("events", "generic"), ("lineitem", "generic"))))
def schema_dispatch(t: Tables):
    kinds = [(name, files.reading_kind(df)) for name, df in (("readings", t.readings), ("events", t.events), ("lineitem", t.raw("lineitem")))]
    counts = [df.agg(F.lit(name).alias("source"), F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("n"))
              for (name, kind), df in zip(kinds, (t.readings, t.events, t.raw("lineitem")))]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query("safe_csv_scan", f"SELECT meter_id, {R('sum(consommation_kw)', 3)} AS kwh FROM readings GROUP BY meter_id")
def safe_csv_scan(t: Tables):
    path = scratch_dir(t.spark, "safe-csv")
    t.readings.select("meter_id", "consommation_kw").write.option("header", "true").csv(path)
    schema = files.T.StructType([files.T.StructField("meter_id", files.T.StringType()),
                                 files.T.StructField("consommation_kw", files.T.DoubleType())])
    both = files.read_csv_safe(t.spark, path, schema).unionByName(files.read_csv_safe(t.spark, path + "-absent", schema))
    return both.groupBy("meter_id").agg(r(F.sum("consommation_kw"), 3).alias("kwh"))


@query("json_props", "SELECT event_id, cast(json_extract(props, '$.k') AS bigint) AS k, json_extract_string(props, '$.absent') AS absent FROM events")
def json_props(t: Tables):
    return t.events.select("event_id", files.json_object(F.col("props"), "k bigint, absent string").alias("o")).select("event_id", "o.k", "o.absent")


@query("merge_sources", f"""
SELECT event_id, ts AS "timestamp", bus_id, {R('tension_v / 230')} AS voltage_pu,
  CASE WHEN statut = 'NORMAL' THEN {R('frequency_hz')} ELSE 60.0::double END AS frequency_hz,
  {R('consommation_kw')} AS consumption_kw, CASE WHEN statut = 'NORMAL' THEN 'mixed' ELSE type END AS consumer_type,
  CASE WHEN statut = 'NORMAL' THEN 'normal' ELSE 'attack' END AS attack_type FROM readings""")
def merge_sources(t: Tables):
    base = t.readings.select("event_id", F.col("ts").alias("timestamp"), "bus_id", r(F.col("tension_v") / 230).alias("voltage_pu"),
                             r("frequency_hz").alias("frequency_hz"), r("consommation_kw").alias("consumption_kw"),
                             F.col("type").alias("consumer_type"), "statut")
    clean = base.filter("statut = 'NORMAL'").drop("statut", "consumer_type")
    attack = base.filter("statut = 'ALERTE'").drop("statut", "frequency_hz")
    defaults = {"frequency_hz": F.lit(60.0), "consumer_type": F.lit("mixed"), "attack_type": F.lit("normal"),
                "voltage_pu": F.lit(1.0), "consumption_kw": F.lit(0.0)}
    return c.merge_sources(clean, attack, defaults).orderBy("timestamp", "bus_id")


@query("complete_buses", f"""
SELECT cast(b.bus_id as int) AS bus_id, coalesce({R('m.voltage / 230')}, 1.0) AS voltage_pu, coalesce({R('m.power', 3)}, 0.0) AS consumption_kw,
  CASE WHEN m.bus_id IS NULL THEN 'mixed' ELSE 'metered' END AS consumer_type
FROM (SELECT unnest(range(1, 15)) AS bus_id) b LEFT JOIN (SELECT * FROM meters WHERE status = 'online') m ON b.bus_id = m.bus_id""")
def complete_buses(t: Tables):
    online = t.meters.filter("status = 'online'").select(
        "bus_id", r(F.col("voltage") / 230).alias("voltage_pu"), r("power", 3).alias("consumption_kw"), F.lit("metered").alias("consumer_type"))
    buses = t.spark.range(1, 15).select(F.col("id").cast("int").alias("bus_id"))
    return c.complete_domain(online, buses, "bus_id",
                             {"voltage_pu": F.lit(1.0), "consumption_kw": F.lit(0.0), "consumer_type": F.lit("mixed")})


@query("insert_ignore", """
WITH target AS (SELECT meter_id, min(id) AS ref_id, 'target' AS origin FROM alerts WHERE severity = 'critical' AND attack_type = 'dos' AND NOT is_resolved GROUP BY meter_id),
batch AS (SELECT meter_id, event_id AS ref_id, 'batch' AS origin FROM (SELECT *, row_number() OVER (PARTITION BY meter_id ORDER BY event_id) rn FROM readings) WHERE rn = 1)
SELECT * FROM target UNION ALL SELECT * FROM batch WHERE meter_id NOT IN (SELECT meter_id FROM target)""")
def insert_ignore(t: Tables):
    target = (t.alerts.filter("severity = 'critical' AND attack_type = 'dos' AND NOT is_resolved")
              .groupBy("meter_id").agg(F.min("id").alias("ref_id")).withColumn("origin", F.lit("target")))
    batch = t.readings.select("meter_id", F.col("event_id").alias("ref_id"), F.lit("batch").alias("origin"))
    return c.insert_ignore(target, batch, "meter_id", ["ref_id"])


@query("upsert_meters", f"""
WITH batch AS (SELECT bus_id, arg_max(tension_v, ts) AS voltage, arg_max(CASE WHEN statut = 'ALERTE' THEN NULL ELSE struct_pack(c := courant_a) END, ts) AS x,
  arg_max(CASE WHEN statut = 'ALERTE' THEN -1 ELSE courant_a END, ts) AS cur FROM readings GROUP BY bus_id)
SELECT m.bus_id, {R('coalesce(b.voltage, m.voltage)')} AS voltage,
  {R('CASE WHEN b.cur IS NULL OR b.cur < 0 THEN m.current_a ELSE b.cur END')} AS current_a, {R('m.power', 3)} AS power, m.status
FROM meters m LEFT JOIN batch b ON m.bus_id = b.bus_id""")
def upsert_meters(t: Tables):
    latest = t.readings.groupBy("bus_id").agg(F.max_by(F.struct("tension_v", "courant_a", "statut"), "ts").alias("x"))
    batch = latest.select("bus_id", F.col("x.tension_v").alias("voltage"),
                          F.when(F.col("x.statut") != "ALERTE", F.col("x.courant_a")).alias("current_a"),
                          F.lit(None).cast("double").alias("power"), F.lit(None).cast("string").alias("status"))
    out = c.upsert(t.meters, batch, "bus_id")
    return out.select("bus_id", r("voltage").alias("voltage"), r("current_a").alias("current_a"), r("power", 3).alias("power"), "status")


TABLE_NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@query("table_counts", " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS n FROM {n}" for n in TABLE_NAMES))
def table_counts(t: Tables):
    out = None
    for n in TABLE_NAMES:
        one = t.raw(n).agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("table_name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("normal_only", f"SELECT event_id, meter_id, ts, {R('consommation_kw')} AS consommation_kw FROM readings WHERE statut = 'NORMAL'")
def normal_only(t: Tables):
    path = scratch_dir(t.spark, "by-status")
    files.write_by_status(t.readings.select("event_id", "meter_id", "ts", r("consommation_kw").alias("consommation_kw"), "statut"), path)
    return t.spark.read.parquet(path).filter("statut = 'NORMAL'").drop("statut")


@query("audit_append", """
SELECT id, meter_id AS resource, concat('alert_', attack_type) AS action, CASE WHEN is_resolved THEN 200 ELSE 500 END AS status_code,
  cast(json_object('bus_id', bus_id, 'severity', severity) as varchar) AS details, created_at FROM alerts""")
def audit_append(t: Tables):
    path = scratch_dir(t.spark, "audit")
    log = t.alerts.select("id", F.col("meter_id").alias("resource"), F.concat(F.lit("alert_"), "attack_type").alias("action"),
                          F.when(F.col("is_resolved"), 200).otherwise(500).alias("status_code"),
                          F.to_json(F.struct("bus_id", "severity")).alias("details"), "created_at")
    files.append_log(log.filter("status_code = 500"), path)
    files.append_log(log.filter("status_code = 200"), path)
    return t.spark.read.parquet(path)


@query("resolve_alerts", """
SELECT id, bus_id, is_resolved OR severity = 'critical' AS is_resolved,
  CASE WHEN severity = 'critical' THEN created_at + INTERVAL 1 HOUR END AS resolved_at FROM alerts""")
def resolve_alerts(t: Tables):
    done = t.alerts.filter("severity = 'critical'").select("id", F.expr("created_at + INTERVAL 1 HOUR").alias("resolved_at"))
    joined = t.alerts.join(done, "id", "left")
    return joined.select("id", "bus_id", (F.col("is_resolved") | F.col("resolved_at").isNotNull()).alias("is_resolved"), "resolved_at")


@query("dedup_rows", "SELECT DISTINCT meter_id, cast(ts as date) AS day, statut FROM readings")
def dedup_rows(t: Tables):
    return t.readings.select("meter_id", F.col("ts").cast("date").alias("day"), "statut").dropDuplicates()


GAPPY = "CASE WHEN anomalies = 'Consommation nulle suspecte' THEN NULL ELSE consommation_kw END"


@query("clean_readings", f"SELECT event_id, meter_id, {R('consommation_kw')} AS consommation_kw FROM readings WHERE ({GAPPY}) IS NOT NULL AND tension_v IS NOT NULL")
def clean_readings(t: Tables):
    gappy = t.readings.withColumn("consommation_kw", F.expr(GAPPY))
    return c.drop_incomplete(gappy).select("event_id", "meter_id", r("consommation_kw").alias("consommation_kw"))


def _clip_pass(prev: str, col: str) -> str:
    return (f"SELECT x.* FROM {prev} x, (SELECT avg({col}) m, stddev_samp({col}) s FROM {prev}) q "
            f"WHERE {col} >= m - 3 * s AND {col} <= m + 3 * s")


@query("sigma_clip", f"""WITH a AS ({_clip_pass('readings', 'consommation_kw')}), b AS ({_clip_pass('a', 'tension_v')}), cc AS ({_clip_pass('b', 'courant_a')})
SELECT event_id, {R('consommation_kw')} AS consommation_kw, {R('courant_a')} AS courant_a FROM cc""")
def sigma_clip(t: Tables):
    # 3 sigma rather than the default 5, so that every pass removes rows of the test tables
    return c.sigma_clip(t.readings, k=3.0).select("event_id", r("consommation_kw").alias("consommation_kw"), r("courant_a").alias("courant_a"))


@query("parse_ts", "SELECT event_id, meter_id, ts FROM readings WHERE attack_type <> 'dos'")
def parse_ts(t: Tables):
    text = F.when(F.col("attack_type") == "dos", "not a time").otherwise(F.col("ts").cast("string"))
    parsed = t.readings.withColumn("text", text).withColumn("ts", F.try_to_timestamp("text").cast("timestamp_ntz"))
    return parsed.filter("ts IS NOT NULL").select("event_id", "meter_id", "ts").orderBy("meter_id", "ts", "event_id")


@query("median_fill", f"""
SELECT event_id, {R("coalesce(CASE WHEN attack_type = 'fdia' THEN NULL ELSE consommation_kw END, q.m)")} AS consommation_kw,
  {R("coalesce(CASE WHEN attack_type = 'dos' THEN NULL ELSE tension_v END, q.v)")} AS tension_v
FROM readings, (SELECT quantile_cont(CASE WHEN attack_type = 'fdia' THEN NULL ELSE consommation_kw END, 0.5) AS m,
  quantile_cont(CASE WHEN attack_type = 'dos' THEN NULL ELSE tension_v END, 0.5) AS v FROM readings) q""")
def median_fill(t: Tables):
    texts = t.readings.select(
        "event_id",
        F.when(F.col("attack_type") == "fdia", "n/a").otherwise(F.col("consommation_kw").cast("string")).alias("consommation_kw"),
        F.when(F.col("attack_type") == "dos", "").otherwise(F.col("tension_v").cast("string")).alias("tension_v"))
    out = c.median_fill(texts, ["consommation_kw", "tension_v"])
    return out.select("event_id", r("consommation_kw").alias("consommation_kw"), r("tension_v").alias("tension_v"))


RAW_LABEL = "CASE WHEN event_id % 3 = 0 THEN concat('  ', statut, ' ') WHEN is_alert = 0 AND event_id % 3 = 1 THEN 'Stable' ELSE cast(is_alert as string) END"


@query("label_norm", f"""SELECT event_id, CASE WHEN lower(trim(l)) IN ('normal', 'stable', '0', 'false', 'benign') THEN 0 ELSE 1 END AS label
FROM (SELECT event_id, {RAW_LABEL.replace('string', 'varchar')} AS l FROM readings)""")
def label_norm(t: Tables):
    return t.readings.select("event_id", c.is_anomalous_label(F.expr(RAW_LABEL)).alias("label"))


@query("label_any", """SELECT event_id, greatest(cast(statut = 'ALERTE' as int), cast(tension_v > 260 as int), cast(frequency_hz < 59.5 as int)) AS label FROM readings""")
def label_any(t: Tables):
    return t.readings.select("event_id", c.any_flag([F.col("statut") == "ALERTE", F.col("tension_v") > 260, F.col("frequency_hz") < 59.5]).alias("label"))


MESSY = "CASE WHEN event_id % 4 = 0 THEN ' NaN ' WHEN event_id % 4 = 1 THEN concat(' ', anomalies, ' ') ELSE anomalies END"


@query("clean_text", f"""SELECT event_id, CASE WHEN trim(x) = '' OR lower(trim(x)) = 'nan' THEN 'none' ELSE trim(x) END AS label
FROM (SELECT event_id, {MESSY} AS x FROM readings)""")
def clean_text(t: Tables):
    return t.readings.select("event_id", c.clean_text(F.expr(MESSY), "none").alias("label"))


@query("validate_readings", f"""
SELECT event_id, concat_ws(',', CASE WHEN NOT (pf BETWEEN 0 AND 1.2) THEN 'power_factor' END, CASE WHEN NOT (hz BETWEEN 0 AND 100) THEN 'frequency_hz' END) AS reasons,
  (pf BETWEEN 0 AND 1.2) AND (hz BETWEEN 0 AND 100) AS valid, {R('pf')} AS power_factor
FROM (SELECT event_id, CASE WHEN statut = 'ALERTE' THEN power_factor * 1.5 WHEN type = 'commercial' THEN 0.9 ELSE power_factor END AS pf,
  CASE WHEN anomalies = 'Fraude' THEN 120 ELSE frequency_hz END AS hz FROM readings)""")
def validate_readings(t: Tables):
    df = t.readings.withColumns({
        "power_factor": F.when(F.col("statut") == "ALERTE", F.col("power_factor") * 1.5).when(F.col("type") != "commercial", F.col("power_factor")),
        "frequency_hz": F.when(F.col("anomalies") == "Fraude", 120.0).otherwise(F.col("frequency_hz"))})
    df = c.with_reading_defaults(df).withColumn("why", c.validation_reasons())
    return df.select("event_id", F.array_join("why", ",").alias("reasons"), (F.size("why") == 0).alias("valid"), r("power_factor").alias("power_factor"))


@query("ts_union", """
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN TIMESTAMP '2030-01-01 00:00:00'
  WHEN event_id % 3 = 1 THEN date_trunc('second', ts) ELSE ts END AS ts FROM readings""")
def ts_union(t: Tables):
    ts = F.col("ts").cast("timestamp")
    text = F.when(F.col("event_id") % 3 == 1, F.unix_timestamp(ts).cast("string")).when(F.col("event_id") % 3 == 2, F.col("ts").cast("string"))
    return t.readings.select("event_id", c.union_timestamp(text, F.lit("2030-01-01 00:00:00")).alias("ts"))


@query("voltage_pu", f"""
SELECT event_id, {R('CASE WHEN x > 10 THEN x / 230 ELSE x END')} AS voltage
FROM (SELECT event_id, CASE WHEN statut = 'ALERTE' THEN tension_v ELSE tension_v / 240 END AS x FROM readings)""")
def voltage_pu(t: Tables):
    mixed = F.when(F.col("statut") == "ALERTE", F.col("tension_v")).otherwise(F.col("tension_v") / 240)
    return t.readings.select("event_id", r(c.per_unit_voltage(mixed)).alias("voltage"))


ZONE_TEXT = "CASE WHEN zone = 'Zone A' THEN ' Sector-A' WHEN zone = 'Zone B' THEN 'sector b ' WHEN type = 'industriel' THEN 'GARAGE' ELSE zone END"
BUS_OF_KEY = "CASE k WHEN 'sector_a' THEN 5 WHEN 'sector_b' THEN 8 WHEN 'sector_c' THEN 11 WHEN 'sector_d' THEN 14 WHEN 'perimeter' THEN 6 WHEN 'garage' THEN 4 WHEN 'entrance' THEN 3 END"
KEY_OF_TEXT = "replace(replace(lower(trim(z)), ' ', '_'), '-', '_')"


@query("zone_to_bus", f"""
SELECT k AS zone_key, coalesce({BUS_OF_KEY}, 0) AS bus_id, ({BUS_OF_KEY}) IS NULL AS unknown, count(*) AS n
FROM (SELECT {KEY_OF_TEXT} AS k FROM (SELECT {ZONE_TEXT} AS z FROM readings)) GROUP BY k""")
def zone_to_bus(t: Tables):
    z = t.readings.select(F.expr(ZONE_TEXT).alias("z"))
    out = z.groupBy(c.zone_key("z").alias("zone_key")).agg(F.count(F.lit(1)).alias("n"))
    bus = c.zone_bus("zone_key")
    return out.withColumn("unknown", bus.isNull()).withColumn("bus_id", F.coalesce(bus, F.lit(0)))


@query("meter_to_bus", """
SELECT meter_id, CASE WHEN try_cast(regexp_extract(meter_id, '(\\d+)', 1) AS int) BETWEEN 1 AND 14 THEN try_cast(regexp_extract(meter_id, '(\\d+)', 1) AS int) ELSE 1 END AS bus_id,
  count(*) AS n FROM readings GROUP BY meter_id""")
def meter_to_bus(t: Tables):
    return t.readings.groupBy("meter_id").agg(F.count(F.lit(1)).alias("n")).withColumn("bus_id", c.meter_bus("meter_id"))


@query("to_grid_state", f"""
SELECT event_id, bus_id, {R('tension_v / 230', 4)} AS voltage, {R('consommation_kw * 1000 / (230 * greatest(tension_v / 230, 0.1))', 2)} AS current,
  {R('frequency_hz', 3)} AS frequency, {R('consommation_kw', 3)} AS consumption, type AS consumer_type,
  CASE WHEN attack_type = 'dos' THEN 'fdia' ELSE attack_type END AS attack_type FROM readings""")
def to_grid_state(t: Tables):
    rows = t.readings.select("event_id", "bus_id", (F.col("tension_v") / 230).alias("voltage_pu"), F.col("consommation_kw").alias("consumption_kw"),
                             "frequency_hz", F.col("type").alias("consumer_type"),
                             F.when(F.col("attack_type") == "dos", "attack").otherwise(F.col("attack_type")).alias("attack_type"))
    out = c.grid_state(rows)
    return out.withColumns({x: r(x) for x in ("voltage", "current", "frequency", "consumption")})


SEV = "greatest(least(cast(event_id % 130 as double) / 99, 1.0), 0.01)"


@query("zone_event_class", f"SELECT event_id, {R(SEV)} AS severity, CASE WHEN {SEV} < 0.75 THEN 'fdia' ELSE 'dos' END AS attack_type FROM readings")
def zone_event_class(t: Tables):
    raw = (F.col("event_id") % 130).cast("double") / 99.0
    return t.readings.select("event_id", r(c.clamp_severity(raw)).alias("severity"), c.severity_class(raw).alias("attack_type"))


@query("zone_event_reading", f"""
WITH e AS (SELECT event_id, {KEY_OF_TEXT} AS k, motion, sev, v, kw FROM (SELECT event_id, {ZONE_TEXT} AS z, is_alert = 1 AS motion, {SEV} AS sev,
    CASE WHEN type <> 'commercial' THEN tension_v END AS v, CASE WHEN type <> 'industriel' THEN consommation_kw END AS kw FROM readings)),
f AS (SELECT event_id, {BUS_OF_KEY} AS bus_id, motion, sev, coalesce(v, CASE WHEN motion THEN 228.0 ELSE 230.0 END) AS v,
    coalesce(kw, CASE WHEN motion THEN round(2 + 8 * sev, 3) ELSE 1.2 END) AS kw FROM e)
SELECT event_id, bus_id, {R('CASE WHEN v > 10 THEN v / 230 ELSE v END', 4)} AS voltage, {R('CASE WHEN motion THEN kw * 1000 / greatest(v, 1.0) ELSE 2.5 END', 2)} AS current,
  {R('kw')} AS consumption, CASE WHEN NOT motion THEN 'normal' WHEN sev < 0.75 THEN 'fdia' ELSE 'dos' END AS attack_type,
  CASE WHEN motion THEN {R('0.5 + 0.5 * sev', 2)} END AS confidence, CASE WHEN motion THEN {R('10 + 40 * sev', 1)} END AS duration_s FROM f WHERE bus_id IS NOT NULL""")
def zone_event_reading(t: Tables):
    ev = t.readings.select("event_id", F.expr(ZONE_TEXT).alias("zone"), (F.col("is_alert") == 1).alias("motion_detected"),
                           ((F.col("event_id") % 130).cast("double") / 99.0).alias("severity"),
                           F.when(F.col("type") != "commercial", F.col("tension_v")).alias("voltage_v"),
                           F.when(F.col("type") != "industriel", F.col("consommation_kw")).alias("consumption_kw"))
    out = c.zone_event_state(ev)
    return out.withColumns({x: r(x) for x in ("voltage", "current", "consumption", "confidence", "duration_s")})


@query("constraint_violations", """
SELECT * FROM (SELECT id, 'severity' AS constraint_name FROM alerts WHERE severity NOT IN ('critical', 'high', 'medium', 'low')
UNION ALL SELECT id, 'confidence' FROM alerts WHERE NOT confidence BETWEEN 0 AND 0.95
UNION ALL SELECT id, 'bus_fk' FROM alerts WHERE bus_id NOT IN (SELECT bus_id FROM meters WHERE status = 'online'))""")
def constraint_violations(t: Tables):
    # the enum and the upper bound are tightened so that the test tables hold violations
    bad_enum = t.alerts.filter(~F.col("severity").isin("critical", "high", "medium", "low")).select("id", F.lit("severity").alias("constraint_name"))
    bad_range = t.alerts.filter(~F.col("confidence").between(0.0, 0.95)).select("id", F.lit("confidence").alias("constraint_name"))
    orphan = t.alerts.join(t.meters.filter("status = 'online'").select("bus_id"), "bus_id", "left_anti").select("id", F.lit("bus_fk").alias("constraint_name"))
    return bad_enum.unionByName(bad_range).unionByName(orphan)


@query("active_alerts", "SELECT id, bus_id, attack_type, severity FROM alerts WHERE NOT is_resolved AND attack_type <> 'normal'")
def active_alerts(t: Tables):
    return t.alerts.filter(~F.col("is_resolved") & (F.col("attack_type") != "normal")).select("id", "bus_id", "attack_type", "severity")


@query("meter_search", "SELECT meter_id, type, count(*) AS n FROM readings WHERE contains(lower(meter_id), '01') OR contains(lower(type), 'indus') GROUP BY meter_id, type")
def meter_search(t: Tables):
    hit = F.lower("meter_id").contains("01") | F.lower("type").contains("indus")
    return t.readings.filter(hit).groupBy("meter_id", "type").agg(F.count(F.lit(1)).alias("n"))
