"""Streaming queries; each drains its source and is compared with its batch twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expr import r
from ..operators import features as f, ledger as l, perturb as p
from ..operators.series import null_safe_join
from ..sources.readings import Tables, alerts_from_readings, scored_from_readings
from ..streaming import detector as dt, microbatch as m, sources as s, stateful as st
from .detect import PATHS, rounded_adaptive
from .ledger import NODES, SIZE
from .registry import BODIES, R, query, view


def live(t: Tables):
    return s.stream_readings(t.spark, t.folder)


@query("stream_append", f"SELECT event_id, meter_id, {R('consommation_kw')} AS consommation_kw, statut FROM readings")
def stream_append(t: Tables):
    return s.drain_to_table(live(t).select("event_id", "meter_id", r("consommation_kw").alias("consommation_kw"), "statut"), "append")


@query("stream_latest_bus", BODIES["latest_per_bus"])
def stream_latest_bus(t: Tables):
    latest = F.max_by(F.struct("event_id", "meter_id", r("consommation_kw").alias("consommation_kw"), "ts"), F.struct("ts", "event_id"))
    agg = live(t).groupBy("bus_id").agg(latest.alias("r")).select("bus_id", "r.*")
    out = s.drain_batches(agg, "latest", lambda df, i, folder: s.write_batch(df, folder, "out", i), mode="update")
    return s.latest_versions(t.spark, out, "out", ["bus_id"]).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("stream_windowed_counts", "SELECT cast(ts as date) AS day, statut, count(*) AS n FROM readings GROUP BY 1, 2")
def stream_windowed_counts(t: Tables):
    # no watermark: a reading counts however late it comes, and the state has two rows for each day
    counts = live(t).groupBy(F.window("ts", "1 day"), "statut").agg(F.count(F.lit(1)).alias("n"))
    rows = counts.select(F.col("window.start").cast("date").alias("day"), "statut", "n")
    out = s.drain_batches(rows, "counts", lambda df, i, folder: s.write_batch(df, folder, "out", i), mode="update")
    return s.latest_versions(t.spark, out, "out", ["day", "statut"])


@query("stream_alert_cooldown", BODIES["alert_cooldown"])
def stream_alert_cooldown(t: Tables):
    return s.drain_to_table(st.stream_cooldown(alerts_from_readings(live(t)), 86_400), "cooldown")


@query("stream_zone_asof", BODIES["zone_asof_mean"])
def stream_zone_asof(t: Tables):
    out = s.drain_batches(live(t), "zone-asof", m.zone_asof_batch)
    return t.spark.read.parquet(f"{out}/out").select("event_id", "zone_meters", "zone_asof_mean")


WINDOWS = "SELECT event_id, meter_id, {kw} AS kw_mean, {v} AS v_min, {n} AS n_steps FROM window8 WHERE n_in = 8".format(kw=R("kw_mean"), v=R("v_min"), n=8)


def _full(df):
    return df.filter(F.col("buffer_fill") == F.col("n_steps")).select("event_id", "meter_id", r("kw_mean").alias("kw_mean"), r("v_min").alias("v_min"), "n_steps")


@query("stream_sliding_windows", WINDOWS)
def stream_sliding_windows(t: Tables):
    return _full(s.drain_to_table(st.stream_windows(live(t), 8), "windows"))


@query("stream_seeded_windows", WINDOWS + " AND ts >= TIMESTAMP '2024-01-20'")
def stream_seeded_windows(t: Tables):
    # the history before the 20th seeds the buffers, the stream brings the rest
    seed = t.readings.filter("ts < TIMESTAMP_NTZ '2024-01-20 00:00:00'")
    rest = live(t).filter("ts >= TIMESTAMP '2024-01-20 00:00:00'")
    return _full(s.drain_to_table(st.stream_seeded_windows(rest, 8, seed), "seeded"))


@query("stream_adaptive_threshold", BODIES["adaptive_threshold"])
def stream_adaptive_threshold(t: Tables):
    return rounded_adaptive(s.drain_to_table(st.stream_adaptive(scored_from_readings(live(t)), 0.9), "adaptive"))


@query("stream_attack_overlay", BODIES["attack_overlay"])
def stream_attack_overlay(t: Tables):
    cols = ["event_id", "ts", "meter_id", "consommation_kw", "tension_v", "courant_a", "bus_id"]

    def overlay(df, i, folder):
        rows = df.select(*cols).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
        s.write_batch(p.attack_overlay(rows, t.attack_schedule), folder, "out", i)

    out = s.drain_batches(live(t), "overlay", overlay)
    df = t.spark.read.parquet(f"{out}/out")
    return df.select("event_id", *[r(c).alias(c) for c in ("tension_v", "consommation_kw", "courant_a")], "active_attack", "attack_type")


@query("stream_ledger", f"""WITH RECURSIVE {BODIES['ledger_summary'].split('RECURSIVE', 1)[1].split(' SELECT meter_id, count(*) + 1')[0]}
SELECT meter_id, block_index, previous_hash, block_hash FROM chain WHERE transaction_count = {SIZE}""")
def stream_ledger(t: Tables):
    payload = {"event_id": F.col("event_id"), "meter_id": l.text("meter_id"), "statut": l.text("statut"), "anomalies": l.text("anomalies"),
               "milli_kw": F.round(F.col("consommation_kw") * 1000).cast("long")}
    out = s.drain_batches(live(t), "ledger", lambda df, i, folder: m.seal_batch(df, i, folder, SIZE, NODES, "readings", payload))
    return t.spark.read.parquet(f"{out}/out").select("meter_id", "block_index", "previous_hash", "block_hash")


@query("stream_fanout", f"""WITH RECURSIVE {BODIES['alert_cooldown'].split('RECURSIVE', 1)[1].split('SELECT meter_id, id, emitted FROM f')[0]}
SELECT 'alerts' AS sink, meter_id, id FROM f WHERE emitted UNION ALL SELECT 'ledger', meter_id, id FROM f WHERE emitted""")
def stream_fanout(t: Tables):
    """Only alerts that pass the cooldown reach the alert table and the ledger queue."""
    passed = st.stream_cooldown(alerts_from_readings(live(t)), 86_400).filter("emitted").drop("emitted")

    def both(df, i, folder):
        s.write_batch(df, folder, "alerts", i)
        # the second sink reads what the first one stored: the stateful plan runs once per batch
        stored = df.sparkSession.read.parquet(f"{folder}/alerts/batch={i}")
        s.write_batch(stored, folder, "ledger", i)

    out = s.drain_batches(passed, "fanout", both)
    tables = [t.spark.read.parquet(f"{out}/{n}").select(F.lit(n).alias("sink"), "meter_id", "id") for n in ("alerts", "ledger")]
    return tables[0].unionByName(tables[1])


# eight readings, one day of cooldown and a low first threshold: the test series are short
LIVE = {"length": 8, "fallback": 1.05, "cooldown_s": 86_400}
_W = "(PARTITION BY meter_id ORDER BY ts, event_id{})"
_FEATURE_SQL = {
    **{c: c for c in dt.RAW},
    "consommation_kw_diff": f"coalesce(consommation_kw - lag(consommation_kw) OVER {_W.format('')}, 0)",
    "tension_v_diff": f"coalesce(tension_v - lag(tension_v) OVER {_W.format('')}, 0)",
    **{f"consommation_kw_rolling_{n}_{k}": f"coalesce({fn}(consommation_kw) OVER {_W.format(f' ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW')}, 0)"
       for k in dt.ROLLS for n, fn in (("mean", "avg"), ("std", "stddev_samp"))},
    "hour_sin": "sin(2 * pi() * hour(ts) / 24)", "hour_cos": "cos(2 * pi() * hour(ts) / 24)",
}
view("live_features", "SELECT event_id, meter_id, ts, is_alert, consommation_kw AS kw, tension_v AS v, courant_a AS a, "
     + ", ".join(f"{x} AS f{k}" for k, x in enumerate(_FEATURE_SQL.values())) + " FROM readings")
_N = range(len(dt.FEATURES))
view("live_errors", "SELECT event_id, meter_id, ts, kw, v, a, " + ", ".join(f"power((f{k} - m{k}) / CASE WHEN s{k} = 0 THEN 1 ELSE s{k} END, 2) AS e{k}" for k in _N)
     + " FROM live_features, (SELECT " + ", ".join(f"avg(f{k}) AS m{k}, stddev_pop(f{k}) AS s{k}" for k in _N) + " FROM live_features WHERE is_alert = 0) q")
view("live_windows", "SELECT *, row_number() OVER (PARTITION BY meter_id ORDER BY ts, event_id) AS rn, "
     + ", ".join(f"avg(e{k}) OVER w AS c{k}" for k in _N) + f", list(({' + '.join(f'e{k}' for k in _N)}) / {len(dt.FEATURES)}) OVER w AS steps"
     + " FROM live_errors WINDOW w AS (PARTITION BY meter_id ORDER BY ts, event_id ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)")
view("live_top", "SELECT event_id, string_agg(feature, ',' ORDER BY k) AS top_features FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY c DESC, feature) AS k FROM ("
     + " UNION ALL ".join(f"SELECT event_id, '{name}' AS feature, c{k} AS c FROM live_windows WHERE rn >= 8" for k, name in enumerate(dt.FEATURES)) + f")) WHERE k <= {dt.TOP} GROUP BY event_id")
view("live_scored", "SELECT w.event_id, meter_id, ts, kw, v, a, (" + " + ".join(f"c{k}" for k in _N) + f") / {len(dt.FEATURES)} AS score, list_position(steps, list_max(steps)) - 1 AS step, "
     "row_number() OVER (PARTITION BY meter_id ORDER BY ts, w.event_id) AS rn, top_features FROM live_windows w JOIN live_top USING (event_id)")
_THRESHOLD = f"CASE WHEN len(f.known) >= 30 THEN list_avg(f.known) + 3 * list_stddev_pop(f.known) ELSE {LIVE['fallback']}::double END"
DETECTION_SQL = f"""
WITH RECURSIVE live AS MATERIALIZED (SELECT * FROM live_scored), f AS (
  SELECT meter_id, event_id, rn, score, {LIVE['fallback']}::double AS threshold, CASE WHEN score < {LIVE['fallback']} THEN [score] ELSE []::double[] END AS known,
    CASE WHEN score >= {LIVE['fallback']} THEN epoch_us(ts) END AS alert_us, false AS deduplicated FROM live WHERE rn = 1
  UNION ALL SELECT meter_id, event_id, rn, score, thr, CASE WHEN score < thr THEN list_append(known, score)[-500:] ELSE known END,
    CASE WHEN score >= thr AND (alert_us IS NULL OR us - alert_us >= {LIVE['cooldown_s'] * 1_000_000}) THEN us ELSE alert_us END,
    score >= thr AND alert_us IS NOT NULL AND us - alert_us < {LIVE['cooldown_s'] * 1_000_000}
  FROM (SELECT o.*, epoch_us(o.ts) AS us, f.known, f.alert_us, {_THRESHOLD} AS thr FROM f JOIN live o ON o.meter_id = f.meter_id AND o.rn = f.rn + 1)),
decided AS (
  SELECT s.*, f.threshold, f.score >= f.threshold AS is_anomaly, f.deduplicated, CASE WHEN f.score < f.threshold THEN 'normal'
    WHEN split_part(top_features, ',', 1) LIKE '%tension%' OR split_part(top_features, ',', 2) LIKE '%tension%' THEN 'fdia'
    WHEN list_contains(string_split(top_features, ','), 'consommation_kw_diff') AND kw > 5 AND CASE WHEN v * a / 1000 > 0 THEN kw / (v * a / 1000) ELSE 1 END < 0.5 THEN 'fraud'
    WHEN v < 180 OR a > 50 THEN 'fault' ELSE 'dos' END AS attack_type
  FROM live s JOIN f USING (event_id))"""


def detections(t: Tables):
    model = dt.fit_model(dt.feature_frame(t.readings).filter("is_alert = 0"), **LIVE)
    # the source is drained: a time to live would keep the query waiting for it
    return dt.stream_detection(live(t), model, ttl_days=None)


@query("stream_detection", DETECTION_SQL + f"""
SELECT w.event_id, w.meter_id, CASE WHEN d.event_id IS NULL THEN 'buffering' ELSE 'scored' END AS status, cast(least(w.rn, 8) as int) AS buffer_fill, {R('d.score')} AS score,
  {R('d.threshold')} AS threshold, coalesce(is_anomaly, false) AS is_anomaly, CASE WHEN d.score IS NOT NULL THEN {R('least(1, d.score / greatest(d.threshold, 1e-9))')} END AS confidence, attack_type, top_features,
  cast(coalesce(step, -1) as int) AS critical_step, coalesce(deduplicated, false) AS deduplicated FROM live_windows w LEFT JOIN decided d ON w.event_id = d.event_id""")
def stream_detection(t: Tables):
    """Every live reading with its decision: the whole path from buffer to cooldown in one stateful operator."""
    out = s.drain_to_table(detections(t), "detections")
    cleaned = lambda c: r(F.when(~F.isnan(c), F.col(c))).alias(c)
    return out.select("event_id", "meter_id", "status", "buffer_fill", "is_anomaly", "attack_type", "top_features", "critical_step", "deduplicated",
                      *[cleaned(c) for c in ("score", "threshold", "confidence")])


@query("stream_detection_sinks", DETECTION_SQL + f""", passed AS (SELECT meter_id, event_id, row_number() OVER (PARTITION BY meter_id ORDER BY ts, event_id) AS k,
  count(*) OVER (PARTITION BY meter_id) AS n FROM decided WHERE is_anomaly AND NOT deduplicated)
SELECT 'alerts' AS sink, meter_id, event_id, cast(-1 as bigint) AS block_index FROM passed
UNION ALL SELECT 'ledger', meter_id, event_id, cast(1 + (k - 1) // {SIZE} as bigint) FROM passed WHERE k <= n - n % {SIZE}""")
def stream_detection_sinks(t: Tables):
    """Only anomalies that pass the cooldown are stored as alerts and sealed into the meter's ledger, full blocks only."""
    payload = {"event_id": F.col("event_id"), "meter_id": l.text("meter_id"), "attack_type": l.text("attack_type"), "statut": l.text("statut")}

    def both(df, i, folder):
        s.write_batch(dt.notarized(df), folder, "alerts", i)
        # the ledger reads what the first sink stored: the stateful plan runs once per batch
        m.seal_batch(df.sparkSession.read.parquet(f"{folder}/alerts/batch={i}"), i, f"{folder}/ledger", SIZE, NODES, "detections", payload)

    out = s.drain_batches(detections(t), "detections", both)
    alerts = t.spark.read.parquet(f"{out}/alerts")
    blocks = t.spark.read.parquet(f"{out}/ledger/out").select("meter_id", "block_index", "row_start", "row_end")
    numbered = l.ordinal(alerts, ["meter_id"], f.ORDER, rn="k")
    sealed = null_safe_join(numbered, blocks, ["meter_id"]).filter("k BETWEEN row_start AND row_end")
    return alerts.select(F.lit("alerts").alias("sink"), "meter_id", "event_id", F.lit(-1).cast("long").alias("block_index")).unionByName(
        sealed.select(F.lit("ledger").alias("sink"), "meter_id", "event_id", F.col("block_index").cast("long")))


@query("stream_rate_limit", f"SELECT cast(user_id as varchar) AS client, event_id AS id, budget, allowed FROM ({BODIES['rate_limit_budgets']})")
def stream_rate_limit(t: Tables):
    events = s.stream_table(t.spark, t.folder, "events")
    t.spark.conf.set("spark.sql.streaming.stateStore.providerClass", s.ROCKSDB)
    return s.drain_to_table(st.stream_limiter(events, "user_id", "ts", "event_id", "event_type", 86_400, **PATHS), "limiter")


BATCH = 100


@query("stream_detection_batches", DETECTION_SQL + f""", every AS (SELECT w.event_id, coalesce(d.is_anomaly, false) AS is_anomaly, 1 + (row_number() OVER (ORDER BY w.ts, w.event_id) - 1) // {BATCH} AS batch_no,
  w.ts FROM live_windows w LEFT JOIN decided d ON w.event_id = d.event_id)
SELECT batch_no, count(*) AS processed, count(*) FILTER (WHERE is_anomaly) AS anomalies_detected, arg_min(event_id, (ts, event_id)) AS first_event, arg_max(event_id, (ts, event_id)) AS last_event FROM every GROUP BY batch_no""")
def stream_detection_batches(t: Tables):
    """Results handed on in batches of at most ``BATCH`` readings, in order, with a summary of each."""
    out = s.drain_batches(detections(t), "detections", lambda df, i, folder: m.summary_batches(df, i, folder, BATCH))
    return t.spark.read.parquet(f"{out}/summary").select("batch_no", "processed", "anomalies_detected", "first_event", "last_event")
