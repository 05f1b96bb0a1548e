"""Ledger queries: one chain per meter, blocks of ten rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ledger as l
from ..session import scratch_dir
from ..sources.files import export_csv
from ..sources.readings import Tables
from .registry import BODIES, query, view

SIZE, NODES = 10, ["node-a", "node-b", "node-c"]
COLS = ["event_id", "ts", "meter_id", "statut", "anomalies", "consommation_kw"]


def rows(t: Tables):
    payload = {"event_id": F.col("event_id"), "meter_id": l.text("meter_id"), "statut": l.text("statut"), "anomalies": l.text("anomalies"),
               "milli_kw": F.round(F.col("consommation_kw") * 1000).cast("long")}
    return l.ledger_rows(t.readings.select(*COLS), "meter_id", ["ts", "event_id"], payload)


def blocks(t: Tables):
    return l.ledger_blocks(rows(t), "meter_id", SIZE, NODES)


def chained(t: Tables):
    return l.ledger_chain(blocks(t), "meter_id", NODES)


view("lrows", """SELECT *, sha256(concat('{"anomalies":"', anomalies, '","event_id":', event_id, ',"meter_id":"', meter_id, '","milli_kw":', cast(round(consommation_kw * 1000) as bigint), ',"row_index":', row_index, ',"statut":"', statut, '"}')) AS row_hash
FROM (SELECT *, row_number() OVER (PARTITION BY meter_id ORDER BY ts, event_id) AS row_index FROM readings)""")
view("lblocks", f"""SELECT *, (ARRAY{NODES})[block_index % 3 + 1] AS proposer, transaction_count - alert_count AS normal_count FROM (
  SELECT meter_id, cast((row_index - 1) // {SIZE} + 1 as bigint) AS block_index, sha256(string_agg(row_hash, '|' ORDER BY row_index)) AS transaction_root, count(*) AS transaction_count,
    cast(sum(is_alert) as bigint) AS alert_count, min(row_index) AS row_start, max(row_index) AS row_end, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS timestamp FROM lrows GROUP BY meter_id, 2)""")


def head_sql(prev: str, b: str = "b.") -> str:
    return (f"""concat('{{"alert_count":', {b}alert_count, ',"index":', {b}block_index, ',"normal_count":', {b}normal_count, ',"previous_hash":"', {prev}, '","proposer":"', {b}proposer, '","row_end":', {b}row_end, ',"row_start":', {b}row_start,"""
            f""" ',"source_file":"readings","timestamp":"', {b}timestamp, '","transaction_count":', {b}transaction_count, ',"transaction_root":"', {b}transaction_root, '"}}')""")


GENESIS = l.genesis(NODES)["block_hash"]
CHAIN_CTE = f"""RECURSIVE chain AS (SELECT b.*, '{GENESIS}' AS previous_hash, sha256({head_sql(f"'{GENESIS}'")}) AS block_hash FROM lblocks b WHERE block_index = 1
  UNION ALL SELECT b.*, c.block_hash, sha256({head_sql('c.block_hash')}) FROM chain c JOIN lblocks b ON b.meter_id = c.meter_id AND b.block_index = c.block_index + 1)"""


@query("ledger_rows", "SELECT event_id, meter_id, row_index, row_hash FROM lrows")
def ledger_rows(t: Tables):
    return rows(t).select("event_id", "meter_id", "row_index", "row_hash")


BLOCK_COLS = "meter_id, block_index, transaction_root, transaction_count, alert_count, normal_count, row_start, row_end, proposer"


@query("ledger_blocks", f"SELECT {BLOCK_COLS} FROM lblocks")
def ledger_blocks(t: Tables):
    return blocks(t).select(*BLOCK_COLS.split(", "))


@query("ledger_chain", f"""WITH {CHAIN_CTE} SELECT meter_id, block_index, previous_hash, block_hash FROM chain
UNION ALL SELECT DISTINCT meter_id, 0, '{l.ZERO_HASH}', '{GENESIS}' FROM lblocks""")
def ledger_chain(t: Tables):
    heads = l.genesis_rows(t.readings.select("meter_id").distinct(), "meter_id", NODES)
    return chained(t).unionByName(heads.select(*chained_columns())).select("meter_id", "block_index", "previous_hash", "block_hash")


def chained_columns() -> list[str]:
    return [x.split()[0] for x in l.chain_schema("meter_id").split(", ")]


@query("ledger_validate", """SELECT meter_id, block_index, CASE WHEN alert_count >= 4 THEN 'transaction root mismatch; block hash mismatch' WHEN alert_count = 3 THEN 'unknown proposer; block hash mismatch' ELSE '' END AS errors FROM lblocks""")
def ledger_validate(t: Tables):
    # a forged copy of the chain: other roots where four or more alerts are in a block, a strange proposer where it is three
    forged = chained(t).withColumns({
        "transaction_root": F.when(F.col("alert_count") >= 4, F.lit(l.GENESIS_ROOT)).otherwise(F.col("transaction_root")),
        "proposer": F.when(F.col("alert_count") == 3, "node-x").otherwise(F.col("proposer"))})
    out = l.validate(forged, blocks(t), "meter_id", NODES)
    return out.select("meter_id", "block_index", F.array_join("errors", "; ").alias("errors"))


@query("ledger_summary", f"""WITH {CHAIN_CTE} SELECT meter_id, count(*) + 1 AS total_blocks, count(*) AS data_blocks, cast(sum(transaction_count) as bigint) AS total_transactions, cast(sum(alert_count) as bigint) AS total_alerts,
  cast(sum(normal_count) as bigint) AS total_normals, arg_max(block_hash, block_index) AS latest_block_hash FROM chain GROUP BY meter_id""")
def ledger_summary(t: Tables):
    return l.summary(chained(t), "meter_id")


@query("verified_rows", f"""WITH {CHAIN_CTE} SELECT r.event_id, r.meter_id, r.row_index, r.row_hash, coalesce(c.block_index, -1) AS block_index, coalesce(c.block_hash, '') AS block_hash, coalesce(c.proposer, '') AS proposer
FROM lrows r LEFT JOIN (SELECT * FROM chain WHERE transaction_count = {SIZE}) c ON r.meter_id = c.meter_id AND (r.row_index - 1) // {SIZE} + 1 = c.block_index""")
def verified_rows(t: Tables):
    sealed = chained(t).filter(F.col("transaction_count") == SIZE)
    return l.verified_rows(rows(t), sealed, "meter_id", SIZE).select("event_id", "meter_id", "row_index", "row_hash", "block_index", "block_hash", "proposer")


@query("block_manifest", """SELECT meter_id, block_index, CASE WHEN block_index = 0 THEN 'GENESIS' ELSE 'DATA' END AS block_type,
  CASE WHEN block_index = 0 THEN 'block_0000_genesis.json' ELSE concat('block_', lpad(cast(block_index as varchar), 4, '0'), '_rows_', lpad(cast(row_start as varchar), 6, '0'), '_', lpad(cast(row_end as varchar), 6, '0'), '.json') END AS block_file
FROM (SELECT meter_id, block_index, row_start, row_end FROM lblocks UNION ALL SELECT DISTINCT meter_id, 0, 0, 0 FROM lblocks)""")
def block_manifest(t: Tables):
    data = blocks(t).select("meter_id", "block_index", "row_start", "row_end")
    zero = F.lit(0).cast("long")
    heads = t.readings.select("meter_id").distinct().select("meter_id", zero.alias("block_index"), zero.alias("row_start"), zero.alias("row_end"))
    i = F.col("block_index")
    return data.unionByName(heads).select("meter_id", "block_index", F.when(i == 0, "GENESIS").otherwise("DATA").alias("block_type"),
                                          l.block_file(i, F.col("row_start"), F.col("row_end")).alias("block_file"))


@query("recent_blocks", "SELECT meter_id, block_index, transaction_root FROM lblocks ORDER BY block_index DESC, meter_id LIMIT 50 OFFSET 20")
def recent_blocks(t: Tables):
    return blocks(t).select("meter_id", "block_index", "transaction_root").orderBy(F.desc("block_index"), "meter_id").offset(20).limit(50)


@query("anchor_candidates", f"""WITH {CHAIN_CTE} SELECT meter_id, block_index, block_hash FROM chain WHERE block_index % 3 = 2""")
def anchor_candidates(t: Tables):
    return l.anchor_candidates(chained(t), 3).select("meter_id", "block_index", "block_hash")


@query("record_candidates", "SELECT id, meter_id, attack_type FROM alerts WHERE confidence >= 0.9::double")
def record_candidates(t: Tables):
    return t.alerts.filter("confidence >= 0.9D").select("id", "meter_id", "attack_type")


@query("anchor_audit", """SELECT id, bus_id, idx, filled AND (top IS NULL OR idx > top) AS accepted, CASE WHEN NOT filled THEN 'empty hash' WHEN top IS NULL OR idx > top THEN '' ELSE 'index not increasing' END AS reason FROM (
  SELECT *, max(CASE WHEN filled THEN idx END) OVER (PARTITION BY bus_id ORDER BY created_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM (
    SELECT id, bus_id, created_at, (id * 31) % 9973 AS idx, severity <> 'critical' OR NOT is_resolved AS filled FROM alerts))""")
def anchor_audit(t: Tables):
    filled = (F.col("severity") != "critical") | ~F.col("is_resolved")
    sub = t.alerts.select("id", "bus_id", "created_at", ((F.col("id") * 31) % 9973).alias("idx"), F.when(filled, F.sha2(F.col("id").cast("string"), 256)).otherwise("").alias("hash"))
    return l.anchor_audit(sub, ["bus_id"], ["created_at", "id"], "idx", "hash").select("id", "bus_id", "idx", "accepted", "reason")


# anchors as in ``anchor_audit``; a third of the candidates was tampered with
@query("anchor_verify", """WITH sub AS (SELECT id, bus_id, created_at, (id * 31) % 9973 AS idx, CASE WHEN severity <> 'critical' OR NOT is_resolved THEN sha256(cast(id as varchar)) ELSE '' END AS hash FROM alerts),
top AS (SELECT *, max(CASE WHEN hash <> '' THEN idx END) OVER (PARTITION BY bus_id ORDER BY created_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM sub),
anchored AS (SELECT bus_id, idx, hash FROM top WHERE hash <> '' AND (top IS NULL OR idx > top))
SELECT s.id, s.bus_id, s.idx, coalesce(CASE WHEN s.id % 3 = 0 THEN sha256('forged') ELSE s.hash END = a.hash, false) AS verified FROM sub s LEFT JOIN anchored a ON s.bus_id = a.bus_id AND s.idx = a.idx""")
def anchor_verify(t: Tables):
    filled = (F.col("severity") != "critical") | ~F.col("is_resolved")
    sub = t.alerts.select("id", "bus_id", "created_at", ((F.col("id") * 31) % 9973).alias("idx"), F.when(filled, F.sha2(F.col("id").cast("string"), 256)).otherwise("").alias("hash"))
    candidates = sub.withColumn("hash", F.when(F.col("id") % 3 == 0, F.sha2(F.lit("forged"), 256)).otherwise(F.col("hash")))
    anchored = l.anchor_audit(sub, ["bus_id"], ["created_at", "id"], "idx", "hash")
    return l.verify_anchors(candidates, anchored, ["bus_id", "idx"], "hash").select("id", "bus_id", "idx", "verified")


@query("verified_csv", BODIES["verified_rows"])
def verified_csv(t: Tables):
    """The verified rows as CSV files, read back under their schema."""
    return export_csv(verified_rows(t), scratch_dir(t.spark, "verified"))


@query("anomaly_record_audit", """WITH r AS (SELECT id, meter_id || ':' || attack_type AS h, cast(round(confidence * 10500) as bigint) AS bps FROM alerts), v AS (SELECT h, min(id) AS first_id FROM r WHERE bps BETWEEN 0 AND 10000 GROUP BY h)
SELECT id, bps, bps BETWEEN 0 AND 10000 AND id <= first_id AS accepted, CASE WHEN NOT bps BETWEEN 0 AND 10000 THEN 'confidence out of range' WHEN id > first_id THEN 'duplicate hash' ELSE '' END AS reason FROM (SELECT r.id, r.bps, coalesce(v.first_id, r.id) AS first_id FROM r LEFT JOIN v ON r.h = v.h)""")
def anomaly_record_audit(t: Tables):
    rec = t.alerts.select("id", F.sha2(F.concat_ws(":", "meter_id", "attack_type"), 256).alias("hash"), F.round(F.col("confidence") * 10500).cast("long").alias("bps"))
    return l.record_audit(rec, "id", "hash", "bps").select("id", "bps", "accepted", "reason")


@query("active_alerts_view", """SELECT a.id, a.bus_id, round(m.voltage, 6) AS voltage, a.alert_type, a.attack_type, a.confidence, a.severity, a.created_at FROM alerts a LEFT JOIN (SELECT * FROM meters WHERE status = 'online') m ON a.bus_id = m.bus_id WHERE NOT a.is_resolved""")
def active_alerts_view(t: Tables):
    online = t.meters.filter("status = 'online'").select("bus_id", F.round("voltage", 6).alias("voltage"))
    open_ = t.alerts.filter(~F.col("is_resolved"))
    out = open_.join(online, "bus_id", "left").orderBy(F.desc("created_at"))
    return out.select("id", "bus_id", "voltage", "alert_type", "attack_type", "confidence", "severity", "created_at")
