"""Micro-batch operators that reuse the batch operators and keep their state in versioned tables.

Each batch reads the state its predecessor wrote and writes its own version, so a retried batch starts
from the same state; older versions are removed. The batch itself is kept while it is worked on. Large keys are handled by the batch operators' slicing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import ledger as l
from ..operators.features import ORDER, millionths
from ..operators.series import null_safe_join, over_series, running
from .sources import drop_version, write_batch


def _state(spark: SparkSession, folder: str, table: str, batch_id: int, schema: str) -> DataFrame:
    if batch_id == 0:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{folder}/{table}/batch={batch_id - 1}")


LATEST = "zone string, meter_id string, ts timestamp, event_id long, value long"
ZONES = "zone string, total long, meters long"


def zone_asof_batch(batch: DataFrame, batch_id: int, folder: str) -> None:
    """Mean of the zone's latest values per reading; state: latest value per meter with its time, sum and count per zone.

    A reading older than what its meter has sent in an earlier batch changes nothing any more; it goes to the table ``late``.
    """
    spark, batch = batch.sparkSession, batch.persist()
    latest, zones = _state(spark, folder, "latest", batch_id, LATEST), _state(spark, folder, "zones", batch_id, ZONES)
    rows = batch.select("zone", "meter_id", "ts", "event_id", millionths("consommation_kw").alias("value"))
    known = latest.withColumnsRenamed({"value": "__known", "ts": "__ts", "event_id": "__id"})
    rows = null_safe_join(rows, known, ["zone", "meter_id"], "left")
    old = F.coalesce(F.struct("ts", "event_id") < F.struct(F.col("__ts").alias("ts"), F.col("__id").alias("event_id")), F.lit(False)) & F.col("__ts").isNotNull()
    write_batch(rows.filter(old).select("zone", "meter_id", "ts", "event_id", "value"), folder, "late", batch_id)
    rows = rows.filter(~old).drop("__ts", "__id")

    def steps(w):
        prev = F.coalesce(F.lag("value").over(w), F.col("__known"))
        return {"__step": F.col("value") - F.coalesce(prev, F.lit(0)), "__first": prev.isNull().cast("long")}

    stepped = over_series(rows, ["zone", "meter_id"], ORDER, steps, back=1, sized_by=batch)
    summed = running(stepped, ["zone"], ORDER, {"__sum": F.col("__step"), "__n": F.col("__first")}, sized_by=batch)
    out = null_safe_join(summed, zones, ["zone"], "left").withColumns({
        "total": F.coalesce("total", F.lit(0)) + F.col("__sum"), "meters": F.coalesce("meters", F.lit(0).cast("long")) + F.col("__n")})
    write_batch(out.select("event_id", "zone", F.col("meters").alias("zone_meters"), (F.col("total") / 1e6 / F.col("meters")).alias("zone_asof_mean")), folder, "out", batch_id)
    at = F.struct("ts", "event_id")
    now = rows.groupBy("zone", "meter_id").agg(F.max(F.struct(at.alias("at"), "value")).alias("m")).select("zone", "meter_id", "m.at.ts", "m.at.event_id", "m.value")
    kept = null_safe_join(latest, now.select("zone", "meter_id"), ["zone", "meter_id"], "left_anti")
    write_batch(kept.unionByName(now), folder, "latest", batch_id)
    new = stepped.groupBy("zone").agg(F.sum("__step").alias("total"), F.sum("__first").alias("meters"))
    write_batch(zones.unionByName(new).groupBy("zone").agg(F.sum("total").alias("total"), F.sum("meters").alias("meters")), folder, "zones", batch_id)
    for table in ("latest", "zones"):
        drop_version(spark, folder, table, batch_id - 2)
    batch.unpersist()


PENDING = "meter_id string, ts timestamp, event_id long, statut string, row_index long, row_hash string"
TAILS = "meter_id string, rows_sealed long, tail string"


class LiveTail(l.ChainTail):
    """Tail that continues from the hash the state table holds."""

    def __init__(self) -> None:
        self.hash = None


def seal_batch(batch: DataFrame, batch_id: int, folder: str, size: int, authorities: list[str], source: str, payload) -> None:
    """Seal every full block; rows of the open block wait in the state with their hashes."""
    spark, batch = batch.sparkSession, batch.persist()
    pending, tails = _state(spark, folder, "pending", batch_id, PENDING), _state(spark, folder, "tails", batch_id, TAILS)
    waiting = pending.groupBy("meter_id").agg(F.max("row_index").alias("__last"))
    start = null_safe_join(tails, waiting, ["meter_id"], "left").select("meter_id", F.coalesce("__last", "rows_sealed").alias("__seen")) if batch_id else None
    numbered = l.ordinal(batch, ["meter_id"], ORDER, rn="row_index")
    if start is not None:
        numbered = null_safe_join(numbered, start, ["meter_id"], "left").withColumn("row_index", F.col("row_index") + F.coalesce("__seen", F.lit(0)))
    hashed = numbered.withColumn("row_hash", F.sha2(l.canonical_json({**payload, "row_index": F.col("row_index")}), 256))
    rows = pending.unionByName(hashed.select(*[c.split()[0] for c in PENDING.split(", ")]))
    blocks = l.ledger_blocks(rows, "meter_id", size, authorities)
    full = null_safe_join(blocks.filter(F.col("transaction_count") == size), tails.select("meter_id", "tail"), ["meter_id"], "left")
    full = full.withColumn("tail", F.coalesce("tail", F.lit(l.genesis(authorities)["block_hash"])))
    schema = l.chain_schema("meter_id")

    def step(tail, rows):
        if tail.hash is None:
            tail.hash = rows["tail"][0]
        return l.link(tail, rows, "meter_id", source)

    write_batch(l.ordered_fold(full, ["meter_id"], ["block_index"], LiveTail, step, schema), folder, "out", batch_id)
    sealed = spark.read.schema(schema).parquet(f"{folder}/out/batch={batch_id}")
    ends = sealed.groupBy("meter_id").agg(F.max("row_end").alias("rows_sealed"), F.max_by("block_hash", "block_index").alias("tail"))
    open_rows = null_safe_join(rows, ends.select("meter_id", "rows_sealed"), ["meter_id"], "left").filter(F.col("row_index") > F.coalesce("rows_sealed", F.lit(0))).drop("rows_sealed")
    write_batch(open_rows, folder, "pending", batch_id)
    first = l.genesis(authorities)["block_hash"]
    unsealed = null_safe_join(null_safe_join(rows.select("meter_id").distinct(), ends.select("meter_id"), ["meter_id"], "left_anti"), tails, ["meter_id"], "left")
    unsealed = unsealed.select("meter_id", F.coalesce("rows_sealed", F.lit(0)).alias("rows_sealed"), F.coalesce("tail", F.lit(first)).alias("tail"))
    silent = null_safe_join(tails, rows.select("meter_id").distinct(), ["meter_id"], "left_anti")
    write_batch(ends.unionByName(unsealed).unionByName(silent), folder, "tails", batch_id)
    for table in ("pending", "tails"):
        drop_version(spark, folder, table, batch_id - 2)
    batch.unpersist()


def summary_batches(results: DataFrame, batch_id: int, folder: str, size: int) -> None:
    """The results of a micro-batch cut in order of time into batches of at most ``size``, and one summary row for each."""
    order = ["us", "event_id"]
    # kept first: numbering a large batch reads it several times, and its real size tells whether one task can
    write_batch(results, folder, "incoming", batch_id)
    incoming = results.sparkSession.read.schema(results.schema).parquet(f"{folder}/incoming/batch={batch_id}")
    numbered = l.ordinal(incoming, [], order, rn="place").withColumn("batch_no", F.floor((F.col("place") - 1) / size) + 1)
    write_batch(numbered, folder, "results", batch_id)
    stored = results.sparkSession.read.schema(numbered.schema).parquet(f"{folder}/results/batch={batch_id}")
    summary = stored.groupBy("batch_no").agg(
        F.count(F.lit(1)).alias("processed"), F.sum(F.col("is_anomaly").cast("long")).alias("anomalies_detected"),
        F.min_by("event_id", "place").alias("first_event"), F.max_by("event_id", "place").alias("last_event"))
    write_batch(summary, folder, "summary", batch_id)
