"""The source arrives as several files, one micro-batch each: the results must equal the batch twins."""

import pytest
from oracle import compare
from pyspark.sql import functions as F

import __spark_entry__ as entry
from wattloom.functions.expr import r
from wattloom.operators import ledger as l
from wattloom.plans.detect import rounded_adaptive
from wattloom.plans.ledger import NODES, SIZE
from wattloom.plans.streaming import _full
from wattloom.sources.readings import alerts_from_readings, readings_from_events, scored_from_readings
from wattloom.streaming import microbatch as m, sources as s, stateful as st


@pytest.fixture(scope="module")
def files(spark, folder, tmp_path_factory):
    """Five files in time order."""
    out = str(tmp_path_factory.mktemp("files")) + "/events"
    events = spark.read.parquet(f"{folder}/events.parquet")
    for i in range(5):
        events.filter((F.col("event_id") >= i * 200) & (F.col("event_id") < (i + 1) * 200)).coalesce(1).write.mode("append").parquet(out)
    return out, events.schema


def live(spark, files):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", s.ROCKSDB)
    stream = spark.readStream.schema(files[1]).option("maxFilesPerTrigger", 1).parquet(files[0])
    return readings_from_events(stream).withColumn("ts", F.col("ts").cast("timestamp"))


def batch(spark, folder, name):
    return entry.queries()[name](spark, folder).toPandas()


def test_zone_asof(spark, folder, files):
    out = s.drain_batches(live(spark, files), "t-zone", m.zone_asof_batch)
    got = spark.read.parquet(f"{out}/out").select("event_id", "zone_meters", "zone_asof_mean").toPandas()
    assert compare(got, batch(spark, folder, "zone_asof_mean")) == []


def test_late_readings_leave_the_zone_state_alone(spark, tmp_path):
    rows = lambda *v: spark.createDataFrame(list(v), "zone string, meter_id string, ts timestamp, event_id long, consommation_kw double")
    from datetime import datetime as d

    spark.conf.set("spark.sql.session.timeZone", "UTC")
    folder = str(tmp_path)
    m.zone_asof_batch(rows(("Z", "a", d(2024, 1, 10), 1, 5.0), ("Z", "b", d(2024, 1, 10), 2, 3.0)), 0, folder)
    m.zone_asof_batch(rows(("Z", "a", d(2024, 1, 5), 3, 1.0)), 1, folder)
    m.zone_asof_batch(rows(("Z", "b", d(2024, 1, 11), 4, 7.0)), 2, folder)
    out = {r.event_id: (r.zone_meters, r.zone_asof_mean) for r in spark.read.parquet(f"{folder}/out").collect()}
    assert out == {1: (1, 5.0), 2: (2, 4.0), 4: (2, 6.0)}
    assert [r.event_id for r in spark.read.parquet(f"{folder}/late").collect()] == [3]


def test_ledger(spark, folder, files):
    payload = {"event_id": F.col("event_id"), "meter_id": l.text("meter_id"), "statut": l.text("statut"), "anomalies": l.text("anomalies"),
               "milli_kw": F.round(F.col("consommation_kw") * 1000).cast("long")}
    out = s.drain_batches(live(spark, files), "t-ledger", lambda df, i, f: m.seal_batch(df, i, f, SIZE, NODES, "readings", payload))
    got = spark.read.parquet(f"{out}/out").select("meter_id", "block_index", "previous_hash", "block_hash").toPandas()
    assert compare(got, batch(spark, folder, "stream_ledger")) == []


def test_cooldown(spark, folder, files):
    got = s.drain_to_table(st.stream_cooldown(alerts_from_readings(live(spark, files)), 86_400), "t-cooldown").toPandas()
    assert compare(got, batch(spark, folder, "alert_cooldown")) == []


def test_windows(spark, folder, files):
    got = _full(s.drain_to_table(st.stream_windows(live(spark, files), 8), "t-windows")).toPandas()
    assert compare(got, batch(spark, folder, "stream_sliding_windows")) == []


def test_adaptive(spark, folder, files):
    got = rounded_adaptive(s.drain_to_table(st.stream_adaptive(scored_from_readings(live(spark, files)), 0.9), "t-adaptive")).toPandas()
    assert compare(got, batch(spark, folder, "adaptive_threshold")) == []


def test_latest_per_bus(spark, folder, files):
    latest = F.max_by(F.struct("event_id", "meter_id", r("consommation_kw").alias("consommation_kw"), "ts"), F.struct("ts", "event_id"))
    agg = live(spark, files).groupBy("bus_id").agg(latest.alias("r")).select("bus_id", "r.*")
    out = s.drain_batches(agg, "t-latest", lambda df, i, f: s.write_batch(df, f, "out", i), mode="update")
    got = s.latest_versions(spark, out, "out", ["bus_id"]).withColumn("ts", F.col("ts").cast("timestamp_ntz")).toPandas()
    assert compare(got, batch(spark, folder, "latest_per_bus")) == []



def test_late_rows_are_judged_and_counted(spark, tmp_path):
    """Rows days older than what came before: an alert gets its decision, a reading its day."""
    from datetime import datetime as d

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", s.ROCKSDB)
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    schema = "meter_id string, id long, created_at timestamp"
    for k, rows in enumerate([[("a", 1, d(2024, 1, 10)), (None, 2, d(2024, 1, 10))], [("a", 3, d(2024, 1, 2)), ("a", 4, d(2024, 1, 12)), (None, 5, d(2024, 1, 1))]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = s.drain_to_table(st.stream_cooldown(stream, 86_400), "t-late").collect()
    assert {r.id: r.emitted for r in got} == {1: True, 2: True, 3: False, 4: True, 5: False} and len(got) == 5
