"""Streaming reads of the parquet tables and runs that drain what is there."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import scratch_dir
from ..sources.readings import readings_from_events

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_table(spark: SparkSession, folder: str, name: str, bytes_per_trigger: int = 1 << 30) -> DataFrame:
    """A table as a stream of files; a micro-batch takes files up to the given size (one file at least)."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return (
        spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet")
        .option("maxBytesPerTrigger", bytes_per_trigger).parquet(folder)
    )


def stream_readings(spark: SparkSession, folder: str) -> DataFrame:
    """Live readings; event time is a zoned timestamp under the session zone (UTC)."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    readings = readings_from_events(stream_table(spark, folder, "events"))
    return readings.withColumn("ts", F.col("ts").cast("timestamp"))


def drain_to_table(stream: DataFrame, label: str, mode: str = "append") -> DataFrame:
    """Run an append-mode stream to the end of its source into a parquet sink and return the sink table."""
    spark = stream.sparkSession
    out = scratch_dir(spark, label)
    q = (
        stream.writeStream.format("parquet").outputMode(mode)
        .option("path", f"{out}/data").option("checkpointLocation", f"{out}/checkpoint")
        .trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/data")


def drain_batches(stream: DataFrame, label: str, handle: Callable[[DataFrame, int, str], None], mode: str = "append") -> str:
    """Run ``handle(batch, batch_id, folder)`` for every micro-batch to the end of the source."""
    out = scratch_dir(stream.sparkSession, label)
    q = (
        stream.writeStream.outputMode(mode).foreachBatch(lambda df, i: handle(df, i, out))
        .option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return out


def write_batch(df: DataFrame, folder: str, table: str, batch_id: int) -> None:
    """One folder per micro-batch, overwritten on a retry: the sink stays exactly-once."""
    df.write.mode("overwrite").parquet(f"{folder}/{table}/batch={batch_id}")


def drop_version(spark: SparkSession, folder: str, table: str, batch_id: int) -> None:
    """Remove a state version that no retry can ask for any more."""
    if batch_id >= 0:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{table}/batch={batch_id}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def latest_versions(spark: SparkSession, folder: str, table: str, keys: list[str]) -> DataFrame:
    """The last written version of every key of an update-mode sink."""
    df = spark.read.parquet(f"{folder}/{table}")
    packed = F.struct(*[c for c in df.columns if c not in (*keys, "batch")])
    return df.groupBy(*keys).agg(F.max_by(packed, "batch").alias("r")).select(*keys, "r.*")
