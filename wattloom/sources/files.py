"""File sources and sinks: safe scans, partitioned outputs, append logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

READING_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("Timestamp", T.StringType()),
    T.StructField("meter_id", T.StringType()),
    T.StructField("zone", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("consommation_kw", T.DoubleType()),
    T.StructField("tension_v", T.DoubleType()),
    T.StructField("courant_a", T.DoubleType()),
    T.StructField("statut", T.StringType()),
])
METER_COLUMNS = {"consommation_kw", "tension_v", "courant_a"}


def scan_readings_csv(spark: SparkSession, path: str, schema: T.StructType = READING_SCHEMA, header: bool = True) -> DataFrame:
    """Declared-schema CSV scan: malformed lines are skipped, ``Timestamp`` is renamed."""
    df = (
        spark.read.schema(schema)
        .option("header", str(header).lower())
        .option("mode", "DROPMALFORMED")
        .option("columnPruning", "false")
        .csv(path)
    )
    return df.withColumnRenamed("Timestamp", "timestamp") if "Timestamp" in df.columns else df


def read_csv_safe(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The CSV folder, or an empty frame of the declared schema where nothing is there."""
    try:
        return spark.read.schema(schema).option("header", "true").csv(path)
    except Exception as exc:  # a missing path is an empty table, anything else is an error
        if "PATH_NOT_FOUND" not in str(exc):
            raise
        return spark.createDataFrame([], schema)


def json_object(text, schema: str):
    """Fields of a JSON object column; text that is no such object gives nulls."""
    return F.from_json(text, schema, {"mode": "PERMISSIVE"})


def reading_kind(df: DataFrame) -> str:
    """``meter`` when the three measures are there, else ``generic``."""
    return "meter" if METER_COLUMNS <= set(df.columns) else "generic"


def wide_day_columns(columns: list[str], ids: tuple[str, ...] = ("cons_no", "flag")) -> list[str]:
    """Day columns of a wide consumer table: all but the ids, in calendar order."""
    def calendar(name: str) -> tuple[int, ...]:
        return tuple(int(x) for x in name.split("/"))

    return sorted((c for c in columns if c.lower() not in ids), key=calendar)


def write_by_status(df: DataFrame, path: str) -> None:
    """Reading sink laid out by status, so a normal-only read prunes the alert files."""
    df.write.mode("overwrite").partitionBy("statut").parquet(path)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def export_csv(df: DataFrame, path: str) -> DataFrame:
    """Write a table as CSV with header and give it back as it reads; empty texts stay empty, nulls stay null."""
    df.write.mode("overwrite").option("header", "true").option("emptyValue", '""').option("nullValue", "\\N").csv(path)
    return df.sparkSession.read.schema(df.schema).option("header", "true").option("emptyValue", "").option("nullValue", "\\N").csv(path)
