"""A series that holds all rows is sliced long before a keyed one; long results are computed once."""

from pyspark.sql import functions as F

from wattloom.operators import evaluate, models, quantiles, series
from wattloom.streaming import microbatch


def table(spark, n=4000):
    return spark.range(n).select(F.col("id").alias("event_id"), (F.xxhash64("id") % 50).cast("double").alias("x"), (F.col("id") % 3 == 0).cast("int").alias("y"))


def test_all_rows_as_one_series_are_sliced_earlier(spark):
    df = table(spark)
    size = series.plan_bytes(df)[0]
    spark.conf.set("wattloom.split.bytes", str(size * 4))
    spark.conf.set("wattloom.split.rows", "500")
    try:
        assert not series.slice_series(df, ["y"], ["event_id"]).split
        whole = series.slice_series(df, [], ["event_id"])
        assert whole.split and whole.frame.groupBy(series.SLICE).count().agg(F.max("count")).first()[0] < 1500
        placed = series.ordinal(df, [], ["event_id"], rn="rn", n="n").toPandas()
        assert (placed["rn"] == placed["event_id"] + 1).all() and (placed["n"] == 4000).all()
        assert quantiles.percentiles(df, [], {"m": ("event_id", 0.5)}).first()[0] == 1999.5
    finally:
        spark.conf.unset("wattloom.split.bytes")
        spark.conf.unset("wattloom.split.rows")


def test_dealt_columns_and_forest_scores_are_read_from_files(spark):
    df = table(spark)
    seen = []

    def permute(rows, column, ident, seed):
        return evaluate.permute_column(rows, column, ident, seed).withColumn("x", F.col("x"))

    def score(rows):
        seen.append(rows._jdf.queryExecution().optimizedPlan().toString())
        return rows.withColumn("score", F.col("x"))

    models.permutation_importance(df, ["x"], score, "y", "event_id", permute).collect()
    assert "parquet" in seen[1] and "Join" not in seen[1]
    rows = df.select("event_id", F.lit("a").alias("zone"), F.lit("b").alias("type"), "x", F.lit(230.0).alias("tension_v"), F.lit(60.0).alias("frequency_hz"), F.lit(0.9).alias("power_factor"))
    plan = models.segmented_detection(rows, ["x"], 2)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInPandas" not in plan  # the scores are not computed again by the cut-offs


def test_a_batch_is_kept_before_it_is_numbered(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            calls.add(len(b))
            yield b

    rows = table(spark, 300).select("event_id", F.col("event_id").alias("us"), F.col("y").cast("boolean").alias("is_anomaly"))
    spark.conf.set("wattloom.split.bytes", "0")
    spark.conf.set("wattloom.split.rows", "20")
    try:
        microbatch.summary_batches(rows.mapInPandas(count, rows.schema), 0, str(tmp_path), 100)
    finally:
        spark.conf.unset("wattloom.split.bytes")
        spark.conf.unset("wattloom.split.rows")
    assert calls.value == 300  # the detector ran once
    got = spark.read.parquet(f"{tmp_path}/summary").orderBy("batch_no").collect()
    assert [(r.batch_no, r.processed, r.first_event, r.last_event) for r in got] == [(k + 1, 100, 100 * k, 100 * k + 99) for k in range(3)]
