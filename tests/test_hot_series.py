"""One meter holds over a third of the readings: the sliced plans must give the same rows."""

import pytest
from oracle import TABLES, compare
from pyspark.sql import functions as F

import __spark_entry__ as entry
from wattloom.operators import quantiles, series
from wattloom.session import tune

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
SERIES = """meter_diff rolling_mean rolling_std zone_asof_mean sliding_windows window_labels tumbling_rows temporal_quarters stale_runs alert_bursts
autocorrelation rolling_threshold global_threshold alert_cooldown rate_window temporal_split stratified_split grouped_kfold rate_limit_exact roc_auc pr_auc pct_rank cume_rank
f1_threshold detection_latency meter_generalisation describe latency_percentiles impute_compare packet_loss jitter_pairs attack_overlay interval_matches
ledger_rows ledger_chain ledger_validate verified_rows anchor_audit enhanced_detection stream_zone_asof stream_ledger""".split()


@pytest.fixture(scope="module")
def skewed(spark, folder, tmp_path_factory):
    import duckdb

    tune(spark)
    out = str(tmp_path_factory.mktemp("skewed"))
    events = spark.read.parquet(f"{folder}/events.parquet")
    hot = events.withColumn("user_id", F.when(F.col("event_id") % 5 < 2, 7).otherwise(F.col("user_id")).cast("long"))
    hot.coalesce(1).write.parquet(f"{out}/events.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{out}/events.parquet/*.parquet'")
    assert "events" in TABLES
    return out, con


@pytest.mark.parametrize("name", [n for n in SERIES if not n.startswith("stream_")])
def test_hot_meter_on_sliced_plan(spark, skewed, split_everything, name):
    out, con = skewed
    assert compare(QUERIES[name](spark, out).toPandas(), con.sql(ORACLES[name]).df()) == []


@pytest.mark.parametrize("warmup", [2000, 370])
def test_hot_meter_adaptive_threshold(spark, skewed, split_everything, warmup):
    """Also with a warm-up too short to reach the true state, when slices have to start again."""
    from wattloom.operators.detect import adaptive_threshold
    from wattloom.plans.detect import rounded_adaptive
    from wattloom.sources.readings import Tables

    out, con = skewed
    spark.conf.set("wattloom.split.rows", "100")
    got = rounded_adaptive(adaptive_threshold(Tables(spark, out).scored, 0.9, warmup)).toPandas()
    assert compare(got, con.sql(ORACLES["adaptive_threshold"]).df()) == []


def test_slices_bound_the_window_groups(spark, skewed, split_everything):
    """No window group of the hot meter holds more than a small multiple of the row limit."""
    from wattloom.sources.readings import Tables

    s = series.slice_series(Tables(spark, skewed[0]).readings.select("event_id", "ts", "meter_id"), ["meter_id"], ["ts", "event_id"], back=3)
    assert s.split
    biggest = s.frame.groupBy("meter_id", series.SLICE).count().agg(F.max("count")).first()[0]
    assert biggest <= 3 * 20
    assert s.done().count() == 1000


def test_small_inputs_keep_the_plain_window(spark, folder):
    from wattloom.sources.readings import Tables

    assert not series.slice_series(Tables(spark, folder).readings, ["meter_id"], ["ts", "event_id"]).split


def odd_readings(spark):
    """A null key with most rows, null values, one far time and value, and ids that share a long prefix."""
    return spark.range(900).select(
        F.when(F.col("id") % 3 > 0, F.lit(None)).otherwise(F.concat(F.lit("meter-000000000000000"), F.col("id") % 4)).alias("meter_id"),
        F.when(F.col("id") == 5, 4e12).when(F.col("id") % 11 == 0, F.lit(None)).otherwise((F.col("id") * 7919) % 13).cast("double").alias("v"),
        F.when(F.col("id") == 17, F.lit(4102444800)).otherwise(F.lit(1700000000) + (F.col("id") * 31) % 500).cast("timestamp").alias("ts"),
        F.concat(F.lit("event-00000000000000000"), F.format_string("%05d", (F.col("id") * 577) % 900)).alias("event_id"))


def both_plans(spark, build):
    plain = sorted(map(repr, build().collect()))
    spark.conf.set("wattloom.split.bytes", "0")
    spark.conf.set("wattloom.split.rows", "20")
    try:
        assert sorted(map(repr, build().collect())) == plain
    finally:
        spark.conf.unset("wattloom.split.bytes")
        spark.conf.unset("wattloom.split.rows")
    return plain


@pytest.mark.parametrize("keys", [[], ["meter_id"]])
@pytest.mark.parametrize("order", [["ts", "event_id"], ["event_id"], ["v", "event_id"]])
def test_both_plans_agree_on_odd_rows(spark, keys, order):
    tune(spark)
    df = odd_readings(spark)
    by_lag = lambda w: {"back": F.lag("v", 2).over(w), "ahead": F.lead("v").over(w)}
    assert len(both_plans(spark, lambda: series.ordinal(df, keys, order, rn="rn", n="n"))) == 900
    both_plans(spark, lambda: series.over_series(df, keys, order, by_lag, back=2, ahead=1))
    both_plans(spark, lambda: series.running(df, keys, order, {"total": F.coalesce("v", F.lit(0.0)), "seen": F.lit(1)}))
    both_plans(spark, lambda: series.carry_forward(df, keys, order, {"held": F.when(F.col("v") > 5, F.col("v"))}))
    both_plans(spark, lambda: series.islands(df, keys, order, lambda w: ~F.col("v").eqNullSafe(F.lag("v").over(w))))


@pytest.mark.parametrize("order", [["ts", "event_id"], ["event_id"], ["v", "event_id"]])
def test_slices_stay_small_on_odd_rows(spark, split_everything, order):
    s = series.slice_series(odd_readings(spark), ["meter_id"], order)
    assert s.split and s.frame.groupBy("meter_id", series.SLICE).count().agg(F.max("count")).first()[0] <= 3 * 20


def test_percentiles_keep_every_group(spark):
    tune(spark)
    df = odd_readings(spark).unionByName(odd_readings(spark).limit(3).withColumn("meter_id", F.lit("no values")).withColumn("v", F.lit(None).cast("double")))
    assert len(both_plans(spark, lambda: quantiles.percentiles(df, ["meter_id"], {"q": ("v", 0.3), "m": ("v", 0.9)}))) == 6


def test_lookups_keep_null_keys(spark):
    from wattloom.operators.lookup import lookup_join

    df = odd_readings(spark)
    dim = df.groupBy("meter_id").agg(F.count(F.lit(1)).alias("n"))
    assert len(both_plans(spark, lambda: lookup_join(df, dim, ["meter_id"]))) == 900


def test_null_categories_and_scores_keep_their_rows(spark):
    from wattloom.operators import cleaning, evaluate, features

    df = spark.createDataFrame([(1, "b", 0.5), (2, None, None), (3, "a", 0.2), (4, "b", 0.5), (5, None, 0.9)], "event_id long, kind string, score double")
    assert {r.event_id: r.code for r in features.label_codes(df, "kind", "code").collect()} == {1: 1, 2: None, 3: 0, 4: 1, 5: None}
    assert {r.event_id: r.pct_rank for r in evaluate.percent_rank_by_order(df, "score", "event_id").collect()} == {1: 0.5, 2: None, 3: 0.25, 4: 0.75, 5: 1.0}
    assert {r.event_id: r.cume_rank for r in evaluate.cumulative_rank(df, "score").collect()} == {1: 0.75, 2: None, 3: 0.25, 4: 0.75, 5: 1.0}
    batch = spark.createDataFrame([(1, "x", None), (1, "y", 0.1), (9, "z", 0.3)], "event_id long, kind string, score double")
    got = {r.event_id: (r.kind, r.score) for r in cleaning.upsert(df, batch, "event_id").collect()}
    assert got == {1: ("y", 0.1), 2: (None, None), 3: ("a", 0.2), 4: ("b", 0.5), 5: (None, 0.9), 9: ("z", 0.3)}


def test_scratch_folder_needs_a_shared_place(spark):
    from types import SimpleNamespace

    from wattloom.session import scratch_dir

    conf = SimpleNamespace(get=lambda key, default=None: default, set=lambda key, value: None)
    with pytest.raises(RuntimeError):
        scratch_dir(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://host:7077")), "x")
    assert scratch_dir(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="local[4]")), "x")


def test_text_order_positions(spark, split_everything):
    df = spark.range(500).select(F.format_string("m%05d", (F.col("id") * 7919) % 500).alias("k"))
    got = series.ordinal(df, [], ["k"], rn="rn").orderBy("k").toPandas()
    assert got["rn"].tolist() == list(range(1, 501))


@pytest.mark.parametrize("p", [0.0, 0.1, 0.5, 0.999, 1.0])
def test_percentiles_agree(spark, split_everything, p):
    import numpy as np

    values = [((i * 37) % 101) / 7.0 for i in range(200)] + [3.0] * 150
    df = spark.createDataFrame([("a", v) for v in values] + [("b", 1.0)], "k string, v double")
    out = {r["k"]: r["q"] for r in quantiles.percentiles(df, ["k"], {"q": ("v", p)}).collect()}
    assert out["b"] == 1.0 and abs(out["a"] - np.percentile(values, 100 * p)) < 1e-9
    many = quantiles.many_percentiles(df.filter("k = 'a'"), "v", [p, 0.25]).first()["q"]
    assert np.allclose(many, np.percentile(values, [100 * p, 25]))
