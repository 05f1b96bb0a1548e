"""Null consumer types and null chains: no failure, no row lost."""

import pytest
from pyspark.sql import functions as F

from wattloom.operators import detect, ledger, profile
from wattloom.plans.ledger import NODES
from wattloom.sources.readings import Tables


@pytest.fixture()
def readings(spark, folder):
    rows = Tables(spark, folder).readings
    return rows.withColumn("type", F.when(F.col("event_id") % 9 != 0, F.col("type"))).withColumn("meter_id", F.when(F.col("event_id") % 7 != 0, F.col("meter_id")))


def test_null_types_have_statistics(readings):
    stats = profile.grouped_baseline(readings).collect()
    assert sum(r.overall for r in stats) == 1 and len(stats) == 1 + readings.select("type").distinct().count()
    pdf = readings.select("type", "consommation_kw").toPandas()
    for r in stats:
        own = pdf if r.overall else pdf[pdf.type.isna()] if r.type is None else pdf[pdf.type == r.type]
        assert (r.mean, r["std"], r.q95) == pytest.approx((own.consommation_kw.mean(), own.consommation_kw.std(), own.consommation_kw.quantile(0.95)))


def test_null_types_are_judged_by_the_global_statistics(readings):
    out = detect.with_type_stats(readings).toPandas()
    assert len(out) == readings.count()
    unknown = out[out.type.isna()]
    assert len(unknown) and unknown.mean_t.to_numpy() == pytest.approx(out.consommation_kw.mean()) and (unknown.mean_t == unknown.mean_all).all()


def test_whole_detection_with_null_types(readings):
    scored = readings.withColumn("recon_error", F.abs("consommation_kw"))
    assert detect.enhanced_detection(scored).count() == readings.count()


def test_null_chains_are_verified(readings):
    rows = ledger.ordinal(readings, ["meter_id"], ["ts", "event_id"], rn="row_index").withColumn("row_hash", F.sha2(F.col("event_id").cast("string"), 256))
    blocks = ledger.ledger_blocks(rows.select("meter_id", "ts", "event_id", "statut", "row_index", "row_hash"), "meter_id", 5, NODES)
    chained = ledger.ledger_chain(blocks, "meter_id", NODES)
    checked = ledger.validate(chained, blocks, "meter_id", NODES).collect()
    assert any(r.meter_id is None for r in checked) and all(not r.errors for r in checked)
    out = ledger.verified_rows(rows, chained, "meter_id", 5)
    assert out.count() == readings.count() and out.filter("meter_id IS NULL AND block_index < 0").count() == 0
