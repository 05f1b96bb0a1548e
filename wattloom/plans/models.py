"""Model-based queries (rows-only checks: iterative or random fits) and fitted-parameter tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expr import mix_uniform, r
from ..operators import evaluate as e, features as f, models as m
from ..operators.detect import z_scores
from ..operators.lookup import stored
from ..session import scratch_dir
from ..sources.files import append_log
from ..sources.readings import Tables
from .evaluate import auc_sql
from .registry import R, mix, query, view

FEATURES = ["consommation_kw", "tension_v", "courant_a", "power_factor", "frequency_hz"]


@query("isolation_forest")
def isolation_forest(t: Tables):
    rows = t.readings.select("event_id", "zone", "type", *FEATURES)
    out = m.segmented_detection(rows, FEATURES)
    return out.select("event_id", "segment", r("forest_score").alias("forest_score"), F.array_join("anomalies_found", ",").alias("anomalies"), "is_anomaly")


STEPS, CELLS = 8, ["consommation_kw", "tension_v", "courant_a"]


def flat_windows(t: Tables):
    w, names = f.flat_windows(t.readings.select("event_id", "ts", "meter_id", "is_alert", *CELLS), f.METER, STEPS, CELLS)
    # the fit passes over the windows four times: they are cut once and stored
    return stored(w, "windows"), names


@query("pca_recon_score")
def pca_recon_score(t: Tables):
    windows, names = flat_windows(t)
    return m.pca_reconstruction(windows, names, "label_last", 6).select("event_id", "label_last", r("recon_error").alias("recon_error"))


@query("prediction_table")
def prediction_table(t: Tables):
    """Per-window predictions as a stored table: end index, score, label, decision, split.

    The cut-off is the F1-optimal threshold of the validation windows; the test windows have no part in it.
    """
    windows, names = flat_windows(t)
    scored = m.pca_reconstruction(windows, names, "label_last", 6)
    tagged = scored.join(e.temporal_split(t.readings.select("event_id", "ts", "meter_id"), 0.15, 0.15).select("event_id", "split"), "event_id")
    tagged = stored(tagged, "scored-windows")
    cut = e.f1_threshold(tagged.filter("split = 'val'"), "recon_error", "label_last").select("threshold")
    path = scratch_dir(t.spark, "predictions")
    tagged.select(F.col("event_id").alias("end_index"), F.col("recon_error").alias("anomaly_score"), F.col("label_last").alias("sequence_label"),
                  (F.col("recon_error") >= cut.scalar()).cast("int").alias("predicted"), "split").write.partitionBy("split").parquet(path)
    return t.spark.read.parquet(path)


@query("intrinsic_dim")
def intrinsic_dim(t: Tables):
    return m.intrinsic_dimension(f.standardize(t.readings.select(*FEATURES), FEATURES), FEATURES)


@query("platt_fit")
def platt_fit(t: Tables):
    raw = m.platt_fit(t.scored, "score", "label", log=False).select(F.lit("raw").alias("form"), "a", "b")
    return raw.unionByName(m.platt_fit(t.scored, "score", "label").select(F.lit("log").alias("form"), "a", "b"))


# the max-min formula: the largest, over starts up to a score, of the least mean over ends from it on
@query("isotonic_fit", f"""
WITH c AS (SELECT score, row_number() OVER (ORDER BY score) AS i, sum(sum(label)) OVER (ORDER BY score) AS s, sum(count(*)) OVER (ORDER BY score) AS w, sum(label) AS pos, count(*) AS n FROM scored GROUP BY score),
means AS (SELECT a.i AS j, b.i AS k, (b.s - a.s + a.pos)::double / (b.w - a.w + a.n) AS m FROM c a JOIN c b ON b.i >= a.i),
least_after AS (SELECT j, k, min(m) OVER (PARTITION BY j ORDER BY k DESC) AS m FROM means)
SELECT score, {R('max(m)', 9)} AS probability FROM least_after JOIN c ON c.i = k GROUP BY score""")
def isotonic_fit(t: Tables):
    return m.isotonic_fit(t.scored, "score", "label").select("score", r("probability", 9).alias("probability"))


SUPERVISED = [*FEATURES, "consommation_kw_diff", "hour"]  # nothing that is derived from the label


@query("supervised_models")
def supervised_models(t: Tables):
    rows = f.over_series(t.readings, f.METER, f.ORDER, lambda w: {"consommation_kw_diff": f.diff(w, "consommation_kw")}, back=1, sized_by=t.readings)
    tagged = e.temporal_split(rows.withColumn("hour", F.hour("ts")), 0.15, 0.15).select("event_id", "split", "is_alert", *SUPERVISED)
    rows = stored(tagged, "training-rows")  # both learners pass over these rows many times
    # both summaries read the predictions
    pred = stored(m.supervised(rows.filter("split = 'train'"), rows.filter("split = 'test'"), SUPERVISED, "is_alert"), "predictions")
    quality = e.metrics(pred, ["model"], "label", "probability >= 0.5D")
    areas = e.curve_areas(pred, ["model"], "probability", "label")
    return quality.join(areas, "model").select("model", *[r(c).alias(c) for c in (*e.METRICS, "roc_auc", "pr_auc")])


def squared_deviation(df):
    return z_scores(df, CELLS).withColumn("score", F.round(sum((F.pow(f"{c}_z", 2) for c in CELLS), F.lit(0.0)), 9))


def dealt_sql(i: int, column: str) -> str:
    """The readings with one z column dealt out again, and their deviation score."""
    others = " + ".join(f"power({x}, 2)" for x in ZCOLS if x != column)
    a, b = mix(100 + 2 * i), mix(101 + 2 * i)
    return (f"(SELECT a.is_alert, round({others.replace('power(', 'power(a.')} + power(b.v, 2), 9) AS s FROM (SELECT *, row_number() OVER (ORDER BY {a}, event_id) AS k FROM zreadings) a "
            f"JOIN (SELECT {column} AS v, row_number() OVER (ORDER BY {b}, event_id) AS k FROM zreadings) b ON a.k = b.k)")


ZCOLS = ["kw_z", "v_z", "a_z"]
BASE_AUC = auc_sql("(SELECT is_alert, round(power(kw_z, 2) + power(v_z, 2) + power(a_z, 2), 9) AS s FROM zreadings)", "s", "", "is_alert")


@query("permutation_importance", " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {R(f'(SELECT auc FROM ({BASE_AUC})) - auc', 5)} AS importance FROM ({auc_sql(dealt_sql(i, z), 's', '', 'is_alert')})"
    for i, (c, z) in enumerate(zip(CELLS, ZCOLS))))
def permutation_importance(t: Tables):
    rows = t.readings.select("event_id", "is_alert", *CELLS)
    return m.permutation_importance(rows, CELLS, squared_deviation, "is_alert", "event_id", e.permute_column).select("feature", r("importance", 5).alias("importance"))


view("window_kw", f"""SELECT w.event_id, max(CASE WHEN s.event_id = w.event_id THEN s.is_alert END) AS label, list(s.consommation_kw ORDER BY s.rn) AS ordered,
  list(s.consommation_kw ORDER BY {mix(3, 'w.event_id * 8 + s.rn - w.rn + 7')}, s.rn) AS shuffled FROM (SELECT event_id, meter_id, row_number() OVER (PARTITION BY meter_id ORDER BY ts, event_id) AS rn FROM readings) w
  JOIN (SELECT *, row_number() OVER (PARTITION BY meter_id ORDER BY ts, event_id) AS rn FROM readings) s ON w.meter_id = s.meter_id AND s.rn BETWEEN w.rn - 7 AND w.rn WHERE w.rn >= 8 GROUP BY w.event_id""")


@query("shuffle_test", " UNION ALL ".join(f"SELECT '{x}' AS form, {R('auc')} AS roc_auc FROM ({auc_sql(f'(SELECT label, abs({x}[8] - {x}[7]) AS s FROM window_kw)', 's')})" for x in ("ordered", "shuffled")))
def shuffle_test(t: Tables):
    """AUC of an order-sensitive window score before and after shuffling the steps inside each window."""
    cols = ["event_id", "ts", "meter_id", "zone", "type", "is_alert", "consommation_kw"]
    w = f.sliding_windows(t.readings.select(*cols), f.METER, STEPS, ["consommation_kw"]).select("event_id", "label_last", F.transform("steps", lambda s: s["consommation_kw"]).alias("x"))
    keyed = F.array_sort(F.transform("x", lambda v, i: F.struct(mix_uniform(F.col("event_id") * STEPS + i, 3).alias("h"), i.alias("i"), v.alias("v"))))
    shuffled = F.transform(keyed, lambda s: s["v"])

    def last_jump(x):
        return F.abs(x[STEPS - 1] - x[STEPS - 2])

    forms = F.array(F.struct(F.lit("ordered").alias("form"), last_jump(F.col("x")).alias("score")), F.struct(F.lit("shuffled").alias("form"), last_jump(shuffled).alias("score")))
    return e.curve_areas(w.select("label_last", F.inline(forms)), ["form"], "score", "label_last").select("form", r("roc_auc").alias("roc_auc"))


@query("fitted_parameters", " UNION ALL ".join(
    f"SELECT {v} AS version, cast({i} as int) AS position, '{c}' AS feature, {R(f'avg({c})')} AS mean, {R(f'stddev_pop({c})')} AS scale FROM readings{w}"
    for v, w in ((1, ""), (2, " WHERE is_alert = 0")) for i, c in enumerate(CELLS)))
def fitted_parameters(t: Tables):
    """One row of arrays per fit, appended to a recalibration log."""
    path = scratch_dir(t.spark, "parameters")
    for version, rows in ((1, t.readings), (2, t.readings.filter("is_alert = 0"))):
        stats = f.scaler_stats(rows, CELLS)
        append_log(stats.select(F.lit(version).alias("version"), F.array(*[F.lit(c) for c in CELLS]).alias("columns"),
                                F.array(*[F.col(f"{c}_mean") for c in CELLS]).alias("mean"), F.array(*[F.col(f"{c}_scale") for c in CELLS]).alias("scale")), path)
    log = t.spark.read.parquet(path)
    out = log.select("version", F.posexplode(F.arrays_zip("columns", "mean", "scale")).alias("position", "z"))
    return out.select("version", "position", F.col("z.columns").alias("feature"), r("z.mean").alias("mean"), r("z.scale").alias("scale"))
