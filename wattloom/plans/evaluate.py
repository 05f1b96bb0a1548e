"""Split, evaluation and calibration queries."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions.expr import MIX_MODULUS, div0, mix_factor, r
from ..operators import evaluate as e, features as f
from ..operators.lookup import lookup_join
from ..operators.quantiles import percentiles, with_scalars
from ..sources.readings import Tables
from .registry import R, mix, query, view

LABEL, HIT_A, HIT_B = "label", "score >= 0.6D", "score_b >= 0.5D"
A, B = "score >= 0.6::double", "score_b >= 0.5::double"


def counts_sql(hit: str, label: str = "label") -> str:
    return ", ".join(f"cast(coalesce(sum(cast({c} as int)), 0) as bigint) AS {n}" for n, c in (
        ("tp", f"{label} = 1 AND ({hit})"), ("fp", f"{label} <> 1 AND ({hit})"), ("fn", f"{label} = 1 AND NOT ({hit})"), ("tn", f"{label} <> 1 AND NOT ({hit})")))


def q0(a: str, b: str) -> str:
    return f"(CASE WHEN ({b}) = 0 THEN 0 ELSE ({a})::double / ({b}) END)"


P_, R_, S_ = q0("tp", "tp + fp"), q0("tp", "tp + fn"), q0("tn", "tn + fp")
METRIC_SQL = {
    "accuracy": q0("tp + tn", "tp + fp + fn + tn"), "precision": P_, "recall": R_, "f1": q0(f"2 * {P_} * {R_}", f"{P_} + {R_}"), "specificity": S_,
    "fpr": q0("fp", "fp + tn"), "fnr": q0("fn", "fn + tp"),
    "mcc": "(CASE WHEN tp + fn = 0 OR tn + fp = 0 THEN 0 ELSE " + q0("tp::double * tn - fp::double * fn", "sqrt((tp + fp)::double * (tp + fn) * (tn + fp) * (tn + fn))") + " END)",
    "balanced_accuracy": f"(CASE WHEN tp + fn = 0 OR tn + fp = 0 THEN {q0('tp + tn', 'tp + fp + fn + tn')} ELSE ({R_} + {S_}) / 2 END)",
}


def msql(*names: str) -> str:
    return ", ".join(f"{R(METRIC_SQL[n])} AS {n}" for n in (names or e.METRICS))


def shown(df, keys, names=tuple(e.METRICS)):
    return df.select(*keys, *[r(n).alias(n) for n in names])


SPLIT_SQL = """CASE WHEN rn <= len - cast(floor(len * 0.15::double) as bigint) * 2 THEN 'train' WHEN rn <= len - cast(floor(len * 0.15::double) as bigint) THEN 'val' ELSE 'test' END"""
view("splits", f"SELECT *, {SPLIT_SQL} AS split FROM (SELECT *, row_number() OVER (PARTITION BY meter_id ORDER BY ts, event_id) AS rn, count(*) OVER (PARTITION BY meter_id) AS len FROM scored)")


def splits(t: Tables):
    return e.temporal_split(t.scored, 0.15, 0.15)


@query("temporal_split", "SELECT event_id, split FROM splits")
def temporal_split(t: Tables):
    return splits(t).select("event_id", "split")


@query("split_windows", """SELECT meter_id, split, count(*) AS windows, min(event_id) AS first_end FROM (
  SELECT *, row_number() OVER (PARTITION BY meter_id, split ORDER BY ts, event_id) AS k FROM splits) WHERE k >= 5 GROUP BY meter_id, split""")
def split_windows(t: Tables):
    rows = splits(t).withColumn("is_alert", F.col("label"))
    w = f.sliding_windows(rows.select("event_id", "ts", "meter_id", "split", "zone", "type", "is_alert", "score"), ["meter_id", "split"], 5, ["score"])
    return w.groupBy("meter_id", "split").agg(F.count(F.lit(1)).alias("windows"), F.min("event_id").alias("first_end"))


MIX42 = mix(42)
view("strata", f"""SELECT *, CASE WHEN rn <= floor(len * 0.2::double) THEN 'test' WHEN rn <= floor(len * 0.2::double) + floor(len * 0.1::double) THEN 'val' ELSE 'train' END AS split FROM (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY u, event_id) AS rn, count(*) OVER (PARTITION BY label) AS len FROM (SELECT *, {MIX42} AS u FROM scored))""")


@query("stratified_split", "SELECT event_id, label, split FROM strata")
def stratified_split(t: Tables):
    return e.stratified_split(t.scored, "label", "event_id", 0.1, 0.2).select("event_id", "label", "split")


@query("stratified_sample", "SELECT event_id, label FROM strata WHERE rn <= round(len * 0.25::double)")
def stratified_sample(t: Tables):
    return e.stratified_sample(t.scored, "label", "event_id", 0.25).select("event_id", "label")


view("folds", "SELECT meter_id, cast((row_number() OVER (ORDER BY md5(concat('42:', meter_id)), meter_id) - 1) % 5 as int) AS fold FROM (SELECT DISTINCT meter_id FROM scored)")


@query("grouped_kfold", """SELECT s.event_id, s.meter_id, f.fold, CASE WHEN rn <= len - greatest(1, floor(len * 0.15::double)) THEN 'train' ELSE 'val' END AS role FROM splits s JOIN folds f ON s.meter_id = f.meter_id""")
def grouped_kfold(t: Tables):
    return e.grouped_kfold(t.scored, 5, 0.15).select("event_id", "meter_id", "fold", "role")


@query("fold_members", "SELECT f.fold AS test_fold, m.meter_id FROM (SELECT DISTINCT fold FROM folds) f, (SELECT DISTINCT meter_id, fold FROM folds) m WHERE m.fold <> f.fold")
def fold_members(t: Tables):
    # training meters of every fold: all meters but those tested in it (5 copies of the meter dimension)
    folds = e.meter_folds(t.scored, 5)
    copies = folds.select("meter_id", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("test_fold"))
    tested = folds.select("meter_id", F.col("fold").alias("test_fold"))
    present = tested.select("test_fold").distinct()
    return copies.join(tested, ["meter_id", "test_fold"], "left_anti").join(F.broadcast(present), "test_fold", "left_semi").select("test_fold", "meter_id")


@query("leakage_check", """
SELECT 'rows_in_two_splits' AS check_name, (SELECT count(*) FROM (SELECT event_id FROM splits WHERE split = 'train' INTERSECT SELECT event_id FROM splits WHERE split = 'test')) AS value
UNION ALL SELECT 'meters_in_two_folds', (SELECT count(*) FROM (SELECT meter_id FROM folds GROUP BY meter_id HAVING count(DISTINCT fold) > 1))
UNION ALL SELECT concat('rows_', split), count(*) FROM splits GROUP BY split""")
def leakage_check(t: Tables):
    s = splits(t).select("event_id", "split")
    both = s.filter("split = 'train'").select("event_id").intersect(s.filter("split = 'test'").select("event_id"))
    twice = e.meter_folds(t.scored, 5).groupBy("meter_id").agg(F.countDistinct("fold").alias("n")).filter("n > 1")
    n = F.count(F.lit(1)).alias("value")
    sizes = s.groupBy(F.concat(F.lit("rows_"), "split").alias("check_name")).agg(n)
    return (both.agg(n).select(F.lit("rows_in_two_splits").alias("check_name"), "value")
            .unionByName(twice.agg(n).select(F.lit("meters_in_two_folds").alias("check_name"), "value")).unionByName(sizes))


@query("confusion", f"SELECT type, {counts_sql(A)} FROM scored GROUP BY type")
def confusion(t: Tables):
    return t.scored.groupBy("type").agg(*[c.alias(n) for n, c in e.confusion(LABEL, HIT_A).items()])


@query("classification_metrics", f"SELECT 'a' AS model, {msql()} FROM (SELECT {counts_sql(A)} FROM scored) UNION ALL SELECT 'b', {msql()} FROM (SELECT {counts_sql(B)} FROM scored)")
def classification_metrics(t: Tables):
    cells = [F.struct(F.lit(m).alias("model"), *[F.col(f"{m}_{n}").alias(n) for n in ("tp", "fp", "fn", "tn")]) for m in ("a", "b")]
    both = t.scored.agg(*[c.alias(f"{m}_{n}") for m, h in (("a", HIT_A), ("b", HIT_B)) for n, c in e.confusion(LABEL, h).items()])
    return shown(both.select(F.inline(F.array(*cells))).withColumns(e.metric_columns()), ["model"])


def auc_sql(source: str, score: str, keys: str = "", label: str = "label") -> str:
    k = f"{keys}, " if keys else ""
    part = f"PARTITION BY {keys} " if keys else ""
    return f"""SELECT {k}CASE WHEN p = 0 OR n = 0 THEN 0.5 ELSE (rs - p * (p + 1) / 2) / (p::double * n) END AS auc FROM (
  SELECT {k}sum(CASE WHEN {label} = 1 THEN rk END) AS rs, sum({label})::double AS p, sum(1 - {label})::double AS n FROM (
    SELECT {k}{label}, rank() OVER ({part}ORDER BY {score}) + (count(*) OVER (PARTITION BY {k}{score}) - 1) / 2.0::double AS rk FROM {source}) {'GROUP BY ' + keys if keys else ''})"""


@query("roc_auc", f"SELECT type, {R('auc')} AS roc_auc FROM ({auc_sql('scored', 'score', 'type')}) UNION ALL SELECT 'ALL', {R('auc')} FROM ({auc_sql('scored', 'score')})")
def roc_auc(t: Tables):
    whole = e.curve_areas(t.scored, [], "score", "label").select(F.lit("ALL").alias("type"), r("roc_auc").alias("roc_auc"))
    return e.curve_areas(t.scored, ["type"], "score", "label").select("type", r("roc_auc").alias("roc_auc")).unionByName(whole)


@query("pr_auc", f"""WITH c AS (SELECT type, score, sum(label) AS pos, count(*) AS n FROM scored GROUP BY 1, 2),
d AS (SELECT *, sum(pos) OVER w AS tp, sum(n) OVER w AS k, sum(pos) OVER (PARTITION BY type) AS p FROM c WINDOW w AS (PARTITION BY type ORDER BY score DESC))
SELECT type, {R('sum(pos::double / p * tp / k)')} AS pr_auc FROM d GROUP BY type""")
def pr_auc(t: Tables):
    return e.curve_areas(t.scored, ["type"], "score", "label").select("type", r("pr_auc").alias("pr_auc"))


@query("pct_rank", f"SELECT event_id, {R('row_number() OVER (ORDER BY score, event_id)::double / count(*) OVER ()')} AS pct_rank FROM scored")
def pct_rank(t: Tables):
    return e.percent_rank_by_order(t.scored.select("event_id", "score"), "score", "event_id").select("event_id", r("pct_rank").alias("pct_rank"))


@query("cume_rank", f"SELECT event_id, {R('cume_dist() OVER (ORDER BY score)')} AS cume_rank FROM scored")
def cume_rank(t: Tables):
    return e.cumulative_rank(t.scored.select("event_id", "score"), "score").select("event_id", r("cume_rank").alias("cume_rank"))


def sweep_sql(cands: str, source: str = "scored", score: str = "score") -> str:
    """Rows (t, tp, fp, fn, tn) for a scalar list expression of thresholds."""
    return f"SELECT t, {counts_sql(f'{score} >= t')} FROM {source}, (SELECT unnest({cands}) AS t) g GROUP BY t"


QGRID = "[" + ", ".join(repr(0.5 + j * ((0.999 - 0.5) / 299)) for j in range(300)) + "]"
F1_SWEEP = sweep_sql(f"(SELECT list_distinct(quantile_cont(score, {QGRID})) FROM scored)")


@query("f1_threshold", f"SELECT {R('t')} AS threshold, {R(METRIC_SQL['f1'])} AS f1 FROM ({F1_SWEEP}) ORDER BY {METRIC_SQL['f1']} DESC, t LIMIT 1")
def f1_threshold(t: Tables):
    return e.f1_threshold(t.scored, "score", "label").select(r("threshold").alias("threshold"), r("f1").alias("f1"))


COST_SWEEP = sweep_sql("(SELECT [lo + i * ((hi - lo) / 299) for i in range(0, 300)] FROM (SELECT min(score) AS lo, quantile_cont(score, 0.99) AS hi FROM scored))")


@query("cost_threshold", f"""WITH s AS (SELECT t, {METRIC_SQL['f1']} AS f1, (5 * fn + fp)::double / (tp + fp + fn + tn) AS cost FROM ({COST_SWEEP}))
SELECT {R('(SELECT t FROM s ORDER BY f1 DESC, t LIMIT 1)')} AS f1_threshold, {R('(SELECT t FROM s ORDER BY cost, t LIMIT 1)')} AS cost_threshold, {R('min(cost)')} AS cost, {R('max(f1)')} AS f1 FROM s""")
def cost_threshold(t: Tables):
    c = e.cost_curve(t.scored, "score", "label")
    at = F.col("threshold")
    return c.agg(r(F.min_by(at, F.struct((-F.col("f1")).alias("a"), at.alias("b")))).alias("f1_threshold"),
                 r(F.min_by(at, F.struct("cost", at.alias("b")))).alias("cost_threshold"), r(F.min("cost")).alias("cost"), r(F.max("f1")).alias("f1"))


SENS = "[" + ", ".join(repr(0.6 * ((1 - 0.5) + i * (2 * 0.5 / 40))) for i in range(41)) + "]"


@query("threshold_sensitivity", f"""WITH s AS (SELECT t, {METRIC_SQL['f1']} AS f1, {METRIC_SQL['fpr']} AS fpr, (t - 0.6::double) / 0.6 * 100 AS pct FROM ({sweep_sql(SENS + '::double[]')}))
SELECT {R('t')} AS threshold, {R('f1')} AS f1, {R('fpr')} AS fpr, {R('(lead(f1) OVER w - lag(f1) OVER w) / (lead(pct) OVER w - lag(pct) OVER w)')} AS f1_slope,
  {R('(lead(fpr) OVER w - lag(fpr) OVER w) / (lead(pct) OVER w - lag(pct) OVER w)')} AS fpr_slope FROM s WINDOW w AS (ORDER BY t)""")
def threshold_sensitivity(t: Tables):
    out = e.sensitivity(t.scored, "score", "label", 0.6)
    return out.select(*[r(c).alias(c) for c in ("threshold", "f1", "fpr", "f1_slope", "fpr_slope")])


view("fold_metrics", f"SELECT fold, {', '.join(f'{METRIC_SQL[m]} AS {m}' for m in e.METRICS)} FROM (SELECT fold, {counts_sql(A)} FROM scored s JOIN folds f ON s.meter_id = f.meter_id GROUP BY fold)")
view("fold_metrics_b", f"SELECT fold, {', '.join(f'{METRIC_SQL[m]} AS {m}' for m in e.METRICS)} FROM (SELECT fold, {counts_sql(B)} FROM scored s JOIN folds f ON s.meter_id = f.meter_id GROUP BY fold)")


@query("fold_summary", " UNION ALL ".join(
    f"SELECT '{m}' AS metric, {R(f'avg({m})')} AS mean, {R(f'stddev_pop({m})')} AS std, {R(f'CASE WHEN avg({m}) = 0 THEN 0 ELSE 100 * stddev_pop({m}) / avg({m}) END')} AS cv_pct FROM fold_metrics" for m in e.METRICS))
def fold_summary(t: Tables):
    rows = lookup_join(t.scored, e.meter_folds(t.scored, 5), ["meter_id"])
    long = e.metrics(rows, ["fold"], LABEL, HIT_A).select("fold", *e.METRICS).unpivot(["fold"], e.METRICS, "metric", "value")
    out = long.groupBy("metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    return out.select("metric", r("mean").alias("mean"), r("std").alias("std"), r(div0(100 * F.col("std"), "mean")).alias("cv_pct"))


@query("cohens_d", f"SELECT {R('avg(a.f1 - b.f1)')} AS mean_diff, {R('avg(a.f1 - b.f1) / stddev_samp(a.f1 - b.f1)')} AS cohens_d FROM fold_metrics a JOIN fold_metrics_b b ON a.fold = b.fold")
def cohens_d(t: Tables):
    rows = lookup_join(t.scored, e.meter_folds(t.scored, 5), ["meter_id"])
    a = e.metrics(rows, ["fold"], LABEL, HIT_A).select("fold", F.col("f1").alias("f1_a"))
    b = e.metrics(rows, ["fold"], LABEL, HIT_B).select("fold", F.col("f1").alias("f1_b"))
    return e.cohens_d(a.join(b, "fold"), "f1_a", "f1_b").select(r("mean_diff").alias("mean_diff"), r("cohens_d").alias("cohens_d"))


@query("bootstrap_ci")
def bootstrap_ci(t: Tables):
    return e.bootstrap_ci(t.scored, LABEL, HIT_A)


# the draw of ``evaluate.bootstrap_weight`` for row ``event_id`` in replicate ``b``
_X = f"((event_id % {MIX_MODULUS} * ({mix_factor(0)} + b * 209458) + b * 104729 + 104729) % {MIX_MODULUS})"
_U = f"((({_X} * {_X} + event_id % {MIX_MODULUS}) % {MIX_MODULUS} * {mix_factor(3)} + 7919) % {MIX_MODULUS})"
_DRAW = " + ".join(f"CASE WHEN u >= {math.ceil(p * MIX_MODULUS)} THEN 1 ELSE 0 END" for p in e.POISSON_ONE)
REPLICATES = 500


@query("bootstrap_areas", f"""
WITH w AS (SELECT b, score, label, {_DRAW} AS w FROM (SELECT b, score, label, {_U} AS u FROM scored, range({REPLICATES}) AS r(b))),
c AS (SELECT b, score, sum(w * label)::double AS pos, sum(w * (1 - label))::double AS neg FROM w WHERE w > 0 GROUP BY b, score
  UNION ALL SELECT -1, score, sum(label)::double, sum(1 - label)::double FROM scored GROUP BY score),
d AS (SELECT *, sum(neg) OVER (PARTITION BY b ORDER BY score) - neg AS below, sum(pos) OVER up AS tp, sum(pos + neg) OVER up AS k, sum(pos) OVER (PARTITION BY b) AS p, sum(neg) OVER (PARTITION BY b) AS n
  FROM c WINDOW up AS (PARTITION BY b ORDER BY score DESC)),
areas AS (SELECT b, CASE WHEN min(p) = 0 OR min(n) = 0 THEN 0.5 ELSE sum(pos * (below + neg / 2)) / (min(p) * min(n)) END AS roc_auc,
  CASE WHEN min(p) = 0 OR min(n) = 0 THEN min(p) / (min(p) + min(n)) ELSE sum(pos / p * tp / k) END AS pr_auc FROM d GROUP BY b),
long AS (SELECT b, 'roc_auc' AS metric, roc_auc AS v FROM areas UNION ALL SELECT b, 'pr_auc', pr_auc FROM areas)
SELECT metric, {R('max(CASE WHEN b = -1 THEN v END)')} AS point, {R('quantile_cont(CASE WHEN b >= 0 THEN v END, 0.025)')} AS lo, {R('quantile_cont(CASE WHEN b >= 0 THEN v END, 0.975)')} AS hi FROM long GROUP BY metric""")
def bootstrap_areas(t: Tables):
    out = e.bootstrap_areas(t.scored, "score", "label", "event_id", REPLICATES)
    return out.select("metric", *[r(c).alias(c) for c in ("point", "lo", "hi")])


@query("mcnemar", f"""WITH c AS (SELECT cast(sum(cast(({A}) = (label = 1) AND ({B}) <> (label = 1) as int)) as bigint) AS b01, cast(sum(cast(({A}) <> (label = 1) AND ({B}) = (label = 1) as int)) as bigint) AS b10 FROM scored)
SELECT b01, b10, {R('CASE WHEN b01 + b10 = 0 THEN 0 ELSE power(abs(b01 - b10) - 1, 2)::double / (b01 + b10) END')} AS statistic, {R('(b01 + 0.5) / (b10 + 0.5)')} AS odds_ratio FROM c""")
def mcnemar(t: Tables):
    # the two models' predictions arrive as two tables and meet on the row id
    a, b = t.scored.select("event_id", "label", "score"), t.scored.select("event_id", "score_b")
    out = e.mcnemar(a.join(b, "event_id"), LABEL, HIT_A, HIT_B)
    return out.select("b01", "b10", r("statistic").alias("statistic"), r("odds_ratio").alias("odds_ratio"))


@query("reliability_bins", f"SELECT cast(least(floor(score * 15), 14) as int) AS bin, count(*) AS n, {R('avg(score)')} AS confidence, {R('avg(label)')} AS accuracy FROM scored GROUP BY 1")
def reliability_bins(t: Tables):
    return e.reliability_bins(t.scored, [], "score", "label").select("bin", "n", r("confidence").alias("confidence"), r("accuracy").alias("accuracy"))


view("probs", """SELECT event_id, label, 'raw' AS method, score AS prob FROM scored UNION ALL SELECT event_id, label, 'platt', 1 / (1 + exp(-(12 * score - 9))) FROM scored
UNION ALL SELECT event_id, label, 'rank', cume_dist() OVER (ORDER BY score) FROM scored""")
view("calibrations", """SELECT method, sum(n * gap) / sum(n) AS ece, max(gap) AS mce, max(CASE WHEN n >= 10 THEN gap END) AS mce_robust, sum(sq) / sum(n) AS brier FROM (
  SELECT method, count(*) AS n, abs(avg(label) - avg(prob)) AS gap, sum(power(prob - label, 2)) AS sq FROM probs GROUP BY method, least(floor(prob * 15), 14)) GROUP BY method""")
CAL = ("ece", "mce", "mce_robust", "brier")


def calibrated(t: Tables):
    base = e.cumulative_rank(t.scored.select("event_id", "label", "score"), "score")
    probs = F.array(*[F.struct(F.lit(m).alias("method"), p.alias("prob")) for m, p in (
        ("raw", F.col("score")), ("platt", e.platt(F.col("score"), 12.0, -9.0)), ("rank", F.col("cume_rank")))])
    return e.calibration_error(base.select("label", F.inline(probs)), ["method"], "prob", "label")


@query("calibration_error", f"SELECT method, {', '.join(f'{R(c)} AS {c}' for c in CAL)} FROM calibrations")
def calibration_error(t: Tables):
    return calibrated(t).select("method", *[r(c).alias(c) for c in CAL])


@query("calibrator_rank", f"SELECT method, {R('mce_robust')} AS mce_robust, {R('ece')} AS ece, {R('brier')} AS brier FROM calibrations ORDER BY mce_robust, ece, brier LIMIT 1")
def calibrator_rank(t: Tables):
    out = calibrated(t).orderBy("mce_robust", "ece", "brier").limit(1)
    return out.select("method", *[r(c).alias(c) for c in ("mce_robust", "ece", "brier")])


@query("mean_calibration_error", f"""SELECT {R('avg(abs(freq - (bin + 0.5::double) / 15))')} AS mean_error, count(*) AS bins FROM (SELECT floor(score * 15) AS bin, avg(label) AS freq FROM scored WHERE score < 1 GROUP BY 1)""")
def mean_calibration_error(t: Tables):
    return e.mean_calibration_error(t.scored, "score", "label").select(r("mean_error").alias("mean_error"), "bins")


@query("platt_apply", f"SELECT event_id, {R('1 / (1 + exp(-(12 * score - 9)))')} AS probability FROM scored")
def platt_apply(t: Tables):
    return t.scored.select("event_id", r(e.platt(F.col("score"), 12.0, -9.0)).alias("probability"))


@query("temperature_fit", f"""WITH c AS (SELECT score, sum(label) AS pos, sum(1 - label) AS neg FROM scored GROUP BY score), st AS (SELECT avg(score) AS m, greatest(stddev_pop(score), 1e-9) AS s FROM scored),
g AS (SELECT 0.05::double + i * ((5.0::double - 0.05::double) / 199) AS T FROM (SELECT unnest(range(0, 200)) AS i)),
n AS (SELECT T, -sum(pos * ln(p + 1e-12) + neg * ln(1 - p + 1e-12)) / sum(pos + neg) AS nll FROM (SELECT *, 1 / (1 + exp(-((score - m) / s / T))) AS p FROM c, st, g) GROUP BY T)
SELECT {R('arg_min(T, nll)')} AS temperature, {R('min(nll)')} AS nll FROM n""")
def temperature_fit(t: Tables):
    out = e.temperature_grid(t.scored, "score", "label")
    return out.agg(r(F.min_by("T", "nll")).alias("temperature"), r(F.min("nll")).alias("nll"))


@query("drift_recovery", f"""WITH d AS (SELECT *, score + 0.05 AS drifted FROM splits), q AS (SELECT quantile_cont(drifted, 0.9) AS nt FROM d WHERE split = 'val' AND label = 0),
f AS (SELECT avg(cast(score >= 0.6::double as int)) AS clean, avg(cast(drifted >= 0.6::double as int)) AS stale, avg(cast(drifted >= nt as int)) AS recal FROM d, q WHERE split = 'test' AND label = 0)
SELECT {R('clean')} AS fpr_clean, {R('stale')} AS fpr_stale, {R('recal')} AS fpr_recalibrated, {R('100 * (stale - recal) / greatest(stale - clean, 1e-9)')} AS recovered_pct FROM f""")
def drift_recovery(t: Tables):
    # the recalibrated threshold is the 90th percentile here: the score range of the test tables is short
    d = splits(t).withColumn("drifted", F.col("score") + 0.05)
    nt = percentiles(d.filter("split = 'val' AND label = 0"), [], {"nt": ("drifted", 0.9)})
    test = with_scalars(d.filter("split = 'test' AND label = 0"), nt)

    def rate(c):
        return F.avg(c.cast("double"))

    out = test.agg(rate(F.col("score") >= 0.6).alias("clean"), rate(F.col("drifted") >= 0.6).alias("stale"), rate(F.col("drifted") >= F.col("nt")).alias("recal"))
    c, s, n = F.col("clean"), F.col("stale"), F.col("recal")
    return out.select(r(c).alias("fpr_clean"), r(s).alias("fpr_stale"), r(n).alias("fpr_recalibrated"),
                      r(100 * (s - n) / F.greatest(s - c, F.lit(1e-9))).alias("recovered_pct"))


@query("recalibration_compare", f"""WITH q AS (SELECT quantile_cont(score, 0.98) AS nt FROM scored WHERE label = 0)
SELECT 'old' AS threshold_name, {msql('precision', 'recall', 'f1')} FROM (SELECT {counts_sql(A)} FROM scored) UNION ALL SELECT 'new', {msql('precision', 'recall', 'f1')} FROM (SELECT {counts_sql('score >= nt')} FROM scored, q)""")
def recalibration_compare(t: Tables):
    nt = percentiles(t.scored.filter("label = 0"), [], {"nt": ("score", 0.98)})
    rows = with_scalars(t.scored.select("label", "score"), nt)
    marks = F.array(F.struct(F.lit("old").alias("threshold_name"), (F.col("score") >= 0.6).alias("hit")),
                    F.struct(F.lit("new").alias("threshold_name"), (F.col("score") >= F.col("nt")).alias("hit")))
    out = e.metrics(rows.select("label", F.inline(marks)), ["threshold_name"], LABEL, F.col("hit"))
    return shown(out, ["threshold_name"], ("precision", "recall", "f1"))


view("quartered", "SELECT *, CASE WHEN i < n // 4 THEN 1 WHEN i < n // 2 THEN 2 WHEN i < 3 * n // 4 THEN 3 ELSE 4 END AS quarter FROM (SELECT *, row_number() OVER (ORDER BY ts, event_id) - 1 AS i, count(*) OVER () AS n FROM scored)")


@query("quarter_metrics", f"""SELECT m.quarter, precision, recall, f1, {R('auc')} AS roc_auc FROM (SELECT quarter, {msql('precision', 'recall', 'f1')} FROM (SELECT quarter, {counts_sql(A)} FROM quartered GROUP BY quarter)) m
JOIN ({auc_sql('quartered', 'score', 'quarter')}) a ON m.quarter = a.quarter""")
def quarter_metrics(t: Tables):
    rows = f.temporal_quarters(t.scored.select("event_id", "ts", "label", "score"), f.ORDER)
    areas = e.curve_areas(rows, ["quarter"], "score", "label").select("quarter", r("roc_auc").alias("roc_auc"))
    return shown(e.metrics(rows, ["quarter"], LABEL, HIT_A), ["quarter"], ("precision", "recall", "f1")).join(areas, "quarter")


view("meter_parts", "SELECT meter_id, CASE WHEN row_number() OVER (ORDER BY meter_id) <= floor(count(*) OVER () * 0.8::double) THEN 'seen' ELSE 'held_out' END AS part FROM (SELECT DISTINCT meter_id FROM scored)")


@query("meter_generalisation", f"SELECT part, {msql()} FROM (SELECT part, {counts_sql(A)} FROM scored s JOIN meter_parts p ON s.meter_id = p.meter_id GROUP BY part)")
def meter_generalisation(t: Tables):
    return shown(e.meter_generalisation(t.scored, LABEL, HIT_A), ["part"])


@query("meter_f1", f"SELECT meter_id, {msql('f1')} FROM (SELECT meter_id, {counts_sql(A)} FROM scored GROUP BY meter_id) WHERE tp + fn > 0")
def meter_f1(t: Tables):
    return shown(e.metrics(t.scored, ["meter_id"], LABEL, HIT_A).filter("tp + fn > 0"), ["meter_id"], ("f1",))


@query("heldout_rows", "SELECT event_id, meter_id FROM scored WHERE meter_id IN (SELECT meter_id FROM meter_parts WHERE part = 'held_out')")
def heldout_rows(t: Tables):
    dim = e.ordinal(t.scored.select("meter_id").distinct(), [], ["meter_id"], rn="rn", n="n")
    held = dim.filter(F.col("rn") > F.floor(F.col("n") * 0.8)).select("meter_id")
    return t.scored.select("event_id", "meter_id").join(held, "meter_id", "left_semi")


@query("meter_difference", "SELECT DISTINCT meter_id FROM readings EXCEPT SELECT DISTINCT meter_id FROM alerts WHERE severity = 'critical' AND is_resolved AND attack_type = 'dos'")
def meter_difference(t: Tables):
    hit = t.alerts.filter("severity = 'critical' AND is_resolved AND attack_type = 'dos'").select("meter_id")
    return t.readings.select("meter_id").subtract(hit)


@query("score_overlap", f"""SELECT {R('greatest(100 * (least(max(CASE WHEN label = 0 THEN score END), max(CASE WHEN label = 1 THEN score END)) - greatest(min(CASE WHEN label = 0 THEN score END), min(CASE WHEN label = 1 THEN score END))) / (max(CASE WHEN label = 1 THEN score END) - min(CASE WHEN label = 0 THEN score END) + 1e-12), 0)')} AS overlap_pct FROM scored""")
def score_overlap(t: Tables):
    return e.score_overlap(t.scored, "score", "label").select(r("overlap_pct").alias("overlap_pct"))


FRACTIONS = [0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]
MIX7 = mix(7)


@query("learning_curve", f"SELECT fraction, {msql('precision', 'recall', 'f1')} FROM (SELECT fraction, {counts_sql(A)} FROM (SELECT *, {MIX7} AS u FROM scored) s, (SELECT unnest({FRACTIONS}::double[]) AS fraction) q WHERE u < fraction GROUP BY fraction)")
def learning_curve(t: Tables):
    return shown(e.learning_curve(t.scored, LABEL, HIT_A, "event_id", FRACTIONS), ["fraction"], ("precision", "recall", "f1"))


@query("stability_summary", f"""WITH q AS (SELECT quarter, {METRIC_SQL['f1']} AS f1 FROM (SELECT quarter, {counts_sql(A)} FROM quartered GROUP BY quarter)),
p AS (SELECT part, {METRIC_SQL['f1']} AS f1 FROM (SELECT part, {counts_sql(A)} FROM scored s JOIN meter_parts p ON s.meter_id = p.meter_id GROUP BY part)),
w AS (SELECT {METRIC_SQL['precision']} AS precision, {METRIC_SQL['recall']} AS recall FROM (SELECT {counts_sql(A)} FROM scored))
SELECT {R('1 - abs((SELECT f1 FROM q WHERE quarter = 1) - (SELECT f1 FROM q WHERE quarter = 4))')} AS temporal_stability,
  {R("1 - greatest(0, (SELECT f1 FROM p WHERE part = 'seen') - (SELECT f1 FROM p WHERE part = 'held_out'))")} AS meter_generalisation,
  {R(f'(SELECT auc FROM ({auc_sql("scored", "score")}))')} AS roc_auc, {R('precision')} AS precision, {R('recall')} AS recall FROM w""")
def stability_summary(t: Tables):
    rows = t.scored.select("event_id", "ts", "meter_id", "label", "score")
    q = e.metrics(f.temporal_quarters(rows, f.ORDER), ["quarter"], LABEL, HIT_A)
    drift = q.agg((1 - F.abs(F.max(F.when(F.col("quarter") == 1, F.col("f1"))) - F.max(F.when(F.col("quarter") == 4, F.col("f1"))))).alias("x"))
    p = e.meter_generalisation(rows, LABEL, HIT_A)
    gap = F.max(F.when(F.col("part") == "seen", F.col("f1"))) - F.max(F.when(F.col("part") == "held_out", F.col("f1")))
    general = p.agg((1 - F.greatest(F.lit(0.0), gap)).alias("x"))
    auc = e.curve_areas(rows, [], "score", "label").select("roc_auc")
    base = e.metrics(rows, [], LABEL, HIT_A).select(r("precision").alias("precision"), r("recall").alias("recall"))
    return base.select(r(drift.scalar()).alias("temporal_stability"), r(general.scalar()).alias("meter_generalisation"), r(auc.scalar()).alias("roc_auc"), "precision", "recall")


@query("metrics_by_type", f"""SELECT anomaly_type, n, {msql('precision', 'recall', 'f1')} FROM (SELECT coalesce(anomaly_type, 'OVERALL') AS anomaly_type, count(*) AS n, {counts_sql('is_anomaly', 'is_alert')} FROM enhanced GROUP BY GROUPING SETS ((), (anomaly_type)))""")
def metrics_by_type(t: Tables):
    from .detect import detected
    g = detected(t).select("anomaly_type", "is_alert", "is_anomaly").groupingSets([[], ["anomaly_type"]], "anomaly_type")
    out = g.agg(F.count(F.lit(1)).alias("n"), *[c.alias(n) for n, c in e.confusion(F.col("is_alert"), F.col("is_anomaly")).items()])
    out = out.withColumn("anomaly_type", F.coalesce("anomaly_type", F.lit("OVERALL"))).withColumns(e.metric_columns())
    return shown(out, ["anomaly_type", "n"], ("precision", "recall", "f1"))


@query("recall_by_attack", f"""SELECT attack, count(*) AS n, {R(f'avg(cast({A} as int))')} AS recall FROM (SELECT *, split_part(concat(anomalies, ' | ', type), ' | ', 1) AS attack FROM scored WHERE label = 1) GROUP BY attack""")
def recall_by_attack(t: Tables):
    joined = F.concat("anomalies", F.lit(" | "), "type")
    rows = t.scored.filter("label = 1").withColumn("attack", F.split(joined, r" \| ")[0])
    return rows.groupBy("attack").agg(F.count(F.lit(1)).alias("n"), r(F.avg(F.expr(HIT_A).cast("double"))).alias("recall")).orderBy(F.desc("n"))


@query("detection_latency", f"""
WITH a AS (SELECT s.*, r.is_alert, row_number() OVER w AS rn, coalesce(cast(r.is_alert <> lag(r.is_alert) OVER w as int), 1) AS st FROM scored s JOIN readings r ON s.event_id = r.event_id WINDOW w AS (PARTITION BY s.meter_id ORDER BY s.ts, s.event_id)),
b AS (SELECT *, sum(st) OVER (PARTITION BY meter_id ORDER BY rn) AS island FROM a)
SELECT min(event_id) AS first_id, meter_id, count(*) AS burst_rows, max(cast({A} as int)) = 1 AS detected, cast(coalesce(min(CASE WHEN {A} THEN rn END) - min(rn), -1) as bigint) AS latency FROM b WHERE is_alert = 1 GROUP BY meter_id, island""")
def detection_latency(t: Tables):
    rows = t.scored.select("event_id", "ts", "meter_id", F.col("label").alias("is_alert"), "score")
    return e.detection_latency(rows, HIT_A)


@query("normal_false_alarms", f"""SELECT meter_id, cast(sum(cast(rn <= 8 AND {A} as int)) as bigint) AS fp_warmup, {R(f'avg(cast({A} as int))')} AS fpr FROM (SELECT *, row_number() OVER (PARTITION BY meter_id ORDER BY ts, event_id) AS rn FROM scored) WHERE label = 0 GROUP BY meter_id""")
def normal_false_alarms(t: Tables):
    rows = e.ordinal(t.scored.select("event_id", "ts", "meter_id", "label", "score"), f.METER, f.ORDER).filter("label = 0")
    return rows.groupBy("meter_id").agg(e.total(F.expr(HIT_A) & (F.col("rn") <= 8)).alias("fp_warmup"), r(F.avg(F.expr(HIT_A).cast("double"))).alias("fpr"))


FEATS = ["consommation_kw", "tension_v", "courant_a", "frequency_hz", "power_factor"]


@query("feature_auc", " UNION ALL ".join(f"SELECT '{c}' AS feature, {R('greatest(auc, 1 - auc)')} AS auc FROM ({auc_sql('readings', c, '', 'is_alert')})" for c in FEATS))
def feature_auc(t: Tables):
    return e.feature_auc(t.readings, FEATS, "is_alert").select("feature", r("auc").alias("auc"))


LEVELS = [0.0, 0.05, 0.1, 0.2, 0.3]
view("drift_runs", " UNION ALL ".join(f"SELECT {x}::double AS level, {METRIC_SQL['f1']} AS f1, {METRIC_SQL['recall']} AS recall FROM (SELECT {counts_sql(f'score + {x}::double >= 0.6::double')} FROM scored)" for x in LEVELS))


def drift_runs(t: Tables):
    """F1 and recall of a frozen threshold when all scores drift up by a level."""
    marks = F.array(*[F.struct(F.lit(x).alias("level"), (F.col("score") + x >= 0.6).alias("hit")) for x in LEVELS])
    return e.metrics(t.scored.select("label", F.inline(marks)), ["level"], LABEL, F.col("hit")).select("level", "f1", "recall")


@query("degradation", f"""SELECT d.level, {R('c.f1')} AS clean, {R('d.f1')} AS perturbed, {R('c.f1 - d.f1')} AS abs_drop, {R('CASE WHEN c.f1 > 1e-9 THEN (c.f1 - d.f1) / c.f1 * 100 ELSE 0 END')} AS pct_drop
FROM drift_runs d, (SELECT f1 FROM drift_runs WHERE level = 0) c WHERE d.level > 0""")
def degradation(t: Tables):
    runs = drift_runs(t)
    out = runs.filter("level > 0").withColumn("c", runs.filter("level = 0").select("f1").scalar())
    drop = F.col("c") - F.col("f1")
    return out.select("level", r("c").alias("clean"), r("f1").alias("perturbed"), r(drop).alias("abs_drop"),
                      r(F.when(F.col("c") > 1e-9, drop / F.col("c") * 100).otherwise(0.0)).alias("pct_drop"))


@query("retention_scores", f"""SELECT {R('100 * avg(least(1, greatest(0, d.f1 / c.f1)))')} AS f1_retention, {R('100 * avg(least(1, greatest(0, d.recall / c.recall)))')} AS recall_retention
FROM drift_runs d, (SELECT f1, recall FROM drift_runs WHERE level = 0) c WHERE d.level > 0""")
def retention_scores(t: Tables):
    runs = drift_runs(t)
    out = with_scalars(runs.filter("level > 0"), runs.filter("level = 0").select("f1", "recall"), "c_")

    def kept(c):
        return r(100 * F.avg(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.try_divide(F.col(c), F.col(f"c_{c}"))))))

    return out.agg(kept("f1").alias("f1_retention"), kept("recall").alias("recall_retention"))


@query("component_ranking", f"""WITH g AS (SELECT zone, type, {counts_sql(A)} FROM scored GROUP BY 1, 2), a AS (SELECT sum(tp) tp, sum(fp) fp, sum(fn) fn, sum(tn) tn FROM g),
x AS (SELECT zone, type, {METRIC_SQL['f1']} AS f1 FROM (SELECT zone, type, a.tp - g.tp AS tp, a.fp - g.fp AS fp, a.fn - g.fn AS fn, a.tn - g.tn AS tn FROM g, a)), b AS (SELECT {METRIC_SQL['f1']} AS f1 FROM a)
SELECT zone AS component, arg_max(type, b.f1 - x.f1) AS worst_variant, {R('max(b.f1 - x.f1)')} AS max_delta_f1 FROM x, b GROUP BY zone""")
def component_ranking(t: Tables):
    # leaving out one type of one zone is an ablated variant of that zone
    cells = ["tp", "fp", "fn", "tn"]
    g = t.scored.groupBy("zone", "type").agg(*[c.alias(n) for n, c in e.confusion(LABEL, HIT_A).items()])
    whole = g.agg(*[F.sum(c).alias(c) for c in cells])
    base = whole.withColumns(e.metric_columns()).select("f1")
    left = with_scalars(g, whole, "all_").select("zone", "type", *[(F.col(f"all_{c}") - F.col(c)).alias(c) for c in cells]).withColumns(e.metric_columns())
    out = left.withColumn("delta", base.scalar() - F.col("f1"))
    return out.groupBy(F.col("zone").alias("component")).agg(F.max_by("type", "delta").alias("worst_variant"), r(F.max("delta")).alias("max_delta_f1")).orderBy(F.desc("max_delta_f1"))


view("versions", f"SELECT zone, day, round(auc, 6) AS auc, row_number() OVER (PARTITION BY zone ORDER BY day) AS rn FROM ({auc_sql('(SELECT *, cast(ts as date) AS day FROM scored)', 'score', 'zone, day')})")


@query("champion_fold", f"""WITH RECURSIVE f AS (SELECT zone, day, auc, rn, auc AS best, 'champion' AS status FROM versions WHERE rn = 1
  UNION ALL SELECT v.zone, v.day, v.auc, v.rn, CASE WHEN v.auc >= f.best - 0.02::double THEN v.auc ELSE f.best END, CASE WHEN v.auc >= f.best - 0.02::double THEN 'champion' ELSE 'rolled_back' END FROM f JOIN versions v ON v.zone = f.zone AND v.rn = f.rn + 1)
SELECT zone, cast(day as varchar) AS day, {R('auc')} AS auc,
  CASE WHEN status = 'champion' AND rn < max(CASE WHEN status = 'champion' THEN rn END) OVER (PARTITION BY zone) THEN 'retired' ELSE status END AS status FROM f""")
def champion_fold(t: Tables):
    rows = t.scored.withColumn("day", F.col("ts").cast("date"))
    versions = e.curve_areas(rows, ["zone", "day"], "score", "label").select("zone", "day", F.round("roc_auc", 6).alias("auc"))
    return e.champion_fold(versions, "zone", "day", "auc", 0.02).select("zone", "day", r("auc").alias("auc"), "status")
