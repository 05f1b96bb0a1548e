"""Consumer-by-day queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions.expr import r
from ..operators import consumers as c, evaluate as e, features as f
from ..operators.quantiles import with_scalars
from ..session import scratch_dir
from ..sources.files import wide_day_columns
from ..sources.readings import Tables
from .evaluate import METRIC_SQL, QGRID, counts_sql, msql, shown, sweep_sql
from .registry import R, mix, query, view

view("cells", """SELECT d.cons_no, d.flag, d.day, c.kwh FROM (SELECT cons_no, flag, cast(unnest(generate_series((SELECT min(day) FROM consumer_days)::timestamp, (SELECT max(day) FROM consumer_days)::timestamp, INTERVAL 1 DAY)) as date) AS day
  FROM (SELECT DISTINCT cons_no, flag FROM consumer_days)) d LEFT JOIN consumer_days c ON d.cons_no = c.cons_no AND d.day = c.day""")
view("marked", """SELECT *, last_value(CASE WHEN kwh IS NOT NULL THEN day END IGNORE NULLS) OVER b AS d0, last_value(kwh IGNORE NULLS) OVER b AS v0,
  first_value(CASE WHEN kwh IS NOT NULL THEN day END IGNORE NULLS) OVER a AS d1, first_value(kwh IGNORE NULLS) OVER a AS v1, avg(cast(kwh IS NULL as double)) OVER (PARTITION BY cons_no) AS missing_frac FROM cells
WINDOW b AS (PARTITION BY cons_no ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY cons_no ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""")
view("filled_days", """SELECT *, CASE WHEN kwh IS NOT NULL THEN kwh WHEN v0 IS NOT NULL AND v1 IS NOT NULL THEN v0 + (v1 - v0) * (day - d0) / (d1 - d0) ELSE coalesce(v0, v1, 0) END AS filled FROM marked""")
DAYS = [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(30)]


def filled(t: Tables):
    return c.linear_impute(c.complete_calendar(t.consumer_days))


def calendar(t: Tables):
    a, b = c.calendar_bounds(t.events.select(F.col("ts").cast("date").alias("day")))
    return [a + dt.timedelta(days=i) for i in range((b - a).days + 1)]


@query("long_to_wide", "SELECT cons_no, flag, " + ", ".join(
    f"{R(f'sum(CASE WHEN day = DATE {chr(39)}{d}{chr(39)} THEN kwh END)', 4)} AS \"{c.day_name(d)}\"" for d in DAYS) + " FROM consumer_days GROUP BY cons_no, flag")
def long_to_wide(t: Tables):
    days = calendar(t)
    return c.long_to_wide(t.consumer_days, days).select("cons_no", "flag", *[r(F.col(f"`{c.day_name(d)}`"), 4).alias(c.day_name(d)) for d in days])


@query("wide_to_long", f"SELECT cons_no, flag, day, {R('kwh', 4)} AS kwh FROM cells")
def wide_to_long(t: Tables):
    path = scratch_dir(t.spark, "wide")
    c.long_to_wide(t.consumer_days, calendar(t)).write.option("header", "true").csv(path)
    wide = t.spark.read.option("header", "true").csv(path)
    long = c.wide_to_long(wide, wide_day_columns(wide.columns))
    return long.select(F.col("cons_no").cast("long").alias("cons_no"), F.col("flag").cast("int").alias("flag"), "day", r("kwh", 4).alias("kwh"))


@query("linear_impute", f"SELECT cons_no, day, {R('filled')} AS filled, {R('missing_frac')} AS missing_frac FROM filled_days")
def linear_impute(t: Tables):
    return filled(t).select("cons_no", "day", r("filled").alias("filled"), r("missing_frac").alias("missing_frac"))


view("populated", "SELECT f.*, p.population FROM filled_days f JOIN (SELECT day, coalesce(avg(kwh), (SELECT avg(filled) FROM filled_days)) AS population FROM filled_days GROUP BY day) p ON f.day = p.day")


@query("population_mean", f"SELECT cons_no, day, {R('population')} AS population, {R('filled - population')} AS vs_population FROM populated")
def population_mean(t: Tables):
    return c.population_mean(filled(t)).select("cons_no", "day", r("population").alias("population"), r("vs_population").alias("vs_population"))


@query("consumer_aggregates", f"""
WITH m AS (SELECT *, avg(filled) OVER (PARTITION BY cons_no) AS mu FROM filled_days), x AS (SELECT *, filled - mu AS x, lag(filled - mu) OVER (PARTITION BY cons_no ORDER BY day) AS lx FROM m)
SELECT cons_no, flag, {R('avg(filled)')} AS mean, {R('stddev_pop(filled)')} AS std, {R('stddev_pop(filled) / (avg(filled) + 1e-9)')} AS cv, {R('max(filled)')} AS max, {R('min(filled)')} AS min,
  {R('avg(cast(filled <= 1e-6 as int))')} AS zeros_frac, {R('coalesce(sum(x * lx), 0) / (sum(x * x) + 1e-9)')} AS acf1, {R('quantile_cont(filled, 0.1)')} AS q10, {R('quantile_cont(filled, 0.9)')} AS q90,
  {R('max(missing_frac)')} AS missing_frac FROM x GROUP BY cons_no, flag""")
def consumer_aggregates(t: Tables):
    return c.consumer_aggregates(filled(t)).select("cons_no", "flag", *[r(x).alias(x) for x in c.AGGREGATES])


@query("missingness", f"""WITH p AS (SELECT cons_no, avg(cast(kwh IS NULL as double)) AS frac, count(*) AS n FROM cells GROUP BY cons_no)
SELECT {R('100 * sum(frac * n) / sum(n)')} AS overall_pct, {R('100 * avg(frac)')} AS mean_pct, cast(sum(cast(frac > 0.5 as int)) as bigint) AS over_half, {R('100 * quantile_cont(frac, 0.5)')} AS median_pct FROM p""")
def missingness(t: Tables):
    out = c.missingness(c.complete_calendar(t.consumer_days))
    return out.select("over_half", *[r(x).alias(x) for x in ("overall_pct", "mean_pct", "median_pct")])


@query("class_profile", f"SELECT flag, day, {R('avg(kwh)')} AS mean_kwh, count(kwh) AS present FROM cells GROUP BY flag, day")
def class_profile(t: Tables):
    return c.class_profile(c.complete_calendar(t.consumer_days)).select("flag", "day", r("mean_kwh").alias("mean_kwh"), "present")


@query("consumer_scores", f"SELECT meter_id, {R('avg(score)')} AS score_mean, {R('quantile_cont(score, 0.95)')} AS score_p95 FROM scored GROUP BY meter_id")
def consumer_scores(t: Tables):
    out = c.consumer_scores(t.scored.select("meter_id", "score"), "meter_id", "score")
    return out.select("meter_id", r("score_mean").alias("score_mean"), r("score_p95").alias("score_p95"))


@query("consumer_windows", f"""SELECT cons_no, window_no, count(*) AS days, {R('sum(filled)')} AS kwh FROM (SELECT *, cast((row_number() OVER (PARTITION BY cons_no ORDER BY day) - 1) // 7 as bigint) AS window_no, count(*) OVER (PARTITION BY cons_no) AS len FROM filled_days)
WHERE (window_no + 1) * 7 <= len GROUP BY cons_no, window_no""")
def consumer_windows(t: Tables):
    w = f.tumbling_rows(filled(t).select("cons_no", "day", "filled"), ["cons_no"], ["day"], 7)
    return w.groupBy("cons_no", "window_no").agg(F.count(F.lit(1)).alias("days"), r(F.sum("filled")).alias("kwh"))


view("cscores", "SELECT cons_no, flag AS label, round(avg(abs(filled - population)), 6) AS score FROM populated GROUP BY cons_no, flag")
view("csplit", f"""SELECT *, CASE WHEN rn <= floor(len * 0.3::double) THEN 'test' WHEN rn <= floor(len * 0.3::double) + floor(len * 0.3::double) THEN 'val' ELSE 'train' END AS split FROM (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY {mix(42, 'cons_no')}, cons_no) AS rn, count(*) OVER (PARTITION BY label) AS len FROM cscores)""")
view("cval", "SELECT * FROM csplit WHERE split = 'val'")


@query("consumer_evaluation", f"""
WITH s AS ({sweep_sql(f'(SELECT list_distinct(quantile_cont(score, {QGRID})) FROM cval)', 'cval')}),
b AS (SELECT CASE WHEN (SELECT sum(label) FROM cval) > 0 THEN (SELECT t FROM s ORDER BY {METRIC_SQL['f1']} DESC, t LIMIT 1) ELSE (SELECT avg(score) + 3 * stddev_pop(score) FROM cval) END AS thr)
SELECT {R('thr')} AS threshold, {msql('precision', 'recall', 'f1', 'accuracy')}, tp + fn AS positives FROM (SELECT max(thr) AS thr, {counts_sql('score >= thr')} FROM csplit, b WHERE split = 'test')""")
def consumer_evaluation(t: Tables):
    scores = c.population_mean(filled(t)).groupBy("cons_no", "flag").agg(F.round(F.avg(F.abs("vs_population")), 6).alias("score"))
    tagged = e.stratified_split(scores.withColumnRenamed("flag", "label").filter("score is not null"), "label", "cons_no", 0.3, 0.3)
    thr = e.f1_threshold(tagged.filter("split = 'val'"), "score", "label").select(F.col("threshold").alias("thr"))
    test = with_scalars(tagged.filter("split = 'test'").select("label", "score"), thr)
    out = e.metrics(test, [], "label", "score >= thr")
    return with_scalars(out, thr).select(r("thr").alias("threshold"), *[r(x).alias(x) for x in ("precision", "recall", "f1", "accuracy")], (F.col("tp") + F.col("fn")).alias("positives"))
