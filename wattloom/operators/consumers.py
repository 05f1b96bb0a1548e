"""Consumer-by-day tables: wide and long form, imputation, consumer vectors.

After aggregation there is one row per consumer and calendar day, so a window over one consumer never
holds more rows than the calendar has days, however skewed the raw readings are.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.expr import div0
from .lookup import lookup_join
from .quantiles import percentiles, with_scalars


def day_name(day: dt.date) -> str:
    """Column name of a day in the wide form, without zero padding."""
    return f"{day.year}/{day.month}/{day.day}"


def long_to_wide(long: DataFrame, days: list[dt.date]) -> DataFrame:
    named = long.withColumn("name", F.date_format("day", "y/M/d"))
    return named.groupBy("cons_no", "flag").pivot("name", [day_name(d) for d in days]).agg(F.sum("kwh"))


def wide_to_long(wide: DataFrame, day_columns: list[str]) -> DataFrame:
    """One row per consumer and day column; empty cells stay as nulls, the flag is inherited."""
    long = wide.unpivot(["cons_no", "flag"], day_columns, "name", "kwh")
    return long.select("cons_no", "flag", F.to_date("name", "y/M/d").alias("day"), F.col("kwh").cast("double").alias("kwh"))


def calendar_bounds(long: DataFrame) -> tuple[dt.date, dt.date]:
    """First and last day of the table: one small row."""
    row = long.agg(F.min("day").alias("a"), F.max("day").alias("b")).first()
    return row["a"], row["b"]


def complete_calendar(long: DataFrame) -> DataFrame:
    """Every consumer on every day of the table's calendar; absent cells are null."""
    ends = long.agg(F.min("day").alias("a"), F.max("day").alias("b"))
    dim = with_scalars(long.select("cons_no", "flag").distinct(), ends)
    days = dim.select("cons_no", "flag", F.explode(F.sequence("a", "b")).alias("day"))
    return days.join(long.select("cons_no", "day", "kwh"), ["cons_no", "day"], "left")


def linear_impute(cells: DataFrame) -> DataFrame:
    """Linear interpolation along the days, edges held, all-null consumers 0; keeps the missing fraction."""
    w = Window.partitionBy("cons_no").orderBy("day")
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    own = Window.partitionBy("cons_no")
    known = F.when(F.col("kwh").isNotNull(), F.struct(F.datediff("day", F.lit("1970-01-01")).alias("i"), F.col("kwh").alias("v")))
    df = cells.withColumn("__k", known).withColumns({
        "__a": F.last("__k", ignorenulls=True).over(back),
        "__b": F.first("__k", ignorenulls=True).over(ahead),
        "missing_frac": F.avg(F.col("kwh").isNull().cast("double")).over(own),
    })
    i = F.datediff("day", F.lit("1970-01-01"))
    a, b = F.col("__a"), F.col("__b")
    between = a["v"] + (b["v"] - a["v"]) * (i - a["i"]) / (b["i"] - a["i"])
    filled = (F.when(F.col("kwh").isNotNull(), F.col("kwh")).when(a.isNotNull() & b.isNotNull(), between)
              .otherwise(F.coalesce(a["v"], b["v"], F.lit(0.0))))
    return df.withColumn("filled", filled).drop("__k", "__a", "__b")


def population_mean(filled: DataFrame) -> DataFrame:
    """Mean per day over the cells that were present; a day without any gets the mean of all filled cells."""
    per_day = filled.groupBy("day").agg(F.avg("kwh").alias("population"))
    whole = filled.agg(F.avg("filled"))
    pop = per_day.select("day", F.coalesce("population", whole.scalar()).alias("population"))
    out = lookup_join(filled, pop, ["day"])
    return out.withColumn("vs_population", F.col("filled") - F.col("population"))


def consumer_aggregates(filled: DataFrame) -> DataFrame:
    """Ten-number vector per consumer."""
    w = Window.partitionBy("cons_no").orderBy("day")
    own = Window.partitionBy("cons_no")
    df = filled.withColumn("__mean", F.avg("filled").over(own)).withColumn("__x", F.col("filled") - F.col("__mean"))
    df = df.withColumn("__lag", F.lag("__x").over(w))
    x = F.col("filled")
    out = df.groupBy("cons_no", "flag").agg(
        F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.max(x).alias("max"), F.min(x).alias("min"),
        F.avg((x <= 1e-6).cast("double")).alias("zeros_frac"),
        (F.coalesce(F.sum(F.col("__x") * F.col("__lag")), F.lit(0.0)) / (F.sum(F.col("__x") * F.col("__x")) + 1e-9)).alias("acf1"),
        F.percentile(x, F.lit(0.1)).alias("q10"), F.percentile(x, F.lit(0.9)).alias("q90"), F.max("missing_frac").alias("missing_frac"))
    return out.withColumn("cv", F.col("std") / (F.col("mean") + 1e-9))


AGGREGATES = ["mean", "std", "cv", "max", "min", "zeros_frac", "acf1", "q10", "q90", "missing_frac"]


def missingness(cells: DataFrame) -> DataFrame:
    per = cells.groupBy("cons_no").agg(F.avg(F.col("kwh").isNull().cast("double")).alias("frac"), F.count(F.lit(1)).alias("n"))
    med = percentiles(per, [], {"median_pct": ("frac", 0.5)})
    out = per.agg((100 * F.sum(F.col("frac") * F.col("n")) / F.sum("n")).alias("overall_pct"), (100 * F.avg("frac")).alias("mean_pct"),
                  F.sum((F.col("frac") > 0.5).cast("long")).alias("over_half"))
    return with_scalars(out, med.select((100 * F.col("median_pct")).alias("median_pct")))


def class_profile(cells: DataFrame) -> DataFrame:
    return cells.groupBy("flag", "day").agg(F.avg("kwh").alias("mean_kwh"), F.count("kwh").alias("present"))


def consumer_scores(windows: DataFrame, consumer: str, score: str) -> DataFrame:
    """Window scores as one score per consumer: typical (mean) and worst-window (p95)."""
    mean = windows.groupBy(consumer).agg(F.avg(score).alias("score_mean"))
    p95 = percentiles(windows, [consumer], {"score_p95": (score, 0.95)})
    return mean.join(p95, consumer)
