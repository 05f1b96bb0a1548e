"""Descriptive statistics, dashboards and rollups."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.expr import div0, total
from .features import latest_per_key
from .quantiles import percentiles, with_scalars
from .series import null_safe_join, over_series

# fixed values: share of the grid load per bus 1..14
BUS_WEIGHTS = [0.09, 0.08, 0.08, 0.07, 0.07, 0.07, 0.06, 0.07, 0.06, 0.06, 0.07, 0.08, 0.07, 0.07]


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """count, mean, std, min, quartiles, max: one row per column."""
    names = ["n", "mean", "std", "min", "max"]
    aggs = []
    for c in columns:
        aggs += [F.count(c).cast("double"), F.avg(c), F.stddev_samp(c), F.min(c).cast("double"), F.max(c).cast("double")]
    labels = [f"{c}|{n}" for c in columns for n in names]
    basic = df.agg(*[a.alias(x) for a, x in zip(aggs, labels)])
    quart = percentiles(df, [], {f"{c}|q{int(p * 100)}": (c, p) for c in columns for p in (0.25, 0.5, 0.75)})
    wide = with_scalars(basic, quart)
    stats = [*names, "q25", "q50", "q75"]
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), *[F.col(f"`{c}|{s}`").alias(s) for s in stats]) for c in columns])
    return wide.select(F.inline(rows))


def missing_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    counts = df.agg(F.count(F.lit(1)).alias("__n"), *[total(F.col(c).isNull()).alias(c) for c in columns])
    long = counts.unpivot("__n", columns, "feature", "missing")
    return long.select("feature", "missing", (100.0 * div0("missing", "__n")).alias("missing_pct"))


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Counts and shares of the values of several categories, from one scan."""
    sets = [[c] for c in columns]
    grouped = df.groupingSets(sets, *columns).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("g"))
    width = len(columns)
    which, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, c in enumerate(columns):
        here = F.col("g") == (2 ** width - 1 - 2 ** (width - 1 - i))
        which, value = F.when(here, F.lit(c)).otherwise(which), F.when(here, F.col(c)).otherwise(value)
    totals = df.agg(F.count(F.lit(1)))
    return grouped.select(which.alias("feature"), value.alias("value"), "n", (100.0 * F.col("n") / totals.scalar()).alias("pct"))


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlation of every pair of (a fixed list of) columns, in one aggregate."""
    pairs = list(combinations(columns, 2))
    wide = df.agg(*[F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("corr")) for i, (a, b) in enumerate(pairs)])
    return wide.select(F.inline(rows))


def iqr_outliers(df: DataFrame, columns: list[str]) -> DataFrame:
    q = percentiles(df, [], {f"{c}_{n}": (c, p) for c in columns for n, p in (("q1", 0.25), ("q3", 0.75))})
    wide = with_scalars(df.select(*columns), q)
    aggs = [F.count(F.lit(1)).alias("__n")]
    for c in columns:
        spread = F.col(f"{c}_q3") - F.col(f"{c}_q1")
        lo, hi = F.col(f"{c}_q1") - 1.5 * spread, F.col(f"{c}_q3") + 1.5 * spread
        aggs += [total((F.col(c) < lo) | (F.col(c) > hi)).alias(f"{c}_n"), F.max(lo).alias(f"{c}_lo"), F.max(hi).alias(f"{c}_hi")]
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"{c}_n").alias("outliers"),
                              (100.0 * F.col(f"{c}_n") / F.col("__n")).alias("pct"),
                              F.col(f"{c}_lo").alias("lower_bound"), F.col(f"{c}_hi").alias("upper_bound")) for c in columns])
    return wide.agg(*aggs).select(F.inline(rows))


def histogram(df: DataFrame, value: str, bins: int, by: list[str] = []) -> DataFrame:
    """Equal-width bins between the extremes; the last bin is closed."""
    ends = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    wide = with_scalars(df, ends, "__")
    width = (F.col("__hi") - F.col("__lo")) / bins
    b = F.least(F.coalesce(F.floor(F.try_divide(F.col(value) - F.col("__lo"), width)), F.lit(0)), F.lit(bins - 1)).cast("int")
    return wide.groupBy(*by, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def log_histogram(df: DataFrame, value: str, bins: int, by: list[str] = [], floor: float = 1e-9) -> DataFrame:
    """Bins of equal width in log10 between the extremes of the positive values."""
    logs = df.withColumn("__log", F.log10(F.greatest(F.col(value), F.lit(floor))))
    return histogram(logs, "__log", bins, by)


def grouped_baseline(df: DataFrame) -> DataFrame:
    """Mean, sample deviation and q95 of consumption per type (``overall`` 0, a null type is a type) and over all (``overall`` 1)."""
    grouped = df.groupingSets([[], ["type"]], "type").agg(
        F.avg("consommation_kw").alias("mean"), F.stddev_samp("consommation_kw").alias("std"), F.grouping_id().alias("overall"))
    per_type = percentiles(df, ["type"], {"q95": ("consommation_kw", 0.95)})
    overall = percentiles(df, [], {"q95": ("consommation_kw", 0.95)})
    q95 = F.when(F.col("overall") == 1, overall.scalar()).otherwise(F.col("q95"))
    return null_safe_join(grouped, per_type, ["type"], "left").select("type", "mean", "std", q95.alias("q95"), "overall")


def baseline_stats(df: DataFrame) -> DataFrame:
    """Mean, sample deviation and q95 of consumption, overall (type null) and per type."""
    return grouped_baseline(df).drop("overall")


def grid_status(meters: DataFrame, alerts: DataFrame) -> DataFrame:
    active = alerts.filter(~F.col("is_resolved")).agg(F.count(F.lit(1)))
    return meters.agg(
        F.count(F.lit(1)).alias("total_meters"),
        total(F.col("status") == "online").alias("online_meters"),
        total(F.col("status") == "offline").alias("offline_meters"),
        F.round(F.avg("voltage"), 2).alias("avg_voltage"),
        F.round(F.sum("power"), 2).alias("total_power"),
    ).withColumn("active_alerts", active.scalar())


def meter_status(df: DataFrame) -> DataFrame:
    """Totals, alert rate and per-status / per-type counts in one row; the categories are few by nature."""
    n = F.count(F.lit(1))

    def counts(c: str) -> Column:
        by = df.groupBy(F.coalesce(c, F.lit("unknown")).alias("k")).agg(n.alias("n"))
        return by.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "n"))))).scalar()

    alerts = total(F.col("statut") == "ALERTE")
    return df.agg(n.alias("total_readings"), alerts.alias("total_alerts"),
                  F.round(100.0 * div0(alerts, n), 2).alias("alert_rate")).withColumns(
        {"status_counts": counts("statut"), "meter_types": counts("type")})


def grid_totals(df: DataFrame) -> DataFrame:
    """Dashboard line over the latest state of each bus."""
    latest = latest_per_key(df, "bus_id", ["ts", "event_id"])
    return latest.agg(F.sum("consommation_kw").alias("total_kw"), F.avg("tension_v").alias("avg_voltage"),
                      F.avg("frequency_hz").alias("avg_frequency"), total(F.col("attack_type") != "normal").alias("attacks"))


def load_mix(df: DataFrame, by: str = "type") -> DataFrame:
    latest = latest_per_key(df, "bus_id", ["ts", "event_id"])
    return latest.groupBy(by).agg(F.sum("consommation_kw").alias("kw")).orderBy(F.desc("kw"))


def threat_level(attacks: Column, alerts: Column) -> Column:
    return F.when(attacks > 0, "critical").when(alerts > 0, "warning").otherwise("ok")


def device_rollup(devices: DataFrame, keys: list[str], power: str, active: Column) -> DataFrame:
    return devices.groupBy(*keys).agg(F.sum(power).alias("declared_kw"), total(active).alias("active_devices"), F.max(power).alias("peak_kw"))


def unexplained(metered: Column, declared: Column, solar: Column) -> Column:
    return F.greatest(metered - (declared - solar), F.lit(0.0))


def telemetry(df: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    at = F.struct(*order)
    out = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("avg"), F.max(value).alias("peak"),
                                F.min_by(value, at).alias("start"), F.max_by(value, at).alias("end"))
    return out.withColumn("growth", F.col("end") - F.col("start"))


def bottleneck(df: DataFrame, group: str, value: str) -> DataFrame:
    means = df.groupBy(group).agg(F.avg(value).alias("mean"))
    key = F.struct("mean", group)
    out = means.agg(F.max(key).alias("hi"), F.min(key).alias("lo"))
    return out.select(F.col(f"hi.{group}").alias("slowest"), F.col("hi.mean").alias("slowest_mean"),
                      F.col(f"lo.{group}").alias("fastest"), F.col("lo.mean").alias("fastest_mean"),
                      div0("hi.mean", "lo.mean").alias("ratio"))


def normalized_entropy(df: DataFrame, value: str, share_of: str) -> DataFrame:
    """Entropy of the shares of a total over the groups of ``share_of``, divided by log(groups)."""
    parts = df.groupBy(share_of).agg(F.sum(value).alias("part"))
    whole = parts.agg(F.sum("part").alias("whole"), F.count(F.lit(1)).alias("groups"))
    p = F.col("part") / F.col("whole")
    shares = with_scalars(parts, whole)
    return shares.agg((F.sum(-p * F.log(p + 1e-12)) / F.log(F.max("groups").cast("double"))).alias("entropy"),
                      F.avg((p < 0.5 / F.col("groups")).cast("double")).alias("sparsity"), F.max("groups").alias("groups"))


def allocate_load(production: DataFrame) -> DataFrame:
    """Spread a total (columns key, total_kw, capacity, charge) over the 14 weighted buses."""
    base = F.least(F.greatest(F.col("total_kw") * 0.34 + 10.0, F.lit(8.0)), F.lit(85.0))
    ratio = F.least(F.greatest(div0("charge", F.greatest(F.col("capacity"), F.lit(1.0))), F.lit(0.0)), F.lit(1.0))
    weights = F.array(*[F.lit(w) for w in BUS_WEIGHTS])
    out = production.select("*", ratio.alias("charge_ratio"), base.alias("base_kw"), F.posexplode(weights).alias("i", "weight"))
    kw = F.col("base_kw") * F.col("weight")
    return out.select("key", (F.col("i") + 1).alias("bus_id"), kw.alias("consumption"), "charge_ratio",
                      (0.992 + 0.03 * F.col("charge_ratio") - 0.015 * F.greatest(kw / 10.0 - 1.0, F.lit(0.0))).alias("voltage"))


def class_separation(df: DataFrame, vector: str, label: str) -> DataFrame:
    """Distance of the two class means over the mean within-class deviation of the dimensions."""
    cells = df.select(label, F.posexplode(vector).alias("dim", "x"))
    stats = cells.groupBy(label, "dim").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    spread = stats.agg(F.avg("s"))
    a, b = stats.alias("a"), stats.alias("b")
    pairs = a.join(b, (F.col("a.dim") == F.col("b.dim")) & (F.col(f"a.{label}") < F.col(f"b.{label}")))
    dist = pairs.groupBy(F.col(f"a.{label}").alias("class_a"), F.col(f"b.{label}").alias("class_b")).agg(
        F.sqrt(F.sum(F.pow(F.col("a.m") - F.col("b.m"), 2))).alias("distance"))
    return dist.withColumn("separation", F.col("distance") / (spread.scalar() + 1e-9))
