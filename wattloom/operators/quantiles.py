"""Exact linear-interpolation percentiles that do not gather a group's values in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .lookup import lookup_join
from .series import add_running, fits_one_task, null_safe_join, slice_series, stored


def percentiles(df: DataFrame, keys: list[str], wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """One row per key with ``alias -> percentile p of column``.

    Below the one-task bound the built-in aggregate is used. Beyond it the values are counted first
    (which also absorbs hot keys), cumulative counts give the ranks, and the two order statistics around
    each rank are picked out.
    """
    by_column: dict[str, dict[str, float]] = {}
    for alias, (column, p) in wanted.items():
        by_column.setdefault(column, {})[alias] = p
    if fits_one_task(df, whole=not keys):
        # one pass over a column's values for all its percentiles
        packed = df.groupBy(*keys).agg(*[F.percentile(c, F.array(*[F.lit(float(p)) for p in ps.values()])).alias(f"__p{i}")
                                         for i, (c, ps) in enumerate(by_column.items())])
        where = {a: F.col(f"__p{i}")[j] for i, ps in enumerate(by_column.values()) for j, a in enumerate(ps)}
        return packed.select(*keys, *[where[a].alias(a) for a in wanted])
    # every group has a row, also the null key and groups without a value
    out = df.select(*keys).distinct() if keys else None
    for column, ps in by_column.items():
        part = _ranked(df, keys, column, ps)
        if keys:
            out = null_safe_join(out, part, keys, "left")
        else:
            out = part if out is None else out.select("*", *[part.select(a).scalar().alias(a) for a in ps])
    return out


def _ranked(df: DataFrame, keys: list[str], column: str, ps: dict[str, float]) -> DataFrame:
    counted = df.filter(F.col(column).isNotNull()).groupBy(*keys, F.col(column).alias("__v")).agg(F.count(F.lit(1)).alias("__c"))
    counted = stored(counted, "counted-values")  # sized, dealt and totalled
    run = add_running(slice_series(counted, keys, ["__v"]), {"__cum": F.col("__c")}).done()
    totals = counted.groupBy(*keys).agg(F.sum("__c").alias("__total"))
    if keys:
        run = lookup_join(run, totals, keys, sized_by=df)  # null keys match
    else:
        run = run.withColumn("__total", totals.scalar())
    picks, finals = [], []
    for alias, p in ps.items():
        rank = (F.col("__total") - 1) * F.lit(float(p))
        low = F.floor(rank)
        high = F.least(low + 1, F.col("__total") - 1)

        def at(index):
            return F.max(F.when((F.col("__cum") - F.col("__c") <= index) & (index < F.col("__cum")), F.col("__v")))

        picks += [at(low).alias(f"__l_{alias}"), at(high).alias(f"__h_{alias}"), F.max(rank - low).alias(f"__f_{alias}")]
        lo, hi = F.col(f"__l_{alias}"), F.col(f"__h_{alias}")
        finals.append((lo + (hi - lo) * F.col(f"__f_{alias}")).alias(alias))
    return run.groupBy(*keys).agg(*picks).select(*keys, *finals)


def with_scalars(df: DataFrame, one_row: DataFrame, prefix: str = "") -> DataFrame:
    """Attach the columns of a one-row frame as scalar subqueries (no join)."""
    names = one_row.columns
    pack = one_row.select(F.struct(*names).alias("s")).scalar()
    return df.withColumn("__s", pack).select(*df.columns, *[F.col("__s")[n].alias(prefix + n) for n in names])


def many_percentiles(df: DataFrame, column: str, ps: list[float]) -> DataFrame:
    """One row with the array ``q`` of the percentiles ``ps`` (some hundreds) of a column."""
    if fits_one_task(df, whole=True):
        return df.agg(F.percentile(column, F.array(*[F.lit(p) for p in ps])).alias("q"))
    counted = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("__v")).agg(F.count(F.lit(1)).alias("__c"))
    counted = stored(counted, "counted-values")
    run = add_running(slice_series(counted, [], ["__v"]), {"__cum": F.col("__c")}).done()
    ranks = F.transform(F.array(*[F.lit(p) for p in ps]), lambda p: (F.col("__total") - 1) * p)
    wanted = F.array_distinct(F.flatten(F.array(F.transform(ranks, lambda k: F.floor(k)),
                                                F.transform(ranks, lambda k: F.least(F.floor(k) + 1, F.col("__total") - 1)))))
    # the wanted places are worked out once, as a small table that the rows are joined with
    places = counted.agg(F.sum("__c").alias("__total")).select("__total", F.explode(wanted).alias("__i"))
    hits = run.join(F.broadcast(places), (F.col("__cum") - F.col("__c") <= F.col("__i")) & (F.col("__i") < F.col("__cum"))).select("__total", "__v", "__i")
    # two order statistics per percentile at most
    table = hits.groupBy("__total").agg(F.map_from_entries(F.collect_list(F.struct("__i", "__v"))).alias("__m"))

    def at(k):
        lo, hi = F.floor(k), F.least(F.floor(k) + 1, F.col("__total") - 1)
        a, b = F.element_at("__m", lo), F.element_at("__m", hi)
        return a + (b - a) * (k - lo)

    return table.select(F.transform(ranks, at).alias("q"))
