"""Ordered work inside a series (meter, zone, chain ...) that stays parallel when one series is huge.

A plain window keeps a whole series in one task. Where the input may hold a series too large for
that, the series above ``wattloom.split.rows`` rows are dealt by ranges of their full order, so that slices
hold equal numbers of rows whatever the values look like; the few rows a frame needs from the neighbouring
slices travel along as halo rows, and running totals get the sum of the earlier slices added. Null keys form
a series like any other. Small inputs, and all other series, keep the plain window, which gives the same rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from ..functions.expr import all_of
from ..session import scratch_dir

SLICE, HALO, HOT, ALL, ROWS = "__slice", "__halo", "__hot", "__series", "__series_rows"


def plan_bytes(df: DataFrame) -> tuple[int, int] | None:
    """Catalyst's size estimate of the frame and of its inputs, or None where they cannot be asked."""
    try:
        plan = df._jdf.queryExecution().optimizedPlan()
        leaves = plan.collectLeaves()
        inputs = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
        return int(str(plan.stats().sizeInBytes())), inputs
    except Exception:
        return None


WHOLE = 16  # a series without keys is surely as large as its frame


def fits_one_task(df: DataFrame, whole: bool = False) -> bool:
    """True only if the whole frame is below the size one task may hold, so no group of it can be larger.

    A join is estimated as the product of its sides; the joins here add columns, so inputs far below the
    limit are accepted as well. Where all rows form one group (``whole``) the limit is lower: the estimates are those of
    packed files, a task holds and sorts several times as much.
    """
    limit = int(df.sparkSession.conf.get("wattloom.split.bytes", str(256 * 1024 * 1024))) // (WHOLE if whole else 1)
    sizes = plan_bytes(df) if limit > 0 else None
    return sizes is not None and (sizes[0] <= limit or sizes[1] <= limit // 8)


def split_rows(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("wattloom.split.rows", "1000000"))


def stored(df: DataFrame, label: str) -> DataFrame:
    """The frame as a table in the shared scratch folder: computed once, survives lost executors, real size known."""
    path = scratch_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join by keys of which nulls match each other; the keys stay once, from the left."""
    names = {k: f"__r{i}" for i, k in enumerate(keys)}
    right = right.withColumnsRenamed(names)
    joined = left.join(right, all_of([F.col(k).eqNullSafe(F.col(r)) for k, r in names.items()]), how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*names.values())


@dataclass(frozen=True)
class Sliced:
    """A frame with its (possibly sliced) series window."""

    frame: DataFrame
    keys: list[str]
    order: list[str]
    split: bool

    @property
    def window(self) -> WindowSpec:
        parts = [*self.keys, SLICE] if self.split else self.keys
        return Window.partitionBy(*parts).orderBy(*self.order)

    def with_frame(self, frame: DataFrame) -> "Sliced":
        return Sliced(frame, self.keys, self.order, self.split)

    def core(self) -> "Sliced":
        """Without the halo rows."""
        return self.with_frame(self.frame.filter(~F.col(HALO))) if self.split else self

    def done(self) -> DataFrame:
        return self.core().frame.drop(SLICE, HALO, HOT, ALL, ROWS) if self.split else self.frame


def slice_series(df: DataFrame, keys: list[str], order: list[str], back: int = 0, ahead: int = 0,
                 sized_by: DataFrame | None = None) -> Sliced:
    """Attach slices to the large series of ``df``.

    ``order`` must be a total order inside a series, ascending.
    ``back`` / ``ahead`` are the rows a frame reaches before / after the current one.
    """
    if fits_one_task(sized_by if sized_by is not None else df, whole=not keys):
        return Sliced(df, list(keys), list(order), False)
    plain = Sliced(df, list(keys), list(order), False)
    keys, order = list(keys) or [ALL], list(order)
    limit = split_rows(df)
    df = df.withColumn(ALL, F.lit(0)) if keys == [ALL] else df
    hot = stored(df.groupBy(*keys).agg(F.count(F.lit(1)).alias(ROWS)).filter(F.col(ROWS) > limit), "hot-series")
    rows = hot.agg(F.sum(ROWS)).first()[0]
    if not rows:
        return plain
    # the ranges come from samples, so the slices are stored: every use must see the same ones
    single = keys == [ALL]  # all rows are in the one series, and none are left besides
    sized = df.withColumn(ROWS, F.lit(rows).cast("long")) if single else null_safe_join(df, hot, keys)
    dealt = sized.repartitionByRange(-(-rows // limit) + 1, *keys, *order)
    large = stored(dealt.withColumn(SLICE, F.spark_partition_id().cast("long")), "slices").withColumn(HOT, F.lit(True))
    if single:
        frame = large
    else:
        rest = null_safe_join(df, hot, keys, "left_anti").withColumns({ROWS: F.lit(None).cast("long"), SLICE: F.lit(0).cast("long"), HOT: F.lit(False)})
        frame = large.unionByName(rest)
    frame = frame.withColumn(HALO, F.lit(False))
    out = frame
    if back:
        out = out.unionByName(_halo(frame, keys, order, back, forward=True))
    if ahead:
        out = out.unionByName(_halo(frame, keys, order, ahead, forward=False))
    return Sliced(out, keys, order, True)


def _halo(frame: DataFrame, keys: list[str], order: list[str], reach: int, forward: bool) -> DataFrame:
    """The last ``reach`` rows before each slice (or the first after it), tagged with that slice."""
    near = [F.col(c).desc() if forward else F.col(c).asc() for c in order]
    along = [F.col(c).asc() if forward else F.col(c).desc() for c in order]
    edge = (
        frame.filter(F.col(HOT))
        .withColumn("__e", F.row_number().over(Window.partitionBy(*keys, SLICE).orderBy(*near)))
        .filter(F.col("__e") <= reach)
        .drop("__e")
        .withColumn("__p", F.row_number().over(Window.partitionBy(*keys).orderBy(*along)))
    )
    wanted = (
        edge.groupBy(*keys, SLICE)
        .agg(F.min("__p").alias("__p0"))
        .filter("__p0 > 1")
        .select(*keys, F.col(SLICE).alias("__target"),
                F.explode(F.sequence(F.greatest(F.lit(1), F.col("__p0") - reach), F.col("__p0") - 1)).alias("__p"))
    )
    return (
        null_safe_join(edge.drop(SLICE), wanted, [*keys, "__p"])
        .withColumn(HALO, F.lit(True))
        .withColumnRenamed("__target", SLICE)
        .drop("__p")
    )


def over_series(df: DataFrame, keys: list[str], order: list[str], columns: Callable[[WindowSpec], dict[str, Column]],
                back: int = 0, ahead: int = 0, sized_by: DataFrame | None = None) -> DataFrame:
    """Add window columns whose frames reach at most ``back`` rows back and ``ahead`` rows ahead."""
    s = slice_series(df, keys, order, back, ahead, sized_by)
    return s.with_frame(s.frame.withColumns(columns(s.window))).done()


def add_running(s: Sliced, sums: dict[str, Column], how: str = "sum", exclusive: bool = False) -> Sliced:
    """Add running totals (or maxima) over the whole series, with or without the current row."""
    s = s.core()
    agg, join = (F.sum, lambda a, b: a + b) if how == "sum" else (F.max, lambda a, b: F.greatest(a, b))
    upto = s.window.rowsBetween(Window.unboundedPreceding, -1 if exclusive else Window.currentRow)
    frame = s.frame.withColumns({name: agg(expr).over(upto) for name, expr in sums.items()})
    if not s.split:
        return s.with_frame(frame)
    earlier = Window.partitionBy(*s.keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        s.frame.filter(F.col(HOT))
        .groupBy(*s.keys, SLICE)
        .agg(*[agg(expr).alias(f"__t_{name}") for name, expr in sums.items()])
        .select(*s.keys, SLICE, *[agg(f"__t_{name}").over(earlier).alias(f"__o_{name}") for name in sums])
    )

    def both(name: str) -> Column:
        here, before = F.col(name), F.col(f"__o_{name}")
        return F.when(before.isNull(), here).when(here.isNull(), before).otherwise(join(here, before))

    frame = null_safe_join(frame, offsets, [*s.keys, SLICE], "left").withColumns({name: both(name) for name in sums})
    return s.with_frame(frame.drop(*[f"__o_{name}" for name in sums]))


def running(df: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column],
            sized_by: DataFrame | None = None, how: str = "sum", exclusive: bool = False) -> DataFrame:
    return add_running(slice_series(df, keys, order, sized_by=sized_by), sums, how, exclusive).done()


def ordinal(df: DataFrame, keys: list[str], order: list[str], rn: str = "rn", n: str | None = None,
            sized_by: DataFrame | None = None) -> DataFrame:
    """1-based row number inside the series, and optionally the series length."""
    s = slice_series(df, keys, order, sized_by=sized_by)
    s = add_running(s, {rn: F.lit(1).cast("long")})
    if n:
        parts = [*s.keys, SLICE] if s.split else s.keys
        count = F.count(F.lit(1)).over(Window.partitionBy(*parts))
        if s.split:
            count = F.when(F.col(HOT), F.col(ROWS)).otherwise(count)
        s = s.with_frame(s.frame.withColumn(n, count))
    return s.done()


def carry_forward(df: DataFrame, keys: list[str], order: list[str], values: dict[str, Column],
                  sized_by: DataFrame | None = None) -> DataFrame:
    """Add, per name, the latest non-null value up to and including the current row."""
    s = slice_series(df, keys, order, sized_by=sized_by)
    upto = s.window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    frame = s.frame.withColumns({name: F.last(expr, ignorenulls=True).over(upto) for name, expr in values.items()})
    if not s.split:
        return frame
    at = F.struct(*[F.col(c) for c in s.order])
    earlier = Window.partitionBy(*s.keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        s.frame.filter(F.col(HOT))
        .groupBy(*s.keys, SLICE)
        .agg(*[F.max_by(expr, F.when(expr.isNotNull(), at)).alias(f"__t_{name}") for name, expr in values.items()])
        .select(*s.keys, SLICE, *[F.last(f"__t_{name}", ignorenulls=True).over(earlier).alias(f"__o_{name}") for name in values])
    )
    frame = null_safe_join(frame, offsets, [*s.keys, SLICE], "left").withColumns(
        {name: F.coalesce(F.col(name), F.col(f"__o_{name}")) for name in values}
    )
    return s.with_frame(frame.drop(*[f"__o_{name}" for name in values])).done()


def islands(df: DataFrame, keys: list[str], order: list[str], starts: Callable[[WindowSpec], Column],
            out: str = "island", extra: Callable[[WindowSpec], dict[str, Column]] | None = None) -> DataFrame:
    """Number the runs of a series; ``starts`` tells from the current and previous row where one begins."""
    s = slice_series(df, keys, order, back=1)
    columns = {"__start": F.coalesce(starts(s.window).cast("long"), F.lit(1).cast("long"))}
    if extra:
        columns |= extra(s.window)
    s = s.with_frame(s.frame.withColumns(columns))
    return add_running(s, {out: F.col("__start")}).done().drop("__start")
