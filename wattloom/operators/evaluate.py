"""Splits, evaluation metrics, threshold search and calibration."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.expr import div0, mix_factor, MIX_MODULUS, mix_uniform, sigmoid, total
from .features import METER, ORDER
from .lookup import lookup_join
from .quantiles import many_percentiles, percentiles, with_scalars
from .series import add_running, fits_one_task, islands, ordinal, running, slice_series, stored


# ---- splits ----------------------------------------------------------------

def temporal_split(df: DataFrame, val_frac: float, test_frac: float) -> DataFrame:
    """train, val, test along each meter's time; the two tails take the floor of their share."""
    df = ordinal(df, METER, ORDER, rn="__rn", n="__len")
    n_test, n_val = F.floor(F.col("__len") * test_frac), F.floor(F.col("__len") * val_frac)
    n_train = F.col("__len") - n_test - n_val
    tag = F.when(F.col("__rn") <= n_train, "train").when(F.col("__rn") <= n_train + n_val, "val").otherwise("test")
    return df.withColumn("split", tag).drop("__rn", "__len")


def _shuffled(df: DataFrame, stratum: str, ident: str, seed: int) -> DataFrame:
    """Rank inside the stratum in an order that depends on the row ids only."""
    mixed = df.withColumn("__u", mix_uniform(ident, seed))
    return ordinal(mixed, [stratum], ["__u", ident], rn="__rn", n="__len").drop("__u")


def stratified_split(df: DataFrame, stratum: str, ident: str, val_frac: float, test_frac: float, seed: int = 42) -> DataFrame:
    df = _shuffled(df, stratum, ident, seed)
    n_test, n_val = F.floor(F.col("__len") * test_frac), F.floor(F.col("__len") * val_frac)
    tag = F.when(F.col("__rn") <= n_test, "test").when(F.col("__rn") <= n_test + n_val, "val").otherwise("train")
    return df.withColumn("split", tag).drop("__rn", "__len")


def stratified_sample(df: DataFrame, stratum: str, ident: str, fraction: float, seed: int = 42) -> DataFrame:
    """The sampling operator: the same share of every stratum."""
    df = _shuffled(df, stratum, ident, seed)
    return df.filter(F.col("__rn") <= F.round(F.col("__len") * fraction)).drop("__rn", "__len")


def meter_folds(df: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """Fold per meter, dealt out in id-hash order."""
    dim = df.select("meter_id").distinct().withColumn("__h", F.md5(F.concat_ws(":", F.lit(seed), "meter_id")))
    return ordinal(dim, [], ["__h", "meter_id"], rn="__rn").select("meter_id", ((F.col("__rn") - 1) % k).cast("int").alias("fold"))


def grouped_kfold(df: DataFrame, k: int, val_frac: float, seed: int = 42) -> DataFrame:
    """Rows with the fold in which their meter is tested, and the part they play in the other folds.

    At least one row of a meter is for validation.
    """
    tagged = ordinal(df, METER, ORDER, rn="__rn", n="__len")
    role = F.when(F.col("__rn") <= F.col("__len") - F.greatest(F.lit(1), F.floor(F.col("__len") * val_frac)), "train").otherwise("val")
    return tagged.withColumn("role", role).drop("__rn", "__len").transform(lambda rows: lookup_join(rows, meter_folds(df, k, seed), ["meter_id"], sized_by=df))


# ---- confusion metrics -----------------------------------------------------

def cond(c: Column | str) -> Column:
    return F.expr(c) if isinstance(c, str) else c


def confusion(label: Column | str, hit: Column | str) -> dict[str, Column]:
    hit, yes = cond(hit), cond(label) == 1
    return {"tp": total(yes & hit), "fp": total(~yes & hit), "fn": total(yes & ~hit), "tn": total(~yes & ~hit)}


def metric_columns() -> dict[str, Column]:
    """Metrics from the columns tp, fp, fn, tn; an empty denominator gives 0."""
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    precision, recall, spec = div0(tp, tp + fp), div0(tp, tp + fn), div0(tn, tn + fp)
    root = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    both = (tp + fn > 0) & (tn + fp > 0)
    accuracy = div0(tp + tn, tp + fp + fn + tn)
    return {
        "accuracy": accuracy, "precision": precision, "recall": recall, "f1": f1_of(precision, recall),
        "specificity": spec, "fpr": div0(fp, fp + tn), "fnr": div0(fn, fn + tp),
        "mcc": F.when(both, div0(tp * tn - fp * fn, root)).otherwise(0.0),
        "balanced_accuracy": F.when(both, (recall + spec) / 2).otherwise(accuracy),
    }


METRICS = ["accuracy", "precision", "recall", "f1", "specificity", "fpr", "fnr", "mcc", "balanced_accuracy"]


def f1_of(precision: Column, recall: Column) -> Column:
    return div0(2 * precision * recall, precision + recall)


def metrics(df: DataFrame, keys: list, label: Column | str, hit: Column | str) -> DataFrame:
    counts = df.groupBy(*keys).agg(*[c.alias(n) for n, c in confusion(label, hit).items()])
    return counts.withColumns(metric_columns())


# ---- ranking metrics: counted distinct scores, never raw rows --------------

def counted(df: DataFrame, keys: list[str], score: str, label: str) -> DataFrame:
    return df.groupBy(*keys, F.col(score).cast("double").alias("score")).agg(
        total(F.col(label) == 1).alias("pos"), total(F.col(label) != 1).alias("neg"))


def curve_areas(df: DataFrame, keys: list[str], score: str, label: str) -> DataFrame:
    """roc_auc (ties averaged; 0.5 for one class) and pr_auc (average precision) per key."""
    return counted_areas(counted(df, keys, score, label), keys, df)


def counted_areas(c: DataFrame, keys: list[str], df: DataFrame) -> DataFrame:
    """The same from ``pos`` and ``neg`` of each distinct score; ``df`` are the rows that were counted."""
    if not fits_one_task(df, whole=not keys):
        c = stored(c, "counted-scores")  # sized, dealt and totalled
    s = add_running(slice_series(c, keys, ["score"], sized_by=df), {"cum_pos": F.col("pos"), "cum_neg": F.col("neg")}).done()
    totals = c.groupBy(*keys).agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    s = lookup_join(s, totals, keys, sized_by=df) if keys else with_scalars(s, totals)
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    tp, fp = F.col("p") - F.col("cum_pos") + pos, F.col("n") - F.col("cum_neg") + neg
    out = s.groupBy(*keys).agg(
        F.sum(pos * (F.col("cum_neg") - neg + 0.5 * neg)).alias("wins"),
        F.sum(pos * tp / (tp + fp)).alias("gain"),
        F.max("p").cast("double").alias("p"), F.max("n").cast("double").alias("n"))
    return areas_of(out, keys)


def areas_of(sums: DataFrame, keys: list[str] = []) -> DataFrame:
    """The areas from ``wins``, ``gain`` and the numbers of positives and negatives ``p`` and ``n``."""
    one = (F.col("p") == 0) | (F.col("n") == 0)
    return sums.select(*keys, F.when(one, 0.5).otherwise(F.try_divide("wins", F.col("p") * F.col("n"))).alias("roc_auc"),
                       F.when(one, div0("p", F.col("p") + F.col("n"))).otherwise(F.try_divide("gain", "p")).alias("pr_auc"))


def percent_rank_by_order(df: DataFrame, score: str, ident: str) -> DataFrame:
    """rank / n with ties ranked by row id: rows below the score plus the place among its ties.

    Rows without a score keep a null rank and do not count.
    """
    c = df.filter(F.col(score).isNotNull()).groupBy(score).agg(F.count(F.lit(1)).alias("__c"))
    below = running(c, [], [score], {"__cum": F.col("__c")}, sized_by=df)
    n = c.agg(F.sum("__c"))
    placed = ordinal(df, [score], [ident], rn="__tie")
    out = placed.join(below, score, "left")
    return out.withColumn("pct_rank", (F.col("__cum") - F.col("__c") + F.col("__tie")) / n.scalar()).drop("__c", "__cum", "__tie")


def cumulative_rank(df: DataFrame, score: str) -> DataFrame:
    """Share of rows with a score not above this one; null for rows without a score, which do not count."""
    c = df.filter(F.col(score).isNotNull()).groupBy(score).agg(F.count(F.lit(1)).alias("__c"))
    below = running(c, [], [score], {"__cum": F.col("__c")}, sized_by=df)
    n = c.agg(F.sum("__c"))
    return df.join(below.select(score, (F.col("__cum") / n.scalar()).alias("cume_rank")), score, "left")


# ---- threshold search: bucketed scores and suffix sums ---------------------

def sweep(df: DataFrame, score: str, label: str, candidates: DataFrame) -> DataFrame:
    """tp, fp, fn, tn at every threshold of a one-row array frame (ascending, a few hundred entries).

    Each counted score finds how many thresholds it reaches, by a join with the ranges between them; the thresholds' totals
    are then suffix sums over as many rows as there are thresholds, whatever the data size.
    """
    grid = candidates.toDF("c")
    if not fits_one_task(df, whole=True):
        grid = stored(grid, "thresholds")  # read twice
    ranges = grid.select(F.array_sort("c").alias("c")).select("c", F.posexplode("c").alias("i", "lo")).select(
        (F.col("i") + 1).alias("j"), "lo", F.get("c", F.col("i") + 1).alias("hi"))
    reached = (F.col("lo") <= F.col("score")) & (F.col("hi").isNull() | (F.col("score") < F.col("hi")))
    placed = counted(df, [], score, label).join(F.broadcast(ranges), reached, "left")
    hits = placed.groupBy(F.coalesce("j", F.lit(0)).alias("j")).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    points = grid.select(F.posexplode("c").alias("i", "threshold")).select((F.col("i") + 1).alias("j"), "threshold")
    none = F.lit(None).cast("double")
    rows = hits.select("j", none.alias("threshold"), "pos", "neg").unionByName(
        points.select("j", "threshold", F.lit(0).cast("long").alias("pos"), F.lit(0).cast("long").alias("neg")))
    per = rows.groupBy("j").agg(F.max("threshold").alias("threshold"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    down = Window.orderBy(F.col("j").desc())
    whole = Window.orderBy(F.col("j").desc()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = per.select("j", "threshold", F.sum("pos").over(down).alias("tp"), F.sum("neg").over(down).alias("fp"),
                     F.sum("pos").over(whole).alias("p"), F.sum("neg").over(whole).alias("n"))
    return out.filter("threshold is not null").select(
        F.col("j").alias("step"), "threshold", "tp", "fp", (F.col("p") - F.col("tp")).alias("fn"), (F.col("n") - F.col("fp")).alias("tn"))


def quantile_grid(df: DataFrame, score: str, points: int = 300, lo: float = 0.5, hi: float = 0.999) -> DataFrame:
    """One row with the distinct score quantiles between two levels."""
    ps = [lo + j * ((hi - lo) / (points - 1)) for j in range(points)]
    return many_percentiles(df, score, ps).select(F.array_sort(F.array_distinct("q")).alias("c"))


def f1_threshold(df: DataFrame, score: str, label: str, points: int = 300) -> DataFrame:
    """The lowest candidate of largest F1; without positives mean + 3·std and F1 0."""
    s = sweep(df, score, label, quantile_grid(df, score, points))
    s = s.withColumns(metric_columns())
    best = s.agg(F.min_by(F.struct("threshold", "f1"), F.struct((-F.col("f1")).alias("a"), F.col("threshold").alias("b"))).alias("b"))
    plain = df.agg(F.sum((F.col(label) == 1).cast("long")).alias("p"), (F.avg(score) + 3 * F.stddev_pop(score)).alias("sigma"))
    out = with_scalars(plain, best.select("b.*"))
    found = F.col("p") > 0
    return out.select(F.when(found, F.col("threshold")).otherwise(F.col("sigma")).alias("threshold"), F.when(found, F.col("f1")).otherwise(0.0).alias("f1"))


def linear_grid(ends: DataFrame, points: int) -> DataFrame:
    """One row with ``points`` evenly spaced values between the columns lo and hi of a one-row frame."""
    step = (F.col("hi") - F.col("lo")) / (points - 1)
    return ends.select(F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.col("lo") + i * step).alias("c"))


def cost_curve(df: DataFrame, score: str, label: str, points: int = 300, fn_cost: float = 5.0) -> DataFrame:
    top = percentiles(df, [], {"hi": (score, 0.99)})
    ends = with_scalars(df.agg(F.min(score).alias("lo")), top)
    s = sweep(df, score, label, linear_grid(ends, points)).withColumns(metric_columns())
    n = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    return s.withColumn("cost", (fn_cost * F.col("fn") + F.col("fp")) / n)


def sensitivity(df: DataFrame, score: str, label: str, base: float, points: int = 41, span: float = 0.5) -> DataFrame:
    """F1 and FPR around an operating point, with central-difference slopes per percent of threshold."""
    grid = [base * ((1 - span) + i * (2 * span / (points - 1))) for i in range(points)]
    one = df.sparkSession.range(1).select(F.array(*[F.lit(float(g)) for g in grid]).alias("c"))
    s = sweep(df, score, label, one).withColumns(metric_columns())
    w = Window.orderBy("step")  # as many rows as grid points
    pct = (F.col("threshold") - base) / base * 100
    out = s.withColumn("pct", pct)

    def slope(c: str) -> Column:
        return F.try_divide(F.lead(c).over(w) - F.lag(c).over(w), F.lead("pct").over(w) - F.lag("pct").over(w))

    return out.withColumns({"f1_slope": slope("f1"), "fpr_slope": slope("fpr")})


# ---- paired tests, resampling ----------------------------------------------

def mcnemar(df: DataFrame, label: Column | str, hit_a: Column | str, hit_b: Column | str) -> DataFrame:
    yes = cond(label) == 1
    a, b = cond(hit_a) == yes, cond(hit_b) == yes
    out = df.agg(total(a & ~b).alias("b01"), total(~a & b).alias("b10"))
    n, gap = F.col("b01") + F.col("b10"), F.abs(F.col("b01") - F.col("b10")) - 1
    return out.withColumns({
        "statistic": F.when(n == 0, 0.0).otherwise(F.try_divide((gap * gap).cast("double"), n.cast("double"))),
        "odds_ratio": F.when(n == 0, 1.0).otherwise((F.col("b01") + 0.5) / (F.col("b10") + 0.5))})


def cohens_d(df: DataFrame, a: str, b: str) -> DataFrame:
    diff = F.col(a) - F.col(b)
    return df.agg(F.avg(diff).alias("mean_diff"), div0(F.avg(diff), F.stddev_samp(diff)).alias("cohens_d"))


def bootstrap_ci(df: DataFrame, label: Column | str, hit: Column | str, n_boot: int = 1000, seed: int = 0, alpha: float = 0.05) -> DataFrame:
    """Percentile intervals of the count metrics.

    Resampling rows with replacement draws the four confusion cells from a multinomial, so the replicates
    work on four numbers instead of on the rows.
    """
    cells = df.agg(*[c.alias(n) for n, c in confusion(label, hit).items()])
    reps = with_scalars(df.sparkSession.range(n_boot).withColumnRenamed("id", "replicate"), cells)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for rep, *counts in b[["replicate", "tp", "fp", "fn", "tn"]].itertuples(index=False):
                counts = np.asarray(counts, dtype=np.int64)
                n = int(counts.sum())
                drawn = np.random.default_rng([seed, int(rep)]).multinomial(n, counts / n) if n else counts
                rows.append((int(rep), *[int(x) for x in drawn]))
            yield pd.DataFrame(rows, columns=["replicate", "tp", "fp", "fn", "tn"])

    drawn = reps.mapInPandas(draw, "replicate long, tp long, fp long, fn long, tn long").withColumns(metric_columns())
    long = drawn.select(*METRICS).unpivot([], METRICS, "metric", "value")
    bounds = percentiles(long, ["metric"], {"lo": ("value", alpha / 2), "hi": ("value", 1 - alpha / 2)})
    point = cells.withColumns(metric_columns()).select(*METRICS).unpivot([], METRICS, "metric", "point")
    return point.join(bounds, "metric")


# chances of at most 0, 1, 2 ... events of a Poisson count with mean 1
POISSON_ONE = [math.exp(-1) * sum(1 / math.factorial(k) for k in range(n + 1)) for n in range(9)]


def bootstrap_weight(ident: Column, replicate: Column) -> Column:
    """How often a row stands in a replicate: a Poisson count with mean 1, from its id alone.

    A square between two integer mixes keeps the replicates of a row apart.
    """
    x = (ident.cast("long") % MIX_MODULUS * (F.lit(mix_factor(0)) + replicate * 209_458) + replicate * 104_729 + 104_729) % MIX_MODULUS
    u = ((x * x + ident.cast("long") % MIX_MODULUS) % MIX_MODULUS * F.lit(mix_factor(3)) + 7_919) % MIX_MODULUS
    return sum(((u >= math.ceil(p * MIX_MODULUS)).cast("int") for p in POISSON_ONE), F.lit(0))


def below_modulus(x: np.ndarray) -> np.ndarray:
    """x % MIX_MODULUS with the sign of x; the modulus is 2 ** 31 - 1, so folding the high bits twice does for x >= 0."""
    if len(x) and x.min() < 0:
        return np.fmod(x, MIX_MODULUS)
    x = (x & MIX_MODULUS) + (x >> 31)
    x = (x & MIX_MODULUS) + (x >> 31)
    return np.where(x >= MIX_MODULUS, x - MIX_MODULUS, x)


def bootstrap_counts(ident: np.ndarray, replicate: int) -> np.ndarray:
    """``bootstrap_weight`` of whole numbers below MIX_MODULUS."""
    x = below_modulus(ident * (mix_factor(0) + replicate * 209_458) + (replicate * 104_729 + 104_729))
    u = below_modulus(below_modulus(x * x + ident) * mix_factor(3) + 7_919)
    out = np.zeros(len(u), np.uint8)
    for p in POISSON_ONE:
        out += u >= math.ceil(p * MIX_MODULUS)
    return out


BOOT_ROWS, BOOT_TASKS = 1 << 15, 512


class BootSlice:
    """Neighbouring rows along the scores, and what a replicate draws of them for each distinct score."""

    def __init__(self, pdf: pd.DataFrame):
        pdf = pdf.sort_values("score")
        self.scores = pdf["score"].to_numpy()
        self.ident = below_modulus(pdf["id"].to_numpy(np.int64))
        self.ends = np.flatnonzero(np.r_[self.scores[1:] != self.scores[:-1], True])
        # one running sum for both classes: positives in the low half, negatives in the high half
        self.unit = np.select([pdf["sign"] == 1, pdf["sign"] == -1], [np.int64(1), np.int64(1) << 32], np.int64(0))

    def drawn(self, replicate: int) -> tuple[np.ndarray, np.ndarray, bool]:
        """Positives and negatives up to the end of each distinct score, 0 in front; whether any row was drawn."""
        w = bootstrap_counts(self.ident, replicate)
        cum = np.r_[0, np.cumsum(w * self.unit)[self.ends]]
        return cum & 0xFFFFFFFF, cum >> 32, bool(w.any())


def bootstrap_areas(df: DataFrame, score: str, label: str, ident: str, n_boot: int = 1000, alpha: float = 0.05, slice_rows: int = BOOT_ROWS) -> DataFrame:
    """(metric, point, lo, hi) for roc_auc and pr_auc: percentile intervals over Poisson bootstrap replicates.

    Rows are dealt once to slices along the scores; a draw is made where its row lies and is never written down. A first pass counts,
    per slice and replicate, the first and last distinct score and what lies between, which gives every slice the counts below it and the
    whole counts of scores that reach over its ends. A second pass adds up each slice's part of the areas. Rows without an id or score
    are left out.
    """
    rows = df.select(F.col(score).cast("double").alias("score"), F.col(label).alias("label"), F.col(ident).alias("id")).dropna(subset=["score", "id"])
    sign = F.when(F.col("label") == 1, 1).when(F.col("label") != 1, -1).otherwise(0)
    ready = stored(rows.select((F.col("score") + 0.0).alias("score"), F.col("id").cast("long").alias("id"), sign.alias("sign")), "bootstrap-rows")
    n_slices = max(1, -(-ready.count() // slice_rows))
    cut = ready.repartitionByRange(n_slices, "score", "id").withColumn("slice", F.spark_partition_id())
    # the ranges come from samples: both passes must see the same ones; few bytes are much work here, so tasks are not merged by size
    slices = stored(cut, "bootstrap-slices").repartition(min(n_slices, BOOT_TASKS), "slice")

    def edges(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        own, out = BootSlice(pdf), []
        first, last, n = own.scores[0], own.scores[-1], len(own.ends)
        for b in range(n_boot):
            pos, neg, some = own.drawn(b)
            out.append((b, 0, first, pos[1], neg[1], some))
            if n > 1:
                out.append((b, 1, None, pos[-2] - pos[1], neg[-2] - neg[1], some))
                out.append((b, 2, last, pos[-1] - pos[-2], neg[-1] - neg[-2], some))
        return pd.DataFrame(out, columns=["replicate", "part", "score", "pos", "neg", "some"]).assign(slice=key[0])

    parts = slices.groupBy("slice").applyInPandas(edges, "slice int, replicate int, part int, score double, pos long, neg long, some boolean")
    parts = stored(parts, "bootstrap-edges")  # three rows per slice and replicate
    every, same = Window.partitionBy("replicate"), Window.partitionBy("replicate", "score")
    earlier = every.orderBy("slice", "part").rowsBetween(Window.unboundedPreceding, -1)
    before = parts.withColumns({f"before_{c}": F.coalesce(F.sum(c).over(earlier), F.lit(0)) for c in ("pos", "neg")})
    before = before.withColumns({"group_pos": F.min("before_pos").over(same), "group_neg": F.min("before_neg").over(same), "group": F.sum("neg").over(same),
                                 "p": F.sum("pos").over(every), "n": F.sum("neg").over(every)})
    at = lambda part, c: F.max(F.when(F.col("part") == part, F.col(c)))
    starts = before.groupBy("slice", "replicate").agg(
        at(0, "before_pos").alias("start_pos"), at(0, "before_neg").alias("start_neg"), at(0, "group_pos").alias("first_pos"), at(0, "group_neg").alias("first_neg"),
        at(0, "group").alias("first"), F.coalesce(at(2, "group"), at(0, "group")).alias("last"), F.max("p").alias("p"), F.max("n").alias("n"), F.max("some").alias("some"))

    def part_areas(pdf: pd.DataFrame, around: pd.DataFrame) -> pd.DataFrame:
        own, out = BootSlice(pdf), []
        for a in around.itertuples(index=False):
            pos, neg, _ = own.drawn(a.replicate)
            below_pos, below_neg, group = a.start_pos + pos[:-1], a.start_neg + neg[:-1], np.diff(neg)
            below_pos[0], below_neg[0], group[0] = a.first_pos, a.first_neg, a.first
            group[-1] = a.last
            up = a.p - below_pos
            here = np.diff(pos)
            wins = (here * (below_neg + 0.5 * group)).sum()
            gain = (here * (up / np.maximum(up + a.n - below_neg, 1))).sum()
            out.append((a.replicate, wins, gain, a.p, a.n, a.some))
        return pd.DataFrame(out, columns=["replicate", "wins", "gain", "p", "n", "some"])

    schema = "replicate int, wins double, gain double, p double, n double, some boolean"
    found = slices.groupBy("slice").cogroup(starts.groupBy("slice")).applyInPandas(part_areas, schema)
    summed = found.groupBy("replicate").agg(F.sum("wins").alias("wins"), F.sum("gain").alias("gain"), F.max("p").alias("p"), F.max("n").alias("n"), F.max("some").alias("some"))
    long = areas_of(summed.filter("some")).unpivot([], ["roc_auc", "pr_auc"], "metric", "value")
    bounds = percentiles(long, ["metric"], {"lo": ("value", alpha / 2), "hi": ("value", 1 - alpha / 2)})
    point = curve_areas(ready.withColumn("label", F.when(F.col("sign") != 0, F.col("sign"))), [], "score", "label").unpivot([], ["roc_auc", "pr_auc"], "metric", "point")
    return point.join(bounds, "metric")


# ---- calibration -----------------------------------------------------------

def reliability_bins(df: DataFrame, keys: list[str], prob: str, label: str, bins: int = 15) -> DataFrame:
    b = F.least(F.floor(F.col(prob) * bins), F.lit(bins - 1)).cast("int")
    return df.groupBy(*keys, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(prob).alias("confidence"), F.avg(label).alias("accuracy"))


def calibration_error(df: DataFrame, keys: list[str], prob: str, label: str, bins: int = 15, least: int = 10) -> DataFrame:
    """ECE, MCE, MCE over bins of at least ``least`` rows, and Brier score."""
    sums = df.withColumn("__sq", F.pow(F.col(prob) - F.col(label), 2))
    b = F.least(F.floor(F.col(prob) * bins), F.lit(bins - 1)).cast("int")
    rel = sums.groupBy(*keys, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(prob).alias("confidence"),
                                                  F.avg(label).alias("accuracy"), F.sum("__sq").alias("sq"))
    gap = F.abs(F.col("accuracy") - F.col("confidence"))
    return rel.groupBy(*keys).agg(
        (F.sum(F.col("n") * gap) / F.sum("n")).alias("ece"), F.max(gap).alias("mce"),
        F.max(F.when(F.col("n") >= least, gap)).alias("mce_robust"), (F.sum("sq") / F.sum("n")).alias("brier"))


def mean_calibration_error(df: DataFrame, prob: str, label: str, bins: int = 15) -> DataFrame:
    """Mean distance of the bin frequency from the bin midpoint; the last bin is open, so 1.0 drops out."""
    b = F.floor(F.col(prob) * bins).cast("int")
    rel = df.filter(F.col(prob) < 1.0).groupBy(b.alias("bin")).agg(F.avg(label).alias("freq"))
    return rel.agg(F.avg(F.abs(F.col("freq") - (F.col("bin") + 0.5) / bins)).alias("mean_error"), F.count(F.lit(1)).alias("bins"))


def platt(score: Column, a: float, b: float) -> Column:
    return sigmoid(a * score + b)


def temperature_grid(df: DataFrame, score: str, label: str, points: int = 200, lo: float = 0.05, hi: float = 5.0) -> DataFrame:
    """Mean negative log likelihood of sigmoid(z / T) for every T of the grid, from counted scores."""
    c = counted(df, [], score, label)
    stats = df.agg(F.avg(score).alias("mean"), F.greatest(F.stddev_pop(score), F.lit(1e-9)).alias("std"))
    step = (hi - lo) / (points - 1)
    grid = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.lit(lo) + i * F.lit(step))
    rows = with_scalars(c, stats).withColumn("T", F.explode(grid))
    p = sigmoid((F.col("score") - F.col("mean")) / F.col("std") / F.col("T"))
    nll = -(F.col("pos") * F.log(p + 1e-12) + F.col("neg") * F.log(1 - p + 1e-12))
    return rows.groupBy("T").agg((F.sum(nll) / F.sum(F.col("pos") + F.col("neg"))).alias("nll"))


# ---- studies ---------------------------------------------------------------

def score_overlap(df: DataFrame, score: str, label: str) -> DataFrame:
    """Percent of the joint score range in which both classes occur."""
    n, a = F.when(F.col(label) == 0, F.col(score)), F.when(F.col(label) == 1, F.col(score))
    over = (F.least(F.max(n), F.max(a)) - F.greatest(F.min(n), F.min(a))) / (F.max(a) - F.min(n) + 1e-12)
    return df.agg(F.greatest(100 * over, F.lit(0.0)).alias("overlap_pct"))


def learning_curve(df: DataFrame, label: Column | str, hit: Column | str, ident: str, fractions: list[float], seed: int = 7) -> DataFrame:
    """Metrics on growing id-hashed shares of the rows: counted once per share, then summed up."""
    u = mix_uniform(ident, seed)
    share = F.lit(fractions[-1])
    for f in reversed(fractions[:-1]):
        share = F.when(u < f, F.lit(f)).otherwise(share)
    parts = df.groupBy(share.alias("fraction")).agg(*[c.alias(n) for n, c in confusion(label, hit).items()])
    w = Window.orderBy("fraction")  # one row per fraction
    grown = parts.select("fraction", *[F.sum(c).over(w).alias(c) for c in ("tp", "fp", "fn", "tn")])
    return grown.withColumns(metric_columns())


def meter_generalisation(df: DataFrame, label: Column | str, hit: Column | str, seen_share: float = 0.8) -> DataFrame:
    """Metrics on the first meters by id (seen) and the rest (held out)."""
    dim = ordinal(df.select("meter_id").distinct(), [], ["meter_id"], rn="__rn", n="__all")
    dim = dim.select("meter_id", F.when(F.col("__rn") <= F.floor(F.col("__all") * seen_share), "seen").otherwise("held_out").alias("part"))
    return metrics(lookup_join(df, dim, ["meter_id"]), ["part"], label, hit)


def detection_latency(df: DataFrame, hit: Column | str) -> DataFrame:
    """Per alert burst: was it detected, and after how many readings."""
    rows = df.withColumn("__hit", cond(hit))
    runs = islands(rows, METER, ORDER, lambda w: F.col("is_alert") != F.lag("is_alert").over(w))
    placed = ordinal(runs, METER, ORDER, rn="__rn").filter("is_alert = 1")
    out = placed.groupBy(*METER, "island").agg(
        F.min("__rn").alias("first"), F.count(F.lit(1)).alias("burst_rows"), F.min(F.when(F.col("__hit"), F.col("__rn"))).alias("seen"),
        F.min("event_id").alias("first_id"))
    return out.select("first_id", *METER, "burst_rows", F.col("seen").isNotNull().alias("detected"),
                      F.coalesce(F.col("seen") - F.col("first"), F.lit(-1)).alias("latency"))


def feature_auc(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    """Separability of each single feature, max(auc, 1 - auc), best first."""
    long = df.select(label, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot([label], columns, "feature", "value")
    areas = curve_areas(long, ["feature"], "value", label)
    return areas.select("feature", F.greatest(F.col("roc_auc"), 1 - F.col("roc_auc")).alias("auc")).orderBy(F.desc("auc"))


def champion_fold(versions: DataFrame, family: str, order: str, value: str, delta: float) -> DataFrame:
    """Status of each version of a model family at its registration.

    A version becomes champion if it is within ``delta`` of the champion before it, which is then retired. The versions of one
    family are few (registrations, not readings), so they fold inside one array.
    """
    state = F.struct(F.lit(None).cast("double").alias("best"), F.array().cast(f"array<struct<{order}:string,{value}:double,status:string>>").alias("log"))

    def step(acc: Column, v: Column) -> Column:
        wins = acc["best"].isNull() | (v["v"] >= acc["best"] - delta)
        entry = F.struct(v["o"].cast("string").alias(order), v["v"].alias(value), F.when(wins, "champion").otherwise("rolled_back").alias("status"))
        return F.struct(F.when(wins, v["v"]).otherwise(acc["best"]).alias("best"), F.array_append(acc["log"], entry).alias("log"))

    listed = versions.groupBy(family).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v")))).alias("vs"))
    log = listed.select(family, F.inline(F.aggregate("vs", state, step, lambda acc: acc["log"])))
    last = F.max(F.when(F.col("status") == "champion", F.col(order))).over(Window.partitionBy(family))
    return log.withColumn("status", F.when((F.col("status") == "champion") & (F.col(order) < last), "retired").otherwise(F.col("status")))


def permute_column(df: DataFrame, column: str, ident: str, seed: int) -> DataFrame:
    """Deal the values of a column out again in another id-hashed order."""
    a = ordinal(df.withColumn("__u", mix_uniform(ident, seed)), [], ["__u", ident], rn="__rn").drop("__u")
    b = ordinal(df.select(ident, F.col(column).alias("__v")).withColumn("__u", mix_uniform(ident, seed + 1)), [], ["__u", ident], rn="__rn")
    return a.join(b.select("__rn", "__v"), "__rn").withColumn(column, F.col("__v")).drop("__rn", "__v")
