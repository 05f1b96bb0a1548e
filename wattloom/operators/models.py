"""Learned scores: segmented isolation forest, linear autoencoder, calibrators, supervised models."""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from . import trees
from .detect import domain_rules
from .evaluate import counted, curve_areas
from .lookup import lookup_join, stored
from .quantiles import percentiles
from .series import carry_forward, over_series, running

# ---- segmented isolation forest --------------------------------------------

SAMPLE, TREES, MIN_SEGMENT, CONTAMINATION, SLICE_ROWS = 256, 100, 10, 0.1, 1 << 18
TREE_SCHEMA = "segment string, tree int, size int, feature array<int>, threshold array<double>, left array<int>, right array<int>, depth array<double>"


def average_path(n: float) -> float:
    """Mean depth of an unsuccessful search among n points."""
    if n <= 1:
        return 0.0
    return 2.0 * (np.log(n - 1) + 0.5772156649) - 2.0 * (n - 1) / n if n > 2 else 1.0


def grow_tree(x: np.ndarray, rng: np.random.Generator) -> dict[str, list]:
    """Random splits down to single points or the mean depth of the sample; leaves carry their path length."""
    limit = int(np.ceil(np.log2(max(len(x), 2))))
    tree: dict[str, list] = {k: [] for k in ("feature", "threshold", "left", "right", "depth")}

    def node(rows: np.ndarray, level: int) -> int:
        at = len(tree["feature"])
        for k, v in zip(tree, (-1, 0.0, -1, -1, level + average_path(len(rows)))):
            tree[k].append(v)
        part = x[rows]
        varied = np.flatnonzero(part.max(axis=0) > part.min(axis=0)) if len(rows) > 1 else []
        if level < limit and len(varied):
            f = int(rng.choice(varied))
            cut = float(rng.uniform(part[:, f].min(), part[:, f].max()))
            low = part[:, f] < cut
            if low.any() and not low.all():
                tree["feature"][at], tree["threshold"][at] = f, cut
                tree["left"][at] = node(rows[low], level + 1)
                tree["right"][at] = node(rows[~low], level + 1)
        return at

    node(np.arange(len(x)), 0)
    return tree


def segment(df: DataFrame) -> DataFrame:
    return df.withColumn("segment", F.concat_ws("_", "zone", "type"))


def tree_samples(df: DataFrame, features: list[str], ident: str, trees: int = TREES) -> DataFrame:
    """``SAMPLE`` rows per segment and tree (all rows of a smaller segment): those with the lowest hash of row id and tree.

    A first hash keeps only the rows any tree could need, and a second one about twice the sample for each tree: fewer than
    ``SAMPLE`` of an expected 512 would be 11 standard deviations off.
    """
    sizes = df.groupBy("segment").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= MIN_SEGMENT)
    table = sizes.agg(F.map_from_entries(F.collect_list(F.struct("segment", "n"))))
    rows = df.withColumn("__n", F.try_element_at(table.scalar(), F.col("segment"))).filter("__n is not null")
    share = F.least(F.lit(1.0), F.lit(2.0 * SAMPLE) / F.col("__n"))
    any_tree = F.least(F.lit(1.0), share * trees)

    def u(*parts) -> Column:
        return (F.xxhash64(*parts).bitwiseAND(F.lit((1 << 52) - 1))).cast("double") / float(1 << 52)

    pool = rows.filter(u(F.col(ident), F.lit("pool")) < any_tree)
    picked = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: u(F.col(ident), t) < share / any_tree)
    dealt = pool.select("segment", ident, *features, F.explode(picked).alias("tree"))
    w = Window.partitionBy("segment", "tree").orderBy(F.xxhash64(ident, "tree"), ident)
    return dealt.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= SAMPLE).drop("__r")


def fit_forest(df: DataFrame, features: list[str], ident: str = "event_id", trees: int = TREES, seed: int = 42) -> DataFrame:
    """One row per segment and tree. Splits lie uniformly in a feature's range, so scaling would change nothing."""

    def build(key, pdf: pd.DataFrame) -> pd.DataFrame:
        name, t = key
        x = pdf.sort_values(ident)[features].to_numpy(dtype=float)
        tree = grow_tree(x, np.random.default_rng([seed, int(t)]))
        return pd.DataFrame([{"segment": name, "tree": int(t), "size": len(x), **tree}])

    return tree_samples(df, features, ident, trees).groupBy("segment", "tree").applyInPandas(build, TREE_SCHEMA)


def path_lengths(x: np.ndarray, forest: list[tuple]) -> np.ndarray:
    total = np.zeros(len(x))
    every = np.arange(len(x))
    for feature, threshold, left, right, depth in forest:
        at = np.zeros(len(x), dtype=np.int64)
        while True:
            inner = feature[at] >= 0
            if not inner.any():
                break
            go_left = x[every, np.maximum(feature[at], 0)] < threshold[at]
            at = np.where(inner, np.where(go_left, left[at], right[at]), at)
        total += depth[at]
    return total / len(forest)


def score_forest(df: DataFrame, forest: DataFrame, features: list[str], ident: str = "event_id") -> DataFrame:
    """Anomaly score per row (larger is stranger); rows of unknown segments score 0.

    The forest stays a table: rows are dealt by segment, large segments in slices, and every slice gets its segment's trees
    first. A task holds the trees of one segment and one batch of rows, however many segments there are.
    """
    sizes = stored(df.groupBy("segment").agg(F.ceil(F.count(F.lit(1)) / F.lit(SLICE_ROWS)).cast("int").alias("n_slices")), "segments")
    models = forest.join(sizes, "segment").withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("n_slices") - 1))).drop("n_slices")
    rows = df.select(F.col(ident).alias("ident"), "segment", F.array(*[F.col(c).cast("double") for c in features]).alias("x"))
    cut = rows.join(sizes, "segment").withColumn("slice", F.pmod(F.xxhash64("ident"), "n_slices").cast("int")).drop("n_slices")
    both = models.withColumn("is_row", F.lit(0)).unionByName(cut.withColumn("is_row", F.lit(1)), allowMissingColumns=True)
    dealt = both.repartition("segment", "slice").sortWithinPartitions("segment", "slice", "is_row", "tree")
    parts = ("feature", "threshold", "left", "right", "depth")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, trees, norm = None, [], 0.0
        for pdf in batches:
            for (name, cell), some in pdf.groupby(["segment", "slice"], sort=False):
                if (name, cell) != key:
                    key, trees, norm = (name, cell), [], 0.0
                grown = some[some["is_row"] == 0]
                trees += [tuple(np.asarray(tree) for tree in row) for row in zip(*[grown[c] for c in parts])]
                if len(grown):  # mean path in a sample of the segment's real size
                    norm = max(average_path(int(grown["size"].iloc[-1])), 1e-9)
                own = some[some["is_row"] == 1]
                if len(own):
                    score = 2.0 ** (-path_lengths(np.stack(own["x"].to_list()), trees) / norm) if trees else np.zeros(len(own))
                    yield pd.DataFrame({ident: own["ident"].astype("int64"), "forest_score": score})

    return dealt.mapInPandas(run, f"{ident} long, forest_score double")


def segmented_detection(df: DataFrame, features: list[str], trees: int = TREES) -> DataFrame:
    """Forest alarm (top share of its segment) together with the domain rules."""
    df = segment(df)
    # the fitted forest is stored once: its trees are read by the check, the scoring and any retry
    forest = stored(fit_forest(df, features, trees=trees), "forest")
    # so are the scores: the cut-offs and the output read them, and they are the long part of the work
    scored = stored(df.join(score_forest(df, forest, features), "event_id"), "forest-scores")
    cuts = percentiles(scored.filter("forest_score > 0"), ["segment"], {"cut": ("forest_score", 1 - CONTAMINATION)})
    out = lookup_join(scored, cuts, ["segment"], "left", sized_by=df)
    alarm = F.coalesce(F.col("forest_score") > F.col("cut"), F.lit(False))
    rules = domain_rules(F.col("tension_v"), F.col("frequency_hz"), F.col("power_factor"))
    why = F.when(F.col("cut").isNull(), F.array(F.lit("Unknown segment"))).otherwise(
        F.concat(F.when(alarm, F.array(F.lit("ML_isolation"))).otherwise(F.array().cast("array<string>")), rules))
    return out.withColumn("anomalies_found", why).withColumn("is_anomaly", F.col("cut").isNotNull() & (F.size("anomalies_found") > 0))


# ---- linear autoencoder ----------------------------------------------------

def standardised(batch: pa.RecordBatch, cells: list[str], mean: list[float | None], scale: list[float]) -> np.ndarray:
    """One row per cell and one column per window; a cell without a value stands at its mean."""
    z = np.zeros((len(cells), batch.num_rows))
    for i, c in enumerate(cells):
        if mean[i] is not None:
            z[i] = (batch.column(c).fill_null(mean[i]).to_numpy(zero_copy_only=False) - mean[i]) / scale[i]
    if np.isnan(z).any():
        raise ValueError("a window holds a value that is not a number")
    return z


def pca_reconstruction(windows: DataFrame, cells: list[str], label: str, k: int) -> DataFrame:
    """Squared reconstruction error per cell of standardised windows, components fitted on normal ones.

    The components are orthonormal, so the error is what the projection leaves of the squared length. Tasks multiply whole
    batches of windows; their product matrices, as large as the number of cells squared, are added up by Spark.
    """
    windows = windows.withColumns({c: F.col(c).cast("double") for c in cells})
    normal = windows.filter(F.col(label) == 0).select(*cells)
    stats = normal.agg(*[F.avg(c) for c in cells], *[F.stddev_pop(c) for c in cells]).first()
    mean, scale = list(stats[:len(cells)]), [max(s or 0.0, 1e-8) for s in stats[len(cells):]]
    side = len(cells) + 1

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((side, side))
        for batch in batches:  # a last row of ones adds the sums of the cells and the number of windows
            z = np.vstack([standardised(batch, cells, mean, scale), np.ones(batch.num_rows)])
            total += z @ z.T
        yield pa.record_batch({"place": pa.array(range(side * side), pa.int32()), "v": total.ravel()})

    sums = normal.mapInArrow(products, "place int, v double").groupBy("place").agg(F.sum("v")).collect()
    gram = np.zeros(side * side)
    for place, v in sums:
        gram[place] = v
    gram = gram.reshape(side, side)
    n, total = gram[-1, -1], gram[:-1, -1]
    if n < 2:
        raise ValueError("components need two normal windows")
    covariance = (gram[:-1, :-1] - np.outer(total, total) / n) / (n - 1)
    components = np.linalg.svd(covariance)[0][:, :k]
    keep = [f for f in windows.schema if f.name not in cells]

    def errors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = standardised(batch, cells, mean, scale)
            error = ((z * z).sum(axis=0) - ((components.T @ z) ** 2).sum(axis=0)) / len(cells)
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in keep], pa.array(np.maximum(error, 0.0))], [*[f.name for f in keep], "recon_error"])

    return windows.mapInArrow(errors, StructType([*keep, StructField("recon_error", DoubleType())]))


def intrinsic_dimension(df: DataFrame, columns: list[str], share: float = 0.95) -> DataFrame:
    """Number of principal components that explain the share of the variance."""
    vec = VectorAssembler(inputCols=columns, outputCol="x").transform(df.select(*columns))
    ratios = PCA(k=len(columns), inputCol="x", outputCol="p").fit(vec).explainedVariance.toArray()
    need = int(np.searchsorted(np.cumsum(ratios), share) + 1)
    return df.sparkSession.range(1).select(F.lit(min(need, len(columns))).alias("intrinsic_dim"), F.lit(len(columns)).alias("n_features"))


# ---- calibrators, fitted on counted scores ---------------------------------

def platt_fit(df: DataFrame, score: str, label: str, log: bool = True, eps: float = 1e-6) -> DataFrame:
    """a, b of sigmoid(a·s + b) with smoothed targets, s = log(score + eps) or the score.

    Every distinct score gives two weighted rows, one per class, which carry the soft targets.
    """
    c = counted(df, [], score, label).withColumn("s", F.log(F.col("score") + eps) if log else F.col("score"))
    n = df.agg(F.count(F.lit(1)).cast("double"))
    rows = c.withColumn("__n", n.scalar())
    t_pos, t_neg = (F.col("__n") + 1) / (F.col("__n") + 2), 1 / (F.col("__n") + 2)
    one = F.col("pos") * t_pos + F.col("neg") * t_neg
    zero = F.col("pos") + F.col("neg") - one
    soft = rows.select("s", F.inline(F.array(F.struct(F.lit(1.0).alias("label"), one.alias("weight")), F.struct(F.lit(0.0).alias("label"), zero.alias("weight")))))
    data = VectorAssembler(inputCols=["s"], outputCol="features").transform(soft)
    model = LogisticRegression(regParam=0.0, weightCol="weight", maxIter=200, tol=1e-9).fit(data)
    return df.sparkSession.range(1).select(F.lit(float(model.coefficients[0])).alias("a"), F.lit(float(model.intercept)).alias("b"))


def lower_hull(points: Iterator[tuple[float, int, int]]) -> list[tuple[float, int, int]]:
    """The corners (score, x, y) of the lower convex hull of points with ascending x; the first point is the start."""
    hull: list[tuple[float, int, int]] = []
    for p in points:
        while len(hull) > 1 and (hull[-1][2] - hull[-2][2]) * (p[1] - hull[-1][1]) >= (p[2] - hull[-1][2]) * (hull[-1][1] - hull[-2][1]):
            hull.pop()
        hull.append(p)
    return hull


HULL_ROWS = 1 << 16


def hull_round(points: DataFrame) -> DataFrame:
    """Corners of the hull of each ``part``; only these can be corners of the whole hull."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("x")
        return pd.DataFrame(lower_hull(zip(pdf["score"], pdf["x"].tolist(), pdf["y"].tolist())), columns=["score", "x", "y"])

    return points.groupBy("part").applyInPandas(run, "score double, x long, y long")


def isotonic_fit(df: DataFrame, score: str, label: str) -> DataFrame:
    """Calibrated probability of every distinct score.

    The fit is the slope of the greatest convex minorant of the cumulative counts (rows, positives) along the scores. Parts of about
    ``HULL_ROWS`` neighbouring points give their own corners, which are dealt to fewer, larger stretches and reduced again until one part
    is left or nothing falls away; counts are whole numbers, so slopes do not depend on the parts. Rows without a score are left out.
    """
    c = counted(df.filter(F.col(score).isNotNull()), [], score, label)
    sums = running(c, [], ["score"], {"x": F.col("pos") + F.col("neg"), "y": F.col("pos")}, sized_by=df)
    points = stored(sums.select("score", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y")), "counted-scores")
    corners, n = points, points.count()
    while True:
        parts = max(1, -(-n // HULL_ROWS))
        start = points.sparkSession.createDataFrame([(None, 0, 0)], corners.schema)
        cut = corners.repartitionByRange(parts, "x").withColumn("part", F.spark_partition_id()) if parts > 1 else corners.unionByName(start).withColumn("part", F.lit(0))
        corners = stored(hull_round(cut), "hull")
        left = corners.count()
        if parts == 1 or left > 0.9 * n:
            break
        n = left
    if parts > 1:  # hardly any point falls away: the corners are nearly the result, one pass finishes them in constant memory beside it
        corners = stored(hull_round(corners.unionByName(start).withColumn("part", F.lit(0))), "hull")
    # every score has the slope of the hull's edge that ends at or after it: carried backwards along the scores
    edges = corners.select("x", "y", F.col("score").alias("__corner"))
    sloped = over_series(edges, [], ["x"], lambda w: {"slope": (F.col("y") - F.lag("y").over(w)) / (F.col("x") - F.lag("x").over(w))}, back=1, sized_by=df)
    marked = points.join(sloped.filter("slope is not null").select(F.col("__corner").alias("score"), "slope"), "score", "left").withColumn("__back", -F.col("x"))
    out = carry_forward(marked, [], ["__back"], {"probability": F.col("slope")}, sized_by=df)
    return out.select("score", F.greatest(F.lit(0.0), F.least("probability", F.lit(1.0))).alias("probability"))


# ---- supervised models -----------------------------------------------------

# the sizes of the surveyed models; the forest's trees have no bound of depth
FOREST_TREES, FOREST_DEPTH, ROUNDS, ROUND_DEPTH, RATE, BOOST_SAMPLE = 200, None, 300, 6, 0.1, 0.9


def supervised(train: DataFrame, test: DataFrame, features: list[str], label: str, ident: str = "event_id", forest_trees: int = FOREST_TREES,
               forest_depth: int | None = FOREST_DEPTH, rounds: int = ROUNDS, round_depth: int = ROUND_DEPTH, rate: float = RATE, sample: float = BOOST_SAMPLE,
               local_rows: int = trees.LOCAL_ROWS) -> DataFrame:
    """(model, id, label, probability) of the test rows, by a random forest and by boosted trees; classes weigh the same."""
    n, cuts = len(features), trees.quantile_cuts(train, features)
    fit, ready = (stored(trees.binned(df, features, cuts, ident, label), "binned") for df in (train, test))
    # the boosted trees grow in one task of their own as long as a task can hold the rows: beside the forest's tasks, and before them in the queue
    with ThreadPoolExecutor(1) as beside:
        boosting = beside.submit(inheritable_thread_target(train.sparkSession)(trees.fit_boosting), fit, n, rounds, round_depth, rate, sample, sample, local_rows=local_rows)
        forest = stored(trees.fit_forest(fit, n, forest_trees, forest_depth), "forest")
        boosted = boosting.result()
    scored = {"random_forest": trees.score_forest(ready, forest, n, ready.count(), forest_trees), "boosted_trees": trees.score_boosting(ready, *boosted)}
    out = [df.select(F.lit(name).alias("model"), F.col("ident").alias(ident), "label", "probability") for name, df in scored.items()]
    return out[0].unionByName(out[1])


def permutation_importance(df: DataFrame, columns: list[str], score, label: str, ident: str, permute) -> DataFrame:
    """Loss of AUC when one column is dealt out again at random; ``score`` maps a frame to a scored frame."""
    base = curve_areas(score(df), [], "score", label).select("roc_auc")
    parts = None
    for i, c in enumerate(columns):
        # dealt out once: the score's own statistics and the counts read it again
        dealt = stored(permute(df, c, ident, 100 + 2 * i), "dealt-column")
        one = curve_areas(score(dealt), [], "score", label).select(F.lit(c).alias("feature"), "roc_auc")
        parts = one if parts is None else parts.unionByName(one)
    return parts.select("feature", (base.scalar() - F.col("roc_auc")).alias("importance"))
