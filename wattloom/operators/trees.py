"""Histogram trees over binned columns: a random forest and gradient boosting whose jobs do not grow with the number of trees.

Columns are cut once at up to ``BINS - 2`` quantiles; a row is then one byte for each feature, 0 for missing values, which go left.

* Forest: every row draws how often it stands in each tree's bag from a hash of its id. One shuffle deals the draws to the trees, each
  grown by one task level by level from counted bins. A bag has as many draws as the table has rows, whatever its size. A task reads a level in
  chunks and holds the rows in a file without a name where they are many; beside the rows it keeps a few numbers for each node.
* Boosting: a round's tree is grown from sums of gradients by (node, feature, bin), taken of the lighter child of each pair and by subtraction of
  the other. Gradients are whole numbers (2 ** -20 units), so sums do not depend on how rows are dealt. Up to ``local_rows`` rows, one task holds the
  binned rows and runs all rounds; beyond that the tasks of one barrier stage hold them and exchange the sums, up to ``HELD_ROWS`` rows a task. Spark
  takes a second for each exchange, whatever its size, so a level of such a table takes that second at least. Where the number of tasks that run at the
  same time is not known, and beyond that bound, every level is one aggregate over all rows, and margins are stored every ``STORE_ROUNDS`` rounds. All
  give the same trees.
* Scoring deals packed rows to parts of the forest, where trees come in pieces and one is held at a time; sums of a batch come back packed.

Null labels count as negative, rows with a null id are rows like others, an empty table cannot be fitted (ValueError).
"""

from __future__ import annotations

import base64
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame, functions as F

from .lookup import stored

BINS, UNIT, STORE_ROUNDS = 256, float(1 << 20), 20
LOCAL_ROWS, PART_TREES, SLICE_ROWS, BOOST_CHUNK = 3 << 21, 8, 1 << 20, 1 << 15
HELD_ROWS = 1 << 22  # rows a task may hold beside others while boosting
CHUNK_ROWS, HELD_BYTES, PIECE_NODES = 1 << 17, 1 << 26, 1 << 18  # rows looked at together, bytes of a bag in memory, nodes stored together
LAMBDA, MIN_CHILD = 1.0, 1.0


def mixed(*parts: np.ndarray | int) -> np.ndarray:
    """64-bit hash of broadcast whole numbers."""
    out = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        for p in parts:
            out = (np.asarray(p).astype(np.uint64) + out) * np.uint64(0xBF58476D1CE4E5B9)
            out = (out ^ (out >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
            out = out ^ (out >> np.uint64(29))
    return out


def uniform(*parts: np.ndarray | int) -> np.ndarray:
    return (mixed(*parts) >> np.uint64(11)).astype(np.float64) / float(1 << 53)


# ---- binned rows -------------------------------------------------------------------------------------------------------


def quantile_cuts(df: DataFrame, features: list[str], bins: int = BINS) -> list[np.ndarray]:
    """Up to ``bins - 2`` distinct cuts for each feature, from one aggregate of mergeable sketches."""
    shares = [k / (bins - 1) for k in range(1, bins - 1)]
    value = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    row = df.agg(*[F.percentile_approx(value(c), shares, 20_000).alias(c) for c in features]).first()
    return [np.unique(np.array(row[c] or [], float)) for c in features]


def binned(df: DataFrame, features: list[str], cuts: list[np.ndarray], ident: str, label: str) -> DataFrame:
    """(ident, label, bins): one byte for each feature, 0 for null and NaN, else 1 and the number of cuts below the value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros((batch.num_rows, len(features)), np.uint8)
            for k, cut in enumerate(cuts):
                x = batch.column(2 + k).to_numpy(zero_copy_only=False).astype(float)
                out[:, k] = np.where(np.isnan(x), 0, np.searchsorted(cut, x, "left") + 1)
            flat = pa.FixedSizeBinaryArray.from_buffers(pa.binary(len(features)), batch.num_rows, [None, pa.py_buffer(out.tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), flat.cast(pa.binary())], names=["ident", "label", "bins"])

    rows = df.select(F.col(ident).cast("long").alias("ident"), F.coalesce(F.col(label).cast("int"), F.lit(0)).alias("label"), *[F.col(c).cast("double") for c in features])
    return rows.mapInArrow(run, "ident long, label int, bins binary")


def unpacked(column: pa.Array, n_features: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), n_features)


def numbers(column: pa.Array) -> np.ndarray:
    return column.fill_null(0).to_numpy(zero_copy_only=False)


# ---- random forest -------------------------------------------------------------------------------------------------------


def bag_cdf(rate: float) -> np.ndarray:
    """Chances that a row stands in a bag 0, 1, 2 ... times at most: a Poisson draw with mean ``rate``."""
    k = np.arange(1, 12)
    terms = np.exp(-rate) * np.r_[1.0, np.cumprod(rate / k)]
    return np.cumsum(terms)


def bags(rows: DataFrame, n_features: int, trees: int, rate: float, seed: int) -> DataFrame:
    """(tree, rows): what some rows add to each tree's bag, as ``packed_rows``. Every row is drawn for every tree, ``rate`` times on average."""
    cdf, step = bag_cdf(rate), int(16384 / rate)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, step) for b in batches for at in range(0, b.num_rows, step)):
            packed = packed_rows(numbers(batch.column(1)), unpacked(batch.column(2), n_features))
            ident, tree, out = numbers(batch.column(0)), [], []
            for t in range(trees):
                times = np.searchsorted(cdf, uniform(seed, t, ident), "right")
                some = np.flatnonzero(times)
                if len(some):
                    own = packed[some]
                    own.view(np.uint8)[:, 0] += (2 * times[some]).astype(np.uint8)
                    tree.append(t)
                    out.append(own.tobytes())
            if tree:
                yield pa.RecordBatch.from_arrays([pa.array(tree, pa.int32()), pa.array(out, pa.binary())], names=["tree", "rows"])

    return rows.mapInArrow(run, "tree int, rows binary")


class Bag:
    """The packed rows of one tree, in memory or, beyond ``HELD_BYTES``, in a file without a name."""

    def __init__(self) -> None:
        self.parts, self.held, self.file = [], 0, None

    def add(self, part: bytes) -> None:
        self.parts.append(part)
        self.held += len(part)
        if self.held > HELD_BYTES:
            self.file = self.file or tempfile.TemporaryFile()
            self.file.writelines(self.parts)
            self.parts, self.held = [], 0

    def rows(self, words: int) -> np.ndarray:
        if self.file is None:
            return np.frombuffer(bytearray().join(self.parts), np.uint64).reshape(-1, words)
        self.file.writelines(self.parts)
        self.file.flush()
        self.parts = []
        return np.memmap(self.file, np.uint64).reshape(-1, words)


LOW = (1 << 32) - 1  # two counts in one number: positives above, negatives below


def packed_rows(code: np.ndarray, bins: np.ndarray) -> np.ndarray:
    """One row of whole words each: a byte ``times * 2 + label``, the bins, and zeros up to the next word."""
    out = np.zeros((len(bins), row_words(bins.shape[1]) * 8), np.uint8)
    out[:, 0], out[:, 1: bins.shape[1] + 1] = code, bins
    return out.view(np.uint64)


def row_words(n_features: int) -> int:
    return n_features // 8 + 1


def best_cells(cell: np.ndarray, run: np.ndarray, weights: tuple[float, float]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(node, least weighted Gini of the two sides, bin after which to cut, what goes left) of the nodes that can be cut.

    ``cell`` is node * BINS + bin of the bins that occur, ascending; ``run`` has the counts up to and with each cell.
    """
    node = cell >> 8
    last = np.empty(len(cell), bool)
    last[-1:] = True
    np.not_equal(node[1:], node[:-1], out=last[:-1])
    ends = np.flatnonzero(last)
    size = np.diff(ends, prepend=-1)
    before = np.r_[0, run[ends[:-1]]]
    every = run[ends] - before
    can = size > 1
    size, before, every = size[can] - 1, before[can], every[can]
    inner = np.flatnonzero(~last)  # no cut after a node's last bin
    if not len(inner):
        return np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64)
    left = run[inner] - np.repeat(before, size)
    right = np.repeat(every, size) - left
    w0, w1 = weights
    a1, a0, b1, b0 = w1 * (left >> 32), w0 * (left & LOW), w1 * (right >> 32), w0 * (right & LOW)
    score = a1 * a0
    score /= a1 + a0
    a1, a0 = b1 * b0, b1 + b0
    a1 /= a0
    score += a1
    starts = np.cumsum(size) - size
    least = np.minimum.reduceat(score, starts)
    first = np.flatnonzero(score == np.repeat(least, size))
    own = np.searchsorted(starts, first, "right")
    first = first[np.flatnonzero(np.diff(own, prepend=0))]
    at = cell[inner[first]]
    return at >> 8, least, at & 255, left[first]


def cells_of(key: np.ndarray, code: np.ndarray, counts: np.ndarray, n_nodes: int) -> tuple[np.ndarray, np.ndarray]:
    """The (node, bin) cells that occur and the counts up to each; ``key`` is node * BINS + bin, ``counts`` what a row of each code adds."""
    if n_nodes * BINS <= 2 * len(key):  # few nodes: a cell for each bin; both counts in one float, exact up to 2 ** 26 draws
        sums = np.bincount(key, ((counts >> 32 << 26) | (counts & LOW)).astype(float)[code], n_nodes * BINS)
        cell = np.flatnonzero(sums)
        sums = sums[cell].astype(np.int64)
        return cell, np.cumsum((sums >> 26 << 32) | (sums & ((1 << 26) - 1)))
    # many small nodes: sorted together with the codes, which is faster than sorting places
    bits = max(int(len(counts) - 1).bit_length(), 1)
    kind = np.uint32 if (n_nodes * BINS) << bits <= 1 << 32 else np.uint64
    both = key.astype(kind)
    both <<= kind(bits)
    both |= code
    both.sort()
    cell = both >> kind(bits)
    ends = np.flatnonzero(np.r_[cell[1:] != cell[:-1], True])
    both &= kind((1 << bits) - 1)
    return cell[ends].astype(np.int64), np.cumsum(counts[both])[ends]


def best_cuts(key: np.ndarray, one: np.ndarray, zero: np.ndarray, n_nodes: int, weights: tuple[float, float]) -> tuple[np.ndarray, np.ndarray]:
    """For one feature: least weighted Gini of the two sides, and the bin after which to cut, by node (infinite where there is no cut).

    ``key`` is node * BINS + bin of each row, which counts as ``one`` positives and ``zero`` negatives.
    """
    counts, code = np.unique((one.astype(np.int64) << 32) | zero.astype(np.int64), return_inverse=True)
    best, cut = np.full(n_nodes, np.inf), np.zeros(n_nodes, np.int64)
    node, least, at, _ = best_cells(*cells_of(key, code.astype(np.uint8 if len(counts) <= 256 else np.uint32), counts, n_nodes), weights)
    best[node], cut[node] = least, at
    return best, cut


def level_cuts(piece: np.ndarray, sizes: np.ndarray, turn: np.ndarray, tried: int, counts: np.ndarray, weights: tuple[float, float]) -> tuple[np.ndarray, ...]:
    """(feature or -1, cut, what goes left) of nodes whose rows stand one after another in ``piece``.

    A node looks at its features in the order ``turn``, until ``tried`` of them can cut it; of equal cuts it takes the one of the least feature.
    """
    k, n_features = turn.shape
    best, feature, cut, left = np.full(k, np.inf), np.full(k, -1, np.int64), np.zeros(k, np.int64), np.zeros(k, np.int64)
    lacks = np.full(k, tried)
    some, at = np.arange(k), 0
    while len(some) and at < n_features:
        here = min(tried, n_features - at) if at == 0 else 1
        own = turn[some, at: at + here]
        node, least, cuts, lefts = best_of_turns(piece, sizes, some, own, counts, weights)
        by, j = node // here, node % here
        lacks[some] -= np.bincount(by, minlength=len(some))
        for turned in range(here):
            mine = j == turned
            n, s, f = some[by[mine]], least[mine], own[by[mine], turned]
            better = (s < best[n]) | ((s == best[n]) & (f < feature[n]))
            n = n[better]
            best[n], feature[n], cut[n], left[n] = s[better], f[better], cuts[mine][better], lefts[mine][better]
        at += here
        some = np.flatnonzero(lacks > 0)
    return feature, cut, left


def best_of_turns(piece: np.ndarray, sizes: np.ndarray, some: np.ndarray, turn: np.ndarray, counts: np.ndarray, weights: tuple[float, float]) -> tuple[np.ndarray, ...]:
    """``best_cells`` of the nodes ``some`` for each feature of theirs in ``turn``; a node's number there is place in ``some`` * turns + turn."""
    k, here = turn.shape
    width = piece.shape[1] * 8
    if len(sizes) == 1 and len(piece) > CHUNK_ROWS:  # the one node that is larger than a chunk: its cells are added up
        sums = np.zeros((here, BINS), np.int64)
        for a in range(0, len(piece), CHUNK_ROWS):
            part = np.asarray(piece[a: a + CHUNK_ROWS]).view(np.uint8)
            code = part[:, 0]
            for j in range(here):
                found = np.bincount(part[:, 1 + turn[0, j]], ((counts >> 32 << 26) | (counts & LOW)).astype(float)[code], BINS).astype(np.int64)
                sums[j] += (found >> 26 << 32) | (found & ((1 << 26) - 1))
        cell = np.flatnonzero(sums)
        return best_cells(cell, np.cumsum(sums.ravel()[cell]), weights)
    flat = piece.view(np.uint8).ravel()
    if k < len(sizes):
        wanted = np.zeros(len(sizes), bool)
        wanted[some] = True
        base = np.flatnonzero(np.repeat(wanted, sizes))
        sizes = sizes[some]
        base *= width
    else:
        base = np.arange(len(piece)) * width
    code = flat.take(base)
    keys = np.empty((here, len(base)), np.int64)
    node = np.repeat(np.arange(0, k * here * BINS, here * BINS), sizes)
    for j in range(here):
        np.add(node, flat.take(base + np.repeat(turn[:, j].astype(np.int64) + 1, sizes)), out=keys[j])
        if j:
            keys[j] += j * BINS
    return best_cells(*cells_of(keys.ravel(), np.tile(code, here) if here > 1 else code, counts, k * here), weights)


def chunked(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of nodes with ``CHUNK_ROWS`` rows at most together, or one larger node."""
    ends, a = np.cumsum(sizes), 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + CHUNK_ROWS, "right")))
        yield a, b
        a = b


def room(n: int, words: int) -> np.ndarray:
    """Space for packed rows: memory, or a file without a name beyond ``HELD_BYTES``."""
    if n * words * 8 <= HELD_BYTES:
        return np.empty((n, words), np.uint64)
    with tempfile.TemporaryFile() as f:
        f.truncate(n * words * 8)
        return np.memmap(f, np.uint64, shape=(n, words))


def grow_classifier(bins: np.ndarray, label: np.ndarray, times: np.ndarray, weights: tuple[float, float], tried: int, max_depth: int | None, seed: int) -> dict[str, np.ndarray]:
    """``grow_packed`` of rows that stand ``times`` times (127 at most) in the bag."""
    return grow_packed(packed_rows(times * 2 + label, bins), bins.shape[1], weights, tried, max_depth, seed)


def grow_packed(rows: np.ndarray, n_features: int, weights: tuple[float, float], tried: int, max_depth: int | None, seed: int) -> dict[str, np.ndarray]:
    """A tree grown until its leaves are pure or cannot be cut: feature (-1: leaf), cut (left if bin <= cut), left child (right is next), value.

    Every node looks at ``tried`` random features among those it can be cut by. The rows of a node stand one after another. A level of ``rows`` is
    read in chunks that fit the processor's cache, and the rows that are left are written in the order of the next nodes, over ``rows`` in the end.
    """
    most = max((int(rows[a: a + CHUNK_ROWS].view(np.uint8)[:, 0].max()) for a in range(0, len(rows), CHUNK_ROWS)), default=1)
    counts = np.arange(most + 1)
    counts = np.where(counts & 1, counts >> 1 << 32, counts >> 1)
    found = sum((np.bincount(np.asarray(rows[a: a + CHUNK_ROWS]).view(np.uint8)[:, 0], minlength=most + 1) for a in range(0, len(rows), CHUNK_ROWS)), np.zeros(most + 1, np.int64))
    mixed_counts = lambda c: ((c >> 32) > 0) & ((c & LOW) > 0)
    done: list[dict[str, np.ndarray]] = []
    count, sizes, place = np.array([int((found * counts).sum())]), np.array([len(rows)]), np.array([0])
    first, depth, spare = 0, 0, None
    while len(count):
        c1, c0 = count >> 32, count & LOW
        level = {"feature": np.full(len(count), -1, np.int16), "cut": np.zeros(len(count), np.uint8), "left": np.full(len(count), -1, np.int32),
                 "value": (weights[1] * c1 / (weights[1] * c1 + weights[0] * c0)).astype(np.float32)}
        done.append(level)
        if not depth and not mixed_counts(count).any():
            break
        deeper = max_depth is None or depth + 1 < max_depth
        if not len(sizes) or (max_depth is not None and depth >= max_depth):
            break
        if spare is None or len(spare) > 4 * sizes.sum():
            spare = room(int(sizes.sum()), rows.shape[1])
        feature, cut, left, kids = [], [], [], []
        start = end = 0
        for a, b in chunked(sizes):
            piece, own = rows[start: start + int(sizes[a:b].sum())], sizes[a:b]
            start += len(piece)
            turn = np.argsort(uniform(seed, (first + place[a:b])[:, None], np.arange(n_features)[None, :]), axis=1)
            f, c, go = level_cuts(piece, own, turn, tried, counts, weights)
            stay = count[place[a:b]] - go
            alive = [(f >= 0) & mixed_counts(x) if deeper else np.zeros(b - a, bool) for x in (go, stay)]
            moved = dealt_rows(piece, own, f, c, alive, spare, end)
            for side in (0, 1):
                some = np.flatnonzero(alive[side])
                kids.append((a + some, np.full(len(some), side), moved[side][some]))
                end += int(moved[side][some].sum())
            feature.append(f), cut.append(c), left.append(go)
        feature, cut, left = (np.concatenate(x) for x in (feature, cut, left))
        split = feature >= 0
        level["feature"][place[split]], level["cut"][place[split]] = feature[split], cut[split]
        inner = level["feature"] >= 0
        rank = np.cumsum(inner) - 1
        level["left"][inner] = first + len(count) + 2 * rank[inner]
        below = np.zeros(2 * int(inner.sum()), np.int64)
        at = 2 * rank[place[split]]
        below[at], below[at + 1] = left[split], count[place[split]] - left[split]
        parent, side, sizes = (np.concatenate(x) for x in zip(*kids))
        first, count, place, depth = first + len(count), below, 2 * rank[place[parent]] + side, depth + 1
        rows, spare = spare[:end], rows
    return {k: np.concatenate([level[k] for level in done]) for k in done[0]}


def dealt_rows(piece: np.ndarray, sizes: np.ndarray, feature: np.ndarray, cut: np.ndarray, alive: list[np.ndarray], out: np.ndarray, at: int) -> tuple[np.ndarray, np.ndarray]:
    """Writes what goes on from ``piece`` into ``out``, the rows of all living left children and then those of all right ones; rows by node and side."""
    width, total = piece.shape[1] * 8, []
    if len(sizes) == 1:  # it may be larger than a chunk
        parts = range(0, len(piece), CHUNK_ROWS)
        right = lambda part: part.view(np.uint8)[:, 1 + max(int(feature[0]), 0)] > cut[0]
        n_right = sum(int(np.count_nonzero(right(piece[a: a + CHUNK_ROWS]))) for a in parts)
        to = [at, at + (len(piece) - n_right) * bool(alive[0][0])]
        for part in (piece[a: a + CHUNK_ROWS] for a in parts):
            high = right(part)
            for side, own in enumerate((~high, high)):
                if alive[side][0]:
                    some = part[own]
                    out[to[side]: to[side] + len(some)] = some
                    to[side] += len(some)
        return np.array([len(piece) - n_right]), np.array([n_right])
    flat = piece.view(np.uint8).ravel()
    bin_at = np.repeat(np.maximum(feature, 0) + 1, sizes)
    bin_at += np.arange(0, len(piece) * width, width)
    high = flat.take(bin_at) > np.repeat(cut.astype(np.uint8), sizes)
    n_right = np.add.reduceat(high, np.cumsum(sizes) - sizes, dtype=np.int64)
    for own, live in ((~high, alive[0]), (high, alive[1])):
        own &= np.repeat(live, sizes)
        some = np.flatnonzero(own)
        np.take(piece, some, axis=0, out=out[at: at + len(some)])
        at += len(some)
    return sizes - n_right, n_right


TREE = "tree int, piece int, feature binary, cut binary, left binary, value binary"
KINDS = {"feature": np.int16, "cut": np.uint8, "left": np.int32, "value": np.float32}


def fit_forest(rows: DataFrame, n_features: int, trees: int, max_depth: int | None = None, seed: int = 42, bag_rows: int | None = None) -> DataFrame:
    """Packed arrays for each tree, ``PIECE_NODES`` nodes a row; classes weigh the same in sum over all of ``rows`` (ident, label, bins).

    A bag has as many draws as there are rows. Only who gives ``bag_rows`` gets smaller ones.
    """
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("pos")).first()
    if not total.n:
        raise ValueError("no rows to fit")
    weights = (total.n / (2 * max(total.n - total.pos, 1)), total.n / (2 * max(total.pos, 1)))
    rate, tried = min(1.0, (bag_rows or total.n) / total.n), max(1, int(np.sqrt(n_features)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Bag] = {}
        for batch in batches:
            for t, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held.setdefault(t, Bag()).add(part)
        for t in list(held):
            # the order of rows does not matter: all sums are counts
            model = grow_packed(held.pop(t).rows(row_words(n_features)), n_features, weights, tried, max_depth, int(mixed(seed, t) >> np.uint64(1)))
            for k, a in enumerate(range(0, len(model["feature"]), PIECE_NODES)):
                packed = [pa.array([model[c][a: a + PIECE_NODES].astype(kind).tobytes()], pa.binary()) for c, kind in KINDS.items()]
                yield pa.RecordBatch.from_arrays([pa.array([t], pa.int32()), pa.array([k], pa.int32()), *packed], names=["tree", "piece", *KINDS])

    return bags(rows, n_features, trees, rate, seed).repartitionById(trees, "tree").mapInArrow(run, TREE)


def walk(model: dict[str, np.ndarray], bins: np.ndarray) -> np.ndarray:
    """The value of the leaf each row ends in."""
    # left child, feature and cut in one number, negative for a leaf
    nodes = (model["left"].astype(np.int64) << 24) | (np.maximum(model["feature"], 0).astype(np.int64) << 8) | model["cut"]
    out, flat, width = np.empty(len(bins)), np.ascontiguousarray(bins).ravel(), bins.shape[1]
    for a in range(0, len(bins), CHUNK_ROWS):
        rows = np.arange(a, min(a + CHUNK_ROWS, len(bins)))
        base, at = rows * width, np.zeros(len(rows), np.int64)
        while len(rows):
            node = nodes[at]
            inner = node >= 0
            if not inner.all():
                out[rows[~inner]] = model["value"][at[~inner]]
                rows, base, node = rows[inner], base[inner], node[inner]
            at = (node >> 24) + (flat.take(base + ((node >> 8) & 0xFFFF)) > (node & 255))
    return out


def score_forest(rows: DataFrame, forest: DataFrame, n_features: int, n_rows: int, trees: int) -> DataFrame:
    """(ident, label, bins, probability): mean over all trees.

    Rows are packed, batch by batch, and dealt to ``PART_TREES`` trees at a time; a task holds the bins of about ``SLICE_ROWS`` rows and one tree.
    """
    parts, slices = -(-trees // PART_TREES), max(1, -(-n_rows // SLICE_ROWS))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                whole = pa.array([0, batch.num_rows], pa.int32())
                ident, label, bins = (batch.column(c) for c in ("ident", "label", "bins"))
                flat = pa.array([unpacked(bins, n_features).tobytes()], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(whole, ident), pa.ListArray.from_arrays(whole, label), flat], names=["ident", "label", "bins"])

    packed = rows.select(F.col("ident").cast("long"), F.col("label").cast("int"), "bins").mapInArrow(pack, "ident array<long>, label array<int>, bins binary")
    # stored, so that a batch keeps its number
    packed = stored(packed.withColumn("chunk", F.monotonically_increasing_id()), "packed-rows")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = packed.select("chunk", "bins", F.pmod(F.xxhash64("chunk"), F.lit(slices)).cast("int").alias("slice"), F.lit(-1).alias("tree")).withColumn("part", every(parts))
    models = forest.withColumn("part", F.col("tree") % parts).withColumn("slice", every(slices))
    both = dealt.unionByName(models, allowMissingColumns=True).withColumn("to", F.col("part") * slices + F.col("slice"))
    both = both.repartitionById(parts * slices, "to").sortWithinPartitions("to", "tree", "piece")  # rows before trees

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to, chunks, bins, total, tree, own = None, [], None, None, None, []

        def add() -> None:
            if own and chunks:
                model = {k: np.concatenate([np.frombuffer(piece[i], kind) for piece in own]) for i, (k, kind) in enumerate(KINDS.items())}
                total[:] += walk(model, bins)
            own.clear()

        def sums() -> Iterator[pa.RecordBatch]:
            add()
            at = 0
            for chunk, held in chunks:
                n = held // n_features
                yield pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([to], pa.int32()), pa.array([total[at: at + n].tobytes()], pa.binary())], names=["chunk", "to", "total"])
                at += n

        for batch in batches:
            columns = [batch.column(c) for c in ("to", "tree", "chunk", "bins", *KINDS)]
            for i in range(batch.num_rows):
                now, t, chunk, held, *piece = (c[i].as_py() for c in columns)
                if now != to:
                    if total is not None:
                        yield from sums()
                    to, chunks, total, tree = now, [], None, None
                    own.clear()
                if t < 0:
                    chunks.append((chunk, held))
                    continue
                if total is None:
                    bins = np.frombuffer(b"".join(held for _, held in chunks), np.uint8).reshape(-1, n_features)
                    chunks, total = [(c, len(b)) for c, b in chunks], np.zeros(len(bins))
                if t != tree:
                    add()
                    tree = t
                own.append(piece)
        if total is not None:
            yield from sums()

    def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0.0
        for batch in batches:
            for i in range(batch.num_rows):
                some = batch.column("total")[i].as_py()
                if some is not None:  # the rows themselves come last
                    total = total + np.frombuffer(some)
                    continue
                ident, label = (batch.column(c)[i].values for c in ("ident", "label"))
                flat = batch.column("bins")[i].as_py()
                own = pa.FixedSizeBinaryArray.from_buffers(pa.binary(n_features), len(ident), [None, pa.py_buffer(flat)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([ident, label, own, pa.array(np.broadcast_to(total / trees, len(ident)))], names=["ident", "label", "bins", "probability"])
                total = 0.0

    summed = both.mapInArrow(run, "chunk long, to int, total binary").unionByName(packed.withColumn("to", F.lit(parts * slices)), allowMissingColumns=True)
    tasks = max(1, -(-n_rows * parts // (1 << 23)))  # 64 MB of sums each
    summed = summed.repartition(tasks, "chunk").sortWithinPartitions("chunk", "to")
    return summed.mapInArrow(mean, "ident long, label int, bins binary, probability double")


# ---- gradient boosting -----------------------------------------------------------------------------------------------------


class Rounds:
    """Settings of one boosting run; nodes of a tree are numbered level by level, children of k are 2 k + 1 and 2 k + 2."""

    def __init__(self, n_features: int, rounds: int, depth: int, rate: float, sample: float, columns: float, positive: float, seed: int):
        self.n_features, self.rounds, self.depth, self.rate, self.sample, self.positive, self.seed = n_features, rounds, depth, rate, sample, positive, seed
        self.n_columns = max(1, round(columns * n_features))

    def columns(self, t: int) -> np.ndarray:
        """Features of round ``t``."""
        return np.sort(np.argsort(uniform(self.seed, 7, t, np.arange(self.n_features)))[: self.n_columns])

    def empty_tree(self) -> dict[str, np.ndarray]:
        size = (1 << (self.depth + 1)) - 1
        return {"feature": np.full(size, -1), "cut": np.zeros(size, np.int64), "value": np.zeros(size)}

    def nodes(self, tree: dict[str, np.ndarray], bins: np.ndarray, levels: int) -> np.ndarray:
        """Node of each row after so many levels; a row that met a leaf stays there."""
        steps, flat, base = self.steps(tree), np.ascontiguousarray(bins).ravel(), np.arange(0, bins.size, self.n_features)
        at = np.zeros(len(bins), np.int64)
        for _ in range(levels):
            at = self.below(steps, flat, base, at)
        return at

    def steps(self, tree: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Feature, cut and left child by node; nothing lies beyond the cut of a leaf, which is its own left child."""
        inner, every = tree["feature"] >= 0, np.arange(len(tree["feature"]))
        return np.maximum(tree["feature"], 0), np.where(inner, tree["cut"], BINS - 1).astype(np.uint8), np.where(inner, 2 * every + 1, every)

    def below(self, steps: tuple[np.ndarray, np.ndarray, np.ndarray], flat: np.ndarray, base: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Node of each row one level further down; ``base`` is where its bins begin in ``flat``."""
        feature, cut, left = steps
        return left.take(at) + (flat.take(base + feature.take(at)) > cut.take(at))

    def gradients(self, margin: np.ndarray, label: np.ndarray, ident: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
        """First and second derivative of the weighted log loss in whole units; zero for rows that sit the round out."""
        p = 1.0 / (1.0 + np.exp(-margin))
        w = np.where(label == 1, self.positive, 1.0) * (uniform(self.seed, 11, t, ident) < self.sample)
        return np.rint(w * (p - label) * UNIT), np.rint(w * p * (1.0 - p) * UNIT)

    def level_sums(self, at: np.ndarray, by_column: np.ndarray, g: np.ndarray, h: np.ndarray, wanted: np.ndarray, columns: np.ndarray) -> np.ndarray:
        """Sums of g and h by (wanted node, column, bin): whole numbers; ``by_column`` has a row of bins for each feature."""
        slot = np.full((1 << (self.depth + 1)) - 1, -1)
        slot[wanted] = np.arange(0, len(wanted) * BINS, BINS)
        key = slot.take(at)
        some = np.flatnonzero((key >= 0) & ((g != 0) | (h != 0)))
        key, g, h = key.take(some), g.take(some), h.take(some)
        out = np.empty((2, len(columns), len(wanted) * BINS))
        for k, f in enumerate(columns):
            place = key + by_column[f].take(some)
            out[0, k], out[1, k] = np.bincount(place, g, len(wanted) * BINS), np.bincount(place, h, len(wanted) * BINS)
        return out.reshape(2, len(columns), len(wanted), BINS).transpose(2, 1, 3, 0)

    def with_siblings(self, part: np.ndarray, wanted: np.ndarray, above: np.ndarray, level: int) -> np.ndarray:
        """The sums of a whole level from those of one child of each pair and the sums of the level above."""
        out = np.zeros((1 << level, *part.shape[1:]), np.int64)
        at = wanted - ((1 << level) - 1)
        out[at], out[at ^ 1] = part, above[at >> 1] - part
        return out

    def split_level(self, tree: dict[str, np.ndarray], sums: np.ndarray, level: int, columns: np.ndarray) -> np.ndarray:
        """Set the splits of a level and the values of the nodes below; the lighter child of each pair below."""
        first = (1 << level) - 1
        left = np.cumsum(sums, axis=2) / UNIT
        total = left[:, :, -1:, :]
        right = total - left
        score = lambda s: s[..., 0] ** 2 / (s[..., 1] + LAMBDA)
        gain = score(left) + score(right) - score(total)
        gain = np.where((left[..., 1] >= MIN_CHILD) & (right[..., 1] >= MIN_CHILD), gain, -np.inf)
        flat = gain.reshape(len(gain), -1)
        best = np.argmax(flat, axis=1)
        value = lambda s: -self.rate * s[..., 0] / (s[..., 1] + LAMBDA)
        if level == 0:
            tree["value"][0] = value(total[0, 0, 0])
        # a leaf met above has no rows here and gains nothing
        lighter = []
        for k in np.flatnonzero(flat[np.arange(len(flat)), best] > 1e-6):
            f, cut = divmod(int(best[k]), BINS)
            node = first + int(k)
            tree["feature"][node], tree["cut"][node] = columns[f], cut
            tree["value"][2 * node + 1], tree["value"][2 * node + 2] = value(left[k, f, cut]), value(right[k, f, cut])
            lighter.append(2 * node + 1 + int(right[k, f, cut, 1] < left[k, f, cut, 1]))
        return np.array(lighter, np.int64)

    def run(self, sums: Callable[[int, dict, int, np.ndarray, np.ndarray], np.ndarray], add: Callable[[dict], None]) -> list[dict[str, np.ndarray]]:
        """All rounds; ``sums(t, tree, level, wanted, columns)`` gives the sums of wanted nodes of a level, ``add(tree)`` adds a finished tree to the margins."""
        model = []
        for t in range(self.rounds):
            tree, columns = self.empty_tree(), self.columns(t)
            wanted, held = np.zeros(1, np.int64), None
            for level in range(self.depth):
                part = sums(t, tree, level, wanted, columns)
                held = self.with_siblings(part, wanted, held, level) if level else part
                wanted = self.split_level(tree, held, level, columns)
                if not len(wanted):
                    break
            model.append(tree)
            add(tree)
        return model

    def margins(self, model: list[dict[str, np.ndarray]], bins: np.ndarray, start: np.ndarray) -> np.ndarray:
        out = start.copy()
        for tree in model:
            out += tree["value"][self.nodes(tree, bins, self.depth)]
        return out


def boost_arrays(settings: Rounds, ident: np.ndarray, label: np.ndarray, bins: np.ndarray,
                 every: Callable[[np.ndarray], np.ndarray] = lambda sums: sums) -> list[dict[str, np.ndarray]]:
    """All rounds over rows in memory; ``every`` adds the sums of rows that are held elsewhere."""
    n, flat, by_column = len(label), np.ascontiguousarray(bins).ravel(), np.ascontiguousarray(bins.T)
    margin, g, h, at = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n, np.int64)
    parts = [slice(a, min(a + BOOST_CHUNK, n)) for a in range(0, n, BOOST_CHUNK)]
    base = np.arange(0, min(BOOST_CHUNK, n) * settings.n_features, settings.n_features)

    def go_down(steps: tuple, own: slice) -> None:
        some = flat[own.start * settings.n_features: own.stop * settings.n_features]
        at[own] = settings.below(steps, some, base[: own.stop - own.start], at[own])

    def sums(t, tree, level, wanted, columns):
        total, steps = np.zeros((len(wanted), len(columns), BINS, 2)), settings.steps(tree)
        for own in parts:
            if level:
                go_down(steps, own)
            else:
                g[own], h[own] = settings.gradients(margin[own], label[own], ident[own], t)
                at[own] = 0
            total += settings.level_sums(at[own], by_column[:, own], g[own], h[own], wanted, columns)
        return every(np.rint(total).astype(np.int64))

    def add(tree):
        steps = settings.steps(tree)
        for own in parts:
            go_down(steps, own)
            margin[own] += tree["value"].take(at[own])

    return settings.run(sums, add)


def boost_in_task(settings: Rounds, rows: DataFrame) -> list[dict[str, np.ndarray]]:
    """All rounds in one task; for tables of bounded size."""

    return models_of(rows.coalesce(1).mapInArrow(lambda batches: iter([packed_model(boost_arrays(settings, *held_rows(batches, settings.n_features)))]), MODEL))


MODEL = "t int, feature binary, cut binary, value binary"


def held_rows(batches: Iterator[pa.RecordBatch], n_features: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, labels and bins of all batches."""
    parts = [(numbers(b.column(0)), numbers(b.column(1)), unpacked(b.column(2), n_features)) for b in batches if b.num_rows]
    parts = parts or [(np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros((0, n_features), np.uint8))]
    return tuple(np.concatenate(p) for p in zip(*parts))


def packed_model(model: list[dict[str, np.ndarray]]) -> pa.RecordBatch:
    out = [pa.array([m[k].tobytes() for m in model], pa.binary()) for k in model[0]]
    return pa.RecordBatch.from_arrays([pa.array(range(len(model)), pa.int32()), *out], names=["t", *model[0]])


def models_of(found: DataFrame) -> list[dict[str, np.ndarray]]:
    kinds = {"feature": np.int64, "cut": np.int64, "value": np.float64}
    return [{k: np.frombuffer(r[k], kind) for k, kind in kinds.items()} for r in sorted(found.collect(), key=lambda r: r.t)]


def slots(rows: DataFrame) -> int:
    """Tasks that surely run at the same time, or 0 where that is not known."""
    conf = rows.sparkSession.sparkContext.getConf()
    fixed = conf.get("spark.dynamicAllocation.enabled", "false") == "false" and conf.get("spark.task.cpus", "1") == "1" and not conf.contains("spark.default.parallelism")
    return rows.sparkSession.sparkContext.defaultParallelism if fixed else 0


def shortened(sums: np.ndarray) -> str:
    """Whole numbers as text: of each as many low bytes as the largest needs, and how many that are."""
    most = max(int(sums.max()), -int(sums.min()) - 1, 0)
    size = most.bit_length() // 8 + 1
    return str(size) + base64.b64encode(sums.astype("<i8").ravel().view(np.uint8).reshape(-1, 8)[:, :size].tobytes()).decode()


def short_numbers(text: str) -> np.ndarray:
    size = int(text[0])
    low = np.frombuffer(base64.b64decode(text[1:]), np.uint8).reshape(-1, size)
    out = np.zeros((len(low), 8), np.uint8)
    out[:, 8 - size:] = low
    return out.view("<i8").ravel() >> (64 - 8 * size)


def boost_together(settings: Rounds, rows: DataFrame, tasks: int) -> list[dict[str, np.ndarray]]:
    """All rounds in one barrier stage: each task holds its share of the rows, a level's sums are exchanged and added by every task.

    Sums are whole numbers, so all tasks grow the same tree. A message holds 2 ** (depth - 2) * features * BINS pairs of sums at most, as few bytes as they need.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = BarrierTaskContext.get()

        def every(own: np.ndarray) -> np.ndarray:
            return sum(short_numbers(x) for x in task.allGather(shortened(own))).reshape(own.shape)

        model = boost_arrays(settings, *held_rows(batches, settings.n_features), every)
        if task.partitionId() == 0:
            yield packed_model(model)

    return models_of(rows.repartition(tasks).mapInArrow(run, MODEL, barrier=True))


def boost_in_jobs(settings: Rounds, rows: DataFrame) -> list[dict[str, np.ndarray]]:
    """All rounds with one aggregate over all rows for each level; at most 2 ** depth * features * BINS sums reach the driver."""
    state = {"rows": stored(rows.withColumn("margin", F.lit(0.0)), "margins"), "late": []}

    def with_margin(batch: pa.RecordBatch, late: list) -> tuple:
        bins = unpacked(batch.column("bins"), settings.n_features)
        return bins, settings.margins(late, bins, numbers(batch.column("margin")))

    def sums(t, tree, level, wanted, columns):
        late = list(state["late"])
        shape = (len(wanted), len(columns), BINS, 2)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(shape, np.int64)
            for batch in batches:
                bins, margin = with_margin(batch, late)
                g, h = settings.gradients(margin, numbers(batch.column("label")), numbers(batch.column("ident")), t)
                at = settings.nodes(tree, bins, level)
                total += np.rint(settings.level_sums(at, np.ascontiguousarray(bins.T), g, h, wanted, columns)).astype(np.int64)
            flat = total.reshape(-1, 2)
            cell = np.flatnonzero(flat.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(flat[cell, 0]), pa.array(flat[cell, 1])], names=["cell", "g", "h"])

        cells = state["rows"].mapInArrow(run, "cell long, g long, h long").groupBy("cell").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()
        out = np.zeros(shape, np.int64)
        if cells:
            at = np.array([tuple(c) for c in cells], np.int64)
            out.reshape(-1, 2)[at[:, 0]] = at[:, 1:]
        return out

    def add(tree):
        state["late"].append(tree)
        if len(state["late"]) >= STORE_ROUNDS:
            late = list(state["late"])

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    yield batch.set_column(batch.schema.get_field_index("margin"), "margin", pa.array(with_margin(batch, late)[1]))

            state["rows"], state["late"] = stored(state["rows"].mapInArrow(run, state["rows"].schema), "margins"), []

    return settings.run(sums, add)


def fit_boosting(rows: DataFrame, n_features: int, rounds: int, depth: int, rate: float, sample: float = 1.0, columns: float = 1.0, seed: int = 42,
                 local_rows: int = LOCAL_ROWS) -> tuple[Rounds, list[dict[str, np.ndarray]]]:
    """Trees for ``rows`` (ident, label, bins), positives weighed by the ratio of the classes (one at least)."""
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("pos")).first()
    if not total.n:
        raise ValueError("no rows to fit")
    positive = max((total.n - total.pos) / max(total.pos, 1), 1.0)
    settings = Rounds(n_features, rounds, depth, rate, sample, columns, positive, seed)
    if total.n <= local_rows:
        return settings, boost_in_task(settings, rows)
    tasks = slots(rows)
    if total.n <= tasks * HELD_ROWS:
        return settings, boost_together(settings, rows, tasks)
    return settings, boost_in_jobs(settings, rows)


def score_boosting(rows: DataFrame, settings: Rounds, model: list[dict[str, np.ndarray]]) -> DataFrame:
    """(ident, label, probability); the model has rounds * 2 ** (depth + 1) nodes, whatever the data."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            margin = settings.margins(model, unpacked(batch.column("bins"), settings.n_features), np.zeros(batch.num_rows))
            yield pa.RecordBatch.from_arrays([batch.column("ident"), batch.column("label"), pa.array(1.0 / (1.0 + np.exp(-margin)))], names=["ident", "label", "probability"])

    return rows.mapInArrow(run, "ident long, label int, probability double")
