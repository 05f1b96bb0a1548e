"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence matrix.

A document's set holds its distinct shingles of ``width`` words (A-Z lower-cased); fewer words make one shingle, no words an empty set,
which links with nothing. Two documents link at ``percent`` of intersection over union. Documents with equal sets are one row of the
matrix (a class, known by its smallest id, the node). For sets of x and y shingles a link needs an overlap of percent (x + y) /
(100 + percent) at least; every bound below follows from this.

1. ``sketched``: one pass over the texts gives sizes and classes, and counts shingles in ``BUCKETS`` counters (2 MB, whatever the corpus).
   Shingles in less filled counters come first in the common order of columns.
2. Row prefixes: a document keeps its first x - ceil(percent x / 100) + 1 shingles in this order. Linked documents share one of them at
   least, so only columns of prefixes need to be looked at. Columns with a single row go.
3. Stars: in each column the ``LEADERS`` rows with most shared columns lead; the column's rows are multiplied with them, in blocks. Overlap
   counts over prefixes discard pairs first: beyond its prefix a document adds at most x - prefix to the overlap. The counts over
   whole sets of the pairs left give the links, ``components`` their classes.
4. Open columns: those in which rows besides the leaders, of different components and fitting sizes, still meet. Their blocks are
   multiplied with each other, again over prefixes and then over the whole sets of the rows left; pairs of one component are not looked
   at. A task gives out only links that join components, fewer than its rows, so no list of all pairs arises and no link between
   components is lost.

Rows with a null id take no part (component null). Repeated ids are one node: the links of either row count. Texts of any length, empty
tables and extra columns are fine; a task holds a batch of documents or two blocks of about ``BLOCK`` shingles and ``ROWS`` rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from copy import copy

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import BITS, as_bytes, bits_of, chunked, grouped, has_bit, map_arrow, offsets, per_row, small_batches, stored
from .components import components
from .minhash import class_of, shingle_set

BUCKETS = 1 << 18
BLOCK, ROWS, CHUNK, LEADERS = 1 << 19, 1024, 1 << 19, 4
DENSE, EXPANDED = 32, 1 << 22


def needed(size, percent: int):
    """The least overlap of a set of ``size`` with any linked one."""
    return -(-percent * size // 100)


def needed_by_both(x, y, percent: int):
    return -(-percent * (x + y) // (100 + percent))


def prefix_size(size, percent: int):
    return size - needed(size, percent) + 1


# --- sizes, classes, prefixes -------------------------------------------------------------------------------------------


def sketched(docs: DataFrame, doc_id: str, text: str, width: int) -> DataFrame:
    """Rows (id, n_shingles, cls) of documents, and rows (bucket, filled) with each task's counts of shingles by bucket."""

    def run(batches):
        filled = np.zeros(BUCKETS, np.int64)
        for chunk in chunked(batches, "t", CHUNK):
            sets = [shingle_set(t, width) for t in chunk.column(1).to_pylist()]
            filled += np.bincount((np.concatenate(sets) % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS)
            none = pa.nulls(len(sets), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [chunk.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([class_of(s) if len(s) else None for s in sets], pa.binary()), none, none],
                names=["id", "n_shingles", "cls", "bucket", "filled"])
        at = np.flatnonzero(filled)
        if len(at):
            none = pa.nulls(len(at), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, pa.nulls(len(at), pa.binary()), pa.array(at), pa.array(filled[at])],
                                             names=["id", "n_shingles", "cls", "bucket", "filled"])

    rows = small_batches(docs.select(F.col(doc_id).cast("long").alias("id"), as_bytes(text).alias("t")))
    return rows.mapInArrow(run, "id long, n_shingles long, cls binary, bucket long, filled long")


def column_weights(sketch: DataFrame) -> np.ndarray:
    """Filling of all ``BUCKETS`` counters over the corpus."""
    counted = sketch.filter("bucket is not null").groupBy("bucket").agg(F.sum("filled").alias("filled")).toPandas()
    weights = np.zeros(BUCKETS, np.int64)
    weights[counted["bucket"].to_numpy(np.int64)] = counted["filled"].to_numpy(np.int64)
    return weights


def prefixes(docs: DataFrame, doc_id: str, text: str, width: int, percent: int, weights) -> DataFrame:
    """(id, cls, n, grams): the first shingles of every set in the common order, as sorted 64-bit numbers."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_set(t, width) for t in batch.column(1).to_pylist()]
        filled, kept = [i for i, s in enumerate(sets) if len(s)], []
        for i in filled:
            s = sets[i]
            order = np.lexsort((s, weights.value[(s % np.uint64(BUCKETS)).astype(np.int64)]))
            kept.append(np.sort(s[order[: prefix_size(len(s), percent)]]).tobytes())
        return pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(filled, pa.int64())), pa.array([class_of(sets[i]) for i in filled], pa.binary()),
             pa.array([len(sets[i]) for i in filled], pa.int64()), pa.array(kept, pa.binary())], names=["id", "cls", "n", "grams"])

    rows = docs.select(F.col(doc_id).cast("long").alias("id"), as_bytes(text).alias("t")).filter("id is not null")
    return map_arrow(rows, run, "id long, cls binary, n long, grams binary", "t", CHUNK)


def shared_columns(rows: DataFrame) -> DataFrame:
    """(gram, node, n) of the columns with two rows at least, by one shuffle on the column; a column may span batches and tasks stream."""

    def entries(batch: pa.RecordBatch) -> pa.RecordBatch:
        grams = [np.frombuffer(g, np.int64) for g in batch.column(2).to_pylist()]
        at = pa.array(per_row(np.array([len(g) for g in grams])))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(grams)), batch.column(0).take(at), batch.column(1).take(at)], names=["gram", "node", "n"])

    def several(batches):
        held = None  # the last row so far, and whether it has been given out
        for batch in batches:
            if not batch.num_rows:
                continue
            gram = batch.column(0).to_numpy()
            same = gram[1:] == gram[:-1]
            keep = np.r_[False, same] | np.r_[same, False]
            if held is not None and held[0].column(0)[0].as_py() == gram[0]:
                keep[0] = True
                if not held[1]:
                    yield held[0]
            if keep.any():
                yield batch.filter(pa.array(keep))
            held = (batch.slice(batch.num_rows - 1), bool(keep[-1]))

    schema = "gram long, node long, n long"
    return map_arrow(rows.select("node", "n", "grams"), entries, schema, "grams").repartition("gram").sortWithinPartitions("gram").mapInArrow(several, schema)


# --- products -------------------------------------------------------------------------------------------------------------


class Block:
    """Rows of the incidence matrix: (node, n) and their column numbers."""

    def __init__(self, rows: pa.Table):
        self.node, self.n = rows.column("node").to_numpy(), rows.column("n").to_numpy()
        self.sets = [np.frombuffer(g, np.uint64) if isinstance(g, bytes) else np.sort(np.array(g, np.int64).view(np.uint64)) for g in rows.column("grams").to_pylist()]

    def __len__(self) -> int:
        return len(self.node)

    def before(self, gram: int) -> Block:
        """The same rows with the columns before ``gram`` only."""
        out, cut = copy(self), np.uint64(gram % (1 << 64))
        out.sets = [s[: np.searchsorted(s, cut)] for s in self.sets]
        return out

    def entries(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Column numbers and row places of these rows."""
        own = [self.sets[k] for k in rows]
        return (np.concatenate(own) if own else np.zeros(0, np.uint64)), per_row(np.array([len(s) for s in own], np.int64))


def overlaps(block: Block, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Overlap counts of the rows ``a`` with the rows ``b``: the product of two blocks, accumulated over their common columns.

    Columns filled in many rows are multiplied as dense slices, all others by their pairs of rows.
    """
    out = np.zeros(len(a) * len(b), np.int32)
    (x, xr), (y, yr) = block.entries(a), block.entries(b)
    common = np.intersect1d(x, y)
    if not len(common):
        return out.reshape(len(a), len(b))
    sides = []
    for grams, rows in ((x, xr), (y, yr)):
        at = np.minimum(np.searchsorted(common, grams), len(common) - 1)
        hit = common[at] == grams
        order = np.argsort(at[hit], kind="stable")
        column = at[hit][order]
        sides.append((column, rows[hit][order], offsets(np.bincount(column, minlength=len(common)))))
    (xc, xr, xs), (yc, yr, ys) = sides
    nx, ny = np.diff(xs), np.diff(ys)
    dense = np.minimum(nx, ny) >= DENSE
    for some in np.array_split(np.flatnonzero(dense), max(1, -(-int(dense.sum()) // 1024))):
        if len(some):
            place = np.full(len(common), -1)
            place[some] = np.arange(len(some))
            p, q = (np.zeros((size, len(some)), np.float32) for size in (len(a), len(b)))
            for m, c, r in ((p, xc, xr), (q, yc, yr)):
                inside = place[c] >= 0
                m[r[inside], place[c[inside]]] = 1
            out += (p @ q.T).astype(np.int32).ravel()
    # the others: each entry of a is paired with the rows of b in its column
    inside = ~dense[xc]
    xc, xr = xc[inside], xr[inside]
    ends = offsets(ny[xc])
    at = 0
    while at < len(xc):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + EXPANDED, "right")) - 1)
        many = ny[xc[at:to]]
        k = np.arange(ends[to] - ends[at]) - np.repeat(ends[at:to] - ends[at], many) + np.repeat(ys[xc[at:to]], many)
        np.add.at(out, np.repeat(xr[at:to], many) * len(b) + yr[k], 1)
        at = to
    return out.reshape(len(a), len(b))


def fitting(block: Block, a: np.ndarray, b: np.ndarray, percent: int, whole: bool) -> np.ndarray:
    """Mask of the pairs of rows whose sizes and overlap allow a link (prefixes), or make one (whole sets)."""
    x, y = block.n[a][:, None], block.n[b][None, :]
    counts = overlaps(block, a, b)
    if whole:
        return 100 * counts >= percent * (x + y - counts)
    rest = np.maximum(x - prefix_size(x, percent), y - prefix_size(y, percent))
    return (100 * np.minimum(x, y) >= percent * np.maximum(x, y)) & (counts + rest >= needed_by_both(x, y, percent)) & (counts > 0)


def block_count() -> Column:
    """Blocks for a group with sizes ``n``: by shingles and by rows."""
    return F.greatest(F.ceil(F.sum("n") / F.lit(BLOCK)), F.ceil(F.count(F.lit(1)) / F.lit(ROWS))).cast("int")


def of_block(node: str = "node") -> Column:
    return F.pmod(F.xxhash64(F.col(node), F.lit(13)), F.col("n_blocks")).cast("int")


def star_pairs(pairs: DataFrame, rows: DataFrame, percent: int, whole: bool) -> DataFrame:
    """The pairs (leader, node) that fit. A leader's row goes to each block of its mates once."""

    def run(batches):
        for (leader, _), group in grouped(batches, ("leader", "block")):
            block = Block(group)
            led = np.flatnonzero(block.node == leader)
            rest = np.flatnonzero(block.node != leader)
            for at in range(0, len(rest), ROWS):
                some = rest[at: at + ROWS]
                hit = some[fitting(block, led, some, percent, whole).any(axis=0)]
                if len(hit):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(hit), leader)), pa.array(block.node[hit])], names=["leader", "node"])

    sizes = pairs.join(rows.select("node", "n"), "node").groupBy("leader").agg(block_count().alias("n_blocks"))
    mates = pairs.join(sizes, "leader").select("leader", of_block().alias("block"), "node")
    heads = sizes.select("leader", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("block"), F.col("leader").alias("node"))
    # one join for leaders and mates: whole rows are shuffled once to be found and once to be dealt
    both = mates.unionAll(heads).join(rows, "node").select("leader", "block", "node", "n", "grams")
    both = both.repartition("leader", "block").sortWithinPartitions("leader", "block")
    return small_batches(both).mapInArrow(run, "leader long, node long").distinct()


# --- open columns -----------------------------------------------------------------------------------------------------------


def size_class(percent: int) -> Column:
    """Linked documents lie in the same class of sizes or in neighbouring ones (the margin covers rounding of the logarithm)."""
    return F.floor(F.log(F.col("n").cast("double")) / F.lit(-np.log(percent / 100) + 1e-9)).cast("int")


def leading(shared: DataFrame) -> DataFrame:
    """(gram, leader, leader_n): up to ``LEADERS`` rows of each column, those with most shared columns; picked before the shuffle."""
    wide = shared.groupBy("node").agg(F.count(F.lit(1)).alias("columns"))
    order = Window.partitionBy("gram").orderBy(F.desc("columns"), "node")
    ranked = shared.join(wide, "node").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= LEADERS)
    return ranked.select("gram", F.col("node").alias("leader"), F.col("n").alias("leader_n"))


def open_columns(shared: DataFrame, leaders: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """(gram, node, n, component): rows besides the leaders that meet one of another component and a fitting size class in a column.

    Rows are looked at by (column, larger size class of a pair), so a row stands in its own class and the next.
    """
    rest = shared.join(leaders.select("gram", F.col("leader").alias("node")), ["gram", "node"], "left_anti")
    placed = rest.join(found, "node", "left").withColumn("component", F.coalesce("component", "node")).withColumn("own", size_class(percent))
    both = placed.withColumn("at", F.explode(F.array(F.col("own"), F.col("own") + 1)))
    mixed = both.groupBy("gram", "at").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.max("own").alias("top")).filter(
        "lo < hi and top = at").select("gram", "at")
    return both.join(mixed, ["gram", "at"]).select("gram", "node", "n", "component").distinct()


def in_blocks(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Members of columns with their ``grams`` of ``sets`` (node, n, grams), dealt to pairs (i, j) of blocks, sorted by group."""
    sizes = members.groupBy("gram").agg(block_count().alias("n_blocks"))
    dealt = members.join(sizes, "gram").withColumn("block", of_block()).join(sets, ["node", "n"])
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1))).drop("n_blocks")
    dealt = dealt.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("other")
    return dealt.repartition("gram", "i", "j").sortWithinPartitions("gram", "i", "j")


GROUP = ("gram", "i", "j")


def tiles(block: Block, group: pa.Table, key: tuple[int, ...], component: np.ndarray, percent: int, whole: bool) -> Iterator[tuple]:
    """(a, b, fit) for tiles of the product of a group's two blocks: rows, other rows, and which pairs of them fit.

    ``component`` may change between two tiles; tiles of one component are left out. Within one block each pair comes up once, and so
    it does across two. Over prefixes, a pair counts in its least common column only: earlier columns are multiplied as well.
    """
    of = group.column("block").to_numpy()
    i, j = (np.flatnonzero(of == k) for k in key[1:])
    earlier = None if whole else block.before(key[0])
    for at in range(0, len(i), ROWS):
        for to in range(0 if key[1] != key[2] else at, len(j), ROWS):
            a, b = i[at: at + ROWS], j[to: to + ROWS]
            apart = component[a][:, None] != component[b][None, :]
            if not apart.any():
                continue
            fit = apart & fitting(block, a, b, percent, whole)
            if key[1] == key[2] and at == to:
                fit &= np.arange(len(a))[:, None] < np.arange(len(b))[None, :]
            if earlier is not None and fit.any():
                fit &= overlaps(earlier, a, b) == 0
            yield a, b, fit


def waiting(dealt: DataFrame, percent: int) -> DataFrame:
    """(gram, node) of the members whose prefixes allow a link with another component that is not looked at in another column."""

    def run(batches):
        for key, group in grouped(batches, GROUP):
            block, component = Block(group), group.column("component").to_numpy()
            marked = np.zeros(len(block), bool)
            for a, b, fit in tiles(block, group, key, component, percent, False):
                marked[a[fit.any(axis=1)]] = True
                marked[b[fit.any(axis=0)]] = True
            if marked.any():
                yield from group.select(["gram", "node"]).filter(pa.array(marked)).to_batches()

    return small_batches(dealt).mapInArrow(run, "gram long, node long").distinct()


def joining(dealt: DataFrame, percent: int) -> DataFrame:
    """(u, v) of links that join components, a spanning set for each group."""

    def run(batches):
        for key, group in grouped(batches, GROUP):
            block, component = Block(group), group.column("component").to_numpy().copy()
            u, v = [], []
            for a, b, fit in tiles(block, group, key, component, percent, True):
                for row in np.flatnonzero(fit.any(axis=1)):
                    k = a[row]
                    for m in b[fit[row]]:
                        if component[m] != component[k]:
                            component[component == component[m]] = component[k]
                            u.append(int(block.node[k]))
                            v.append(int(block.node[m]))
            if u:
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return small_batches(dealt).mapInArrow(run, "u long, v long")


def sized_sets(docs: DataFrame, nodes: DataFrame, doc_id: str, text: str, width: int) -> DataFrame:
    """(node, n, grams): whole sets of the documents with these ids, stored. Ids that pass the bits by chance find no partner later."""
    place = F.pmod(F.xxhash64("node"), F.lit(BITS)).cast("long")
    bits = bits_of(nodes, place)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        some = pa.array(np.flatnonzero(has_bit(bits.value, batch.column(2).to_numpy())))
        sets = [shingle_set(t, width) for t in batch.column(1).take(some).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0).take(some), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())],
                                          names=["node", "n", "grams"])

    rows = docs.select(F.col(doc_id).cast("long").alias("node"), as_bytes(text).alias("t")).filter("node is not null").withColumn("at", place)
    out = stored(map_arrow(rows, run, "node long, n long, grams binary", "t", CHUNK).filter("n > 0"), "sets")
    bits.destroy()
    return out


def jaccard_links(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 4, percent: int = 85) -> DataFrame:
    """One row per document: id, n_shingles, cls (documents with equal sets share it), component_id."""
    sketch = stored(sketched(docs, doc_id, text, width), "sketch")
    s = sketch.filter("bucket is null").select("id", "n_shingles", "cls")
    weights = docs.sparkSession.sparkContext.broadcast(column_weights(sketch))
    in_graph = s.filter("id is not null and cls is not null")
    nodes = stored(in_graph.groupBy("cls").agg(F.min("id").alias("node")), "nodes")
    own = prefixes(docs, doc_id, text, width, percent, weights).join(nodes.withColumnRenamed("node", "id"), ["id", "cls"], "left_semi")
    own = stored(own.select(F.col("id").alias("node"), "n", "grams"), "prefixes")
    weights.destroy()
    shared = stored(shared_columns(own), "columns")
    # only shared columns add to an overlap: rows travel with these, not with their whole prefixes
    rows = stored(shared.groupBy("node", "n").agg(F.collect_set("gram").alias("grams")), "rows")

    # stars: prefixes first, then whole sets
    leaders = stored(leading(shared), "leaders")
    led = shared.join(leaders, "gram").filter("node <> leader").filter(F.least("n", "leader_n") * 100 >= F.greatest("n", "leader_n") * percent)
    led = led.select("leader", "node").distinct()
    likely = stored(star_pairs(stored(led, "stars"), rows, percent, False), "likely")
    ends = likely.select("node").unionAll(likely.select("leader"))
    links = stored(star_pairs(likely, sized_sets(docs, ends, doc_id, text, width), percent, True), "links")
    copies = in_graph.join(nodes, "cls").filter("id <> node").select(F.col("id").alias("u"), F.col("node").alias("v"))
    edges = links.select(F.col("leader").alias("u"), F.col("node").alias("v")).unionAll(copies)
    found = components(edges)

    # columns in which different components still meet
    members = stored(open_columns(shared, leaders, found, percent), "open")
    # a pair to be found here shares open columns only
    lists = members.groupBy("node", "n").agg(F.collect_set("gram").alias("grams"))
    marks = stored(waiting(in_blocks(members, lists), percent), "waiting")
    if not marks.isEmpty():
        sets = sized_sets(docs, marks.select("node"), doc_id, text, width)
        more = stored(joining(in_blocks(marks.join(members, ["gram", "node"]), sets), percent), "joining")
        if not more.isEmpty():
            found = components(edges.unionAll(more))
    return s.join(found.withColumnRenamed("node", "id"), "id", "left").select(
        F.col("id").alias(doc_id), "n_shingles", "cls", F.coalesce("component", "id").alias("component_id"))
