"""MinHash near-duplicates: universal hash minima, banding, signature verification, exact check on the full sets, and
connected components.

A document's set holds its distinct shingles of ``width`` words (A-Z lower-cased); fewer words make one shingle, no words
an empty set, which links with nothing. Documents with equal sets form a class; only classes are compared.

1. ``n_bands * rows`` minima of a multiply-shift family. A pair at similarity 0.8 shares no band of 40 x 6 with
   probability 5e-6.
2. Within a bucket the member with most bucket mates leads, and all others are paired with it: a bucket of n gives n - 1
   pairs. Pairs whose signatures (8 bits of each minimum) agree well enough are confirmed on the full sets.
3. Buckets whose members still lie in different components are gone through in blocks: pairs of different components whose signatures
   agree are confirmed inside the task, each pair in the first band it shares. A task gives out only links that join
   something, fewer than its members, so no link between components is lost and no list of pairs arises.

Rows with a null id take no part (component null, kept). Repeated ids are one node: the links of either row count. Texts of any
length, empty tables and extra columns are fine; each task holds one batch of documents or one block of signatures.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import BITS, LEFT, RIGHT, as_bytes, bits_of, cleaned, has_bit, map_arrow, mix, offsets, released, stored, word_hashes
from .components import components

BANDS, ROWS, BLOCK, CHUNK = 40, 6, 2048, 1 << 19
MARGIN = 0.14  # five standard deviations of the estimate from 240 minima at 0.8
NO_WORDS = np.zeros(0, np.uint64)


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """Sorted distinct shingle hashes of one text."""
    words = word_hashes(text.lower())
    if not len(words):
        return NO_WORDS
    size = min(width, len(words))
    names = words * RIGHT if size == 1 else words
    for k in range(1, size):  # a chain, so that widths never collide
        names = mix(names[: len(words) - k] * LEFT + words[k:] * RIGHT + np.uint64(k))
    return np.unique(names)


def class_of(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


def family(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Parameters of the multiply-shift functions (odd factors), the same in every task."""
    seeds = mix(np.arange(1, 2 * size + 1, dtype=np.uint64) * RIGHT)
    return seeds[:size] | np.uint64(1), seeds[size:]


def minima(sets: list[np.ndarray], size: int) -> np.ndarray:
    """(number of sets) x size minima; sets are not empty."""
    x = np.concatenate(sets)
    starts = offsets([len(s) for s in sets])[:-1]
    a, b = family(size)
    out = np.empty((size, len(sets)), np.uint32)
    v, top = np.empty(len(x), np.uint64), np.uint64(32)
    for k in range(size):
        np.multiply(x, a[k], out=v)
        v += b[k]
        v >>= top
        out[k] = np.minimum.reduceat(v, starts)
    return out.T


def signatures(docs: DataFrame, doc_id: str, text: str, width: int, bands: int, rows: int) -> DataFrame:
    """One row per document: id, set size, class, 8 bits of every minimum, band keys (empty sets: nulls)."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_set(t, width) for t in batch.column(1).to_pylist()]
        filled = [i for i, s in enumerate(sets) if len(s)]
        cls, sig, keys = ([None] * len(sets) for _ in range(3))
        if filled:
            low = minima([sets[i] for i in filled], bands * rows)
            eight = low.astype(np.uint8)
            wide = low.reshape(len(filled), bands, rows).astype(np.uint64)
            band = np.broadcast_to(np.arange(bands, dtype=np.uint64), wide.shape[:2]) * RIGHT
            for r in range(rows):
                band = mix(band * LEFT + wide[:, :, r])
            for j, i in enumerate(filled):
                cls[i], sig[i], keys[i] = class_of(sets[i]), eight[j].tobytes(), band[j].view(np.int64)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(cls, pa.binary()), pa.array(sig, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
            names=["id", "n_shingles", "cls", "sig", "bands"],
        )

    rows_in = docs.select(F.col(doc_id).cast("long").alias("id"), as_bytes(text).alias("t"))
    return map_arrow(rows_in, run, "id long, n_shingles long, cls binary, sig binary, bands array<long>", "t", CHUNK)


def agreeing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity estimated from 8-bit minima; chance agreement taken off."""
    share = (a == b).mean(axis=-1)
    return (share - 1 / 256) / (1 - 1 / 256)


def similar_signatures(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """The pairs of nodes (x, y) whose sizes allow and whose signatures suggest the similarity."""
    least = percent / 100 - MARGIN
    side = lambda c: reps.select(F.col("node").alias(c), F.col("sig").alias(f"{c}_sig"), F.col("n_shingles").alias(f"{c}_n"))
    both = pairs.join(side("x"), "x").join(side("y"), "y").filter(F.least("x_n", "y_n") * 100 >= F.greatest("x_n", "y_n") * percent)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        a, b = (byte_rows(batch.column(c).to_pylist()) for c in ("x_sig", "y_sig"))
        return batch.select(["x", "y"]).filter(pa.array(agreeing(a, b) >= least))

    return map_arrow(both.select("x", "y", "x_sig", "y_sig"), run, "x long, y long", "x_sig")


def byte_rows(values: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(values), np.uint8).reshape(len(values), -1)


def full_sets(docs: DataFrame, nodes: DataFrame, doc_id: str, text: str, width: int) -> DataFrame:
    """(node, shingles as bytes) of the documents with these ids, stored; texts are not shuffled to find them."""
    place = F.pmod(F.xxhash64("node"), F.lit(BITS)).cast("long")
    nodes = stored(nodes.distinct(), "nodes")
    bits = bits_of(nodes, place)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        some = pa.array(np.flatnonzero(has_bit(bits.value, batch.column(2).to_numpy())))
        sets = [shingle_set(t, width).tobytes() for t in batch.column(1).take(some).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0).take(some), pa.array(sets, pa.binary())], names=["node", "shingles"])

    rows = docs.select(F.col(doc_id).cast("long").alias("node"), as_bytes(text).alias("t")).filter("node is not null").withColumn("at", place)
    out = stored(map_arrow(rows, run, "node long, shingles binary", "t").join(nodes, "node", "left_semi").distinct(), "sets")
    bits.destroy()
    released(nodes)
    return out


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets reach the similarity."""
    side = lambda c: sets.select(F.col("node").alias(c), F.col("shingles").alias(f"{c}_set"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        hit = []
        for p, q in zip(batch.column("x_set").to_pylist(), batch.column("y_set").to_pylist()):
            a, b = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
            both = len(np.intersect1d(a, b, assume_unique=True))
            hit.append(100 * both >= percent * (len(a) + len(b) - both))
        return batch.select(["x", "y"]).filter(pa.array(hit, pa.bool_()))

    both = pairs.join(side("x"), "x").join(side("y"), "y").select("x", "y", "x_set", "y_set")
    return map_arrow(both, run, "x long, y long", "x_set")


def in_blocks(members: DataFrame) -> DataFrame:
    """Members of buckets, with their number ``size`` in the bucket, dealt to groups (band, i, j) of two blocks of about ``BLOCK`` members
    each, sorted by group."""
    blocks = members.withColumn("n_blocks", F.ceil(F.col("size") / F.lit(BLOCK)).cast("int")).drop("size")
    dealt = blocks.withColumn("block", F.pmod(F.xxhash64("node"), F.col("n_blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1))).drop("n_blocks")
    dealt = dealt.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("other")
    return dealt.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j")


def by_group(batches, keys: tuple[str, ...]):
    """The rows of each group as a table, from batches sorted by group; a group may span batches."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        rows = rows if held is None else pa.concat_tables([held, rows])
        at = np.stack([rows.column(c).to_numpy().astype(np.int64) for c in keys])
        cuts = [0, *(np.flatnonzero((at[:, 1:] != at[:, :-1]).any(axis=0)) + 1).tolist()]
        for a, b in zip(cuts, cuts[1:]):
            yield rows.slice(a, b - a)
        held = rows.slice(cuts[-1]).combine_chunks()
    if held is not None:
        yield held


def alike(rows: pa.Table, component: np.ndarray, percent: int):
    """For each member of a group in turn: (its place, the later places of other components with agreeing signatures).

    A pair counts in the first band its members share only, and in groups of two blocks only across them.
    """
    least = percent / 100 - MARGIN
    n, block = rows.column("n_shingles").to_numpy(), rows.column("block").to_numpy()
    sig = byte_rows(rows.column("sig").to_pylist())
    bands = np.array(rows.column("bands").to_pylist(), np.int64)
    here = rows.column("band")[0].as_py()
    apart = rows.column("i")[0].as_py() != rows.column("j")[0].as_py()
    for k in range(len(n) - 1):
        rest = np.flatnonzero(component[k + 1:] != component[k]) + k + 1
        rest = rest[100 * np.minimum(n[rest], n[k]) >= percent * np.maximum(n[rest], n[k])]
        if apart:
            rest = rest[block[rest] != block[k]]
        rest = rest[agreeing(sig[rest], sig[k]) >= least] if len(rest) else rest
        if len(rest):
            first = np.argmax(bands[rest] == bands[k], axis=1)
            rest = rest[bands[k][first] == here]
        if len(rest):
            yield k, rest


GROUP = ("band", "i", "j")


def open_members(dealt: DataFrame, percent: int) -> DataFrame:
    """(band, i, j, node, component) of the members that have a partner to be confirmed."""

    def run(batches):
        for rows in by_group(batches, GROUP):
            if rows.num_rows > 1:
                component, marked = rows.column("component").to_numpy(), np.zeros(rows.num_rows, bool)
                for k, rest in alike(rows, component, percent):
                    marked[k] = marked[rest] = True
                if marked.any():
                    yield from rows.select([*GROUP, "node", "component"]).filter(pa.array(marked)).to_batches()

    return dealt.mapInArrow(run, "band long, i int, j int, node long, component long")


def joining_links(dealt: DataFrame, percent: int) -> DataFrame:
    """Confirmed pairs (x, y) that join components, a spanning set for each group."""

    def run(batches):
        for rows in by_group(batches, GROUP):
            component = rows.column("component").to_numpy().copy()
            sets = [np.frombuffer(s, np.uint64) for s in rows.column("shingles").to_pylist()]
            node, x, y = rows.column("node").to_numpy(), [], []
            for k, rest in alike(rows, component, percent):
                rest = rest[component[rest] != component[k]]
                if not len(rest):
                    continue
                flat = np.concatenate([sets[m] for m in rest])
                own = sets[k]
                at = np.minimum(np.searchsorted(own, flat), len(own) - 1)
                size = np.array([len(sets[m]) for m in rest])
                both = np.add.reduceat((own[at] == flat).astype(np.int64), offsets(size)[:-1])
                for m in rest[100 * both >= percent * (size + len(own) - both)]:
                    if component[m] != component[k]:
                        component[component == component[m]] = component[k]
                        x.append(int(node[k]))
                        y.append(int(node[m]))
            if x:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], names=["x", "y"])

    return dealt.mapInArrow(run, "x long, y long")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80,
                    bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per document: id, n_shingles, cls (documents with equal sets share it), component_id, kept."""
    s = stored(signatures(docs, doc_id, text, width, bands, rows), "signatures")
    in_graph = s.filter("id is not null and cls is not null")
    # a class is known by its smallest id, the node
    reps = stored(
        in_graph.groupBy("cls").agg(F.min("id").alias("node"), F.first("sig").alias("sig"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands")), "classes"
    )
    keyed = reps.select(F.explode("bands").alias("band"), "node")
    shared = keyed.groupBy("band").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    buckets = stored(keyed.join(shared, "band"), "buckets")

    mates = buckets.groupBy("node").agg(F.sum("size").alias("mates"))
    leaders = buckets.join(mates, "node").groupBy("band").agg(F.max(F.struct("mates", "node")).alias("top")).select("band", F.col("top.node").alias("leader"))
    led = stored(buckets.join(leaders, "band").filter("node <> leader").select("band", "node", "leader"), "led")
    released(buckets)
    pairs = led.select(F.least("leader", "node").alias("x"), F.greatest("leader", "node").alias("y")).distinct()
    likely = stored(similar_signatures(pairs, reps, percent), "pairs")
    sets = full_sets(docs, likely.select(F.col("x").alias("node")).unionAll(likely.select("y")), doc_id, text, width)
    links = stored(confirmed(likely, sets, percent), "links")
    released(likely, sets)

    copies = in_graph.select("cls", "id").join(reps.select("cls", "node"), "cls").filter("id <> node").select(F.col("id").alias("u"), F.col("node").alias("v"))
    found = components(links.select(F.col("x").alias("u"), F.col("y").alias("v")).unionAll(copies))
    released(links)

    # buckets whose members, the leader aside, still lie in different components
    placed = stored(led.select("band", "node").join(found, "node", "left").select("band", "node", F.coalesce("component", "node").alias("component")), "placed")
    released(led)
    mixed = placed.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("size")).filter("lo < hi").select("band", "size")
    own = reps.select("node", "sig", "n_shingles", "bands")
    waiting = stored(open_members(in_blocks(placed.join(mixed, "band").join(own, "node")), percent).select("band", "node", "component").distinct(), "open")
    released(placed)
    with cleaned(s.sparkSession):
        over = waiting.isEmpty()
    if not over:
        sets = full_sets(docs, waiting.select("node"), doc_id, text, width)
        sizes = waiting.groupBy("band").agg(F.count(F.lit(1)).alias("size"))
        again = waiting.join(sizes, "band").join(own, "node").join(sets, "node")
        more = stored(joining_links(in_blocks(again), percent), "links")
        released(sets)
        before = found
        # the components so far are stars, which is shorter than their links
        found = components(before.select(F.col("node").alias("u"), F.col("component").alias("v")).unionAll(more.select(F.col("x").alias("u"), F.col("y").alias("v"))))
        released(before, more)
    released(waiting, reps)
    out = stored(s.drop("sig", "bands").join(found.withColumnRenamed("node", "id"), "id", "left"), "near")
    released(s, found)
    return (
        out.select(F.col("id").alias(doc_id), "n_shingles", "cls", F.coalesce("component", "id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col(doc_id) == F.col("component_id"), F.lit(True)))
    )


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """The documents left when one of each group, the one with the smallest id, stays; rows with null ids stay.

    Repeated rows of a kept id all stay (they are one document).
    """
    gone = near_duplicates(docs, doc_id, text, width, percent).filter("not kept").select(F.col(doc_id).alias("__gone")).distinct()
    return docs.join(gone, docs[doc_id] == gone["__gone"], "left_anti")
