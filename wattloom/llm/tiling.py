"""Benchmark decontamination by greedy string tiling.

Seeds are windows of ``min_match`` words (A-Z lower-cased). A bitmap of fixed size of the benchmark's seeds drops most of
the documents' seeds where they arise; what passes is joined with the benchmark's seeds exactly. A pair of document and item goes on if its
shared seeds could cover the item well enough. The pair is then tiled: running Karp-Rabin matching finds the longest
unmarked common runs of words, longest first; each is marked on both sides and the search goes on with shorter ones, down to
``min_match`` words. Tiles may be in any order, so reordered passages are caught. An item is leaked if tiles cover
``percent`` of its words.

Items with fewer than ``min_match`` words are one seed as a whole and match as such. Null and empty texts and items match nothing. Repeated
documents are judged each, repeated item ids are separate items joined to one result row by the larger coverage. Extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import KEY, LEFT, RIGHT, as_bytes, covered, map_arrow, mix, row_key, signed, stored, window_names, word_hashes

BITS, BLOCK = 1 << 27, 1 << 16  # the bitmap is 16 MB whatever the benchmark's size
MIN_MATCH, PERCENT = 5, 60


def words_of(text: bytes) -> np.ndarray:
    return word_hashes(text.lower())


def seeds_of(words: np.ndarray, width: int) -> np.ndarray:
    return mix(window_names(words, width) + np.uint64(width))


def item_seeds(bench: DataFrame, item_id: str, text: str, min_match: int) -> DataFrame:
    """(seed, item, width, words) for every seed place of the items; ``width`` is below ``min_match`` for short items."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        items, seeds, widths, lengths = [], [], [], []
        for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = words_of(text)
            width = min(min_match, len(words))
            if width:
                own = seeds_of(words, width)
                seeds.append(own)
                for col, v in ((items, item), (widths, width), (lengths, len(words))):
                    col.extend([v] * len(own))
        flat = np.concatenate(seeds) if seeds else np.zeros(0, np.uint64)
        return pa.RecordBatch.from_arrays([signed(flat), pa.array(items, pa.string()), pa.array(widths, pa.int32()), pa.array(lengths, pa.int32())], names=["seed", "item", "width", "n_words"])

    rows = bench.select(row_key(item_id, text).alias("item"), as_bytes(text).alias("t"))
    return map_arrow(rows, run, "seed long, item string, width int, n_words int", "t")


def bitmap(seeds: DataFrame, bits: int = BITS) -> np.ndarray:
    """The seeds' bitmap: blocks of 8 KB are put together in tasks, at most ``bits / 65536`` of them reach the driver."""
    at = seeds.select(F.pmod(F.col("seed"), F.lit(bits)).alias("p")).distinct().select(F.shiftright("p", 16).alias("block"), (F.col("p") % BLOCK).cast("int").alias("p"))
    rows = at.groupBy("block").agg(F.collect_list("p").alias("ps"))  # 65536 numbers at most

    def run(batches):
        for batch in batches:
            maps = []
            for ps in batch.column(1).to_pylist():
                one = np.zeros(BLOCK, np.uint8)
                one[ps] = 1
                maps.append(np.packbits(one).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(maps, pa.binary())], names=["block", "map"])

    whole = np.zeros((bits // BLOCK, BLOCK // 8), np.uint8)
    for row in rows.mapInArrow(run, "block long, map binary").toLocalIterator():
        whole[row["block"]] = np.frombuffer(row["map"], np.uint8)
    return whole.reshape(-1)


def possible(seeds: np.ndarray, bits: np.ndarray) -> np.ndarray:
    at = (seeds.view(np.int64) % (len(bits) * 8)).astype(np.int64)
    return (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1


def tile(doc: np.ndarray, item: np.ndarray, min_match: int) -> np.ndarray:
    """Mask of the item's words covered by greedy string tiling of two word sequences.

    The longest common runs of unmarked words are marked first, the earliest in the item and then in the document winning
    ties, until no run of ``min_match`` words is left (the whole item, if it is shorter). Matching starts with long windows.
    """
    marked_doc, marked = np.zeros(len(doc), bool), np.zeros(len(item), bool)
    shortest = min(min_match, len(item))
    size = max(shortest, min(len(item), 4 * shortest))
    while shortest:
        matches = _matches(doc, item, marked_doc, marked, size)
        if not matches:
            if size == shortest:
                break
            size = max(shortest, size // 2)
            continue
        longest = max(m[0] for m in matches)
        for _, p, q in sorted(m for m in matches if m[0] == longest):
            if not marked[p: p + longest].any() and not marked_doc[q: q + longest].any():
                marked[p: p + longest] = marked_doc[q: q + longest] = True
    return marked


def _matches(doc, item, marked_doc, marked, size: int) -> list[tuple[int, int, int]]:
    """Maximal common runs of ``size`` unmarked words or more: (length, item place, document place)."""
    def free(m):
        upto = np.concatenate([[0], np.cumsum(m)])
        return np.flatnonzero(upto[size:] == upto[:-size])

    here, there = free(marked), free(marked_doc)
    a, b = window_names(item, size), window_names(doc, size)
    starts: dict[int, list[int]] = {}
    for p in here:
        starts.setdefault(int(a[p]), []).append(int(p))
    found = []
    for q in there[np.isin(b[there], a[here])].tolist():
        for p in starts[int(b[q])]:
            if p and q and item[p - 1] == doc[q - 1] and not marked[p - 1] and not marked_doc[q - 1]:
                continue  # the run begins earlier
            k = size
            while p + k < len(item) and q + k < len(doc) and item[p + k] == doc[q + k] and not marked[p + k] and not marked_doc[q + k]:
                k += 1
            found.append((k, p, q))
    return found


def near_parts(doc: np.ndarray, item: np.ndarray, width: int) -> np.ndarray:
    """The document cut down to what shared windows of ``width`` words cover, parts set apart by a word of their own.

    Common runs of that length lie within these parts, so tiling finds the same.
    """
    if not width or len(doc) < width:
        return doc[:0]
    keep = covered(len(doc), np.flatnonzero(np.isin(window_names(doc, width), window_names(item, width))), width)
    ends = np.zeros(len(doc), bool)
    ends[1:] = ~keep[1:] & keep[:-1]
    out = doc.copy()
    out[ends] = mix(out[ends] + LEFT) ^ RIGHT  # not a word of the item
    return out[keep | ends]


def leaks(docs: DataFrame, bench: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
          min_match: int = MIN_MATCH, percent: int = PERCENT) -> DataFrame:
    """One row per leaked pair: ``KEY`` of the document, doc_id, item_id, item_words, covered_words."""
    places = stored(item_seeds(bench, item_id, item_text, min_match), "seeds")
    bits = docs.sparkSession.sparkContext.broadcast(bitmap(places))
    widths = sorted(r[0] for r in places.select("width").distinct().collect())  # min_match values at most

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        kept, found = [], []
        for i, t in enumerate(batch.column(1).to_pylist()):
            words = words_of(t)
            own = [s[possible(s, bits.value)] for s in (seeds_of(words, w) for w in widths if len(words) >= w)]
            if any(map(len, own)):
                kept.append(i)
                found.append(np.unique(np.concatenate(own)).view(np.int64))
        if not kept:
            return None
        part = batch.take(pa.array(kept))
        return pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.list_(pa.int64()))], names=[KEY, "t", "id", "seeds"])

    rows = docs.select(row_key(doc_id, text).alias(KEY), as_bytes(text).alias("t"), F.col(doc_id).alias("id"))
    kind = docs.schema[doc_id].dataType.simpleString()
    likely = stored(map_arrow(rows, run, f"{KEY} string, t binary, id {kind}, seeds array<long>", "t"), "likely")

    seen = likely.select(KEY, "seeds").dropDuplicates([KEY]).select(KEY, F.explode("seeds").alias("seed"))
    shared = places.groupBy("seed", "item", "width", "n_words").agg(F.count(F.lit(1)).alias("places")).join(seen, "seed")
    pairs = (
        shared.groupBy(KEY, "item")
        .agg(F.sum(F.col("places") * F.col("width")).alias("reach"), F.first("n_words").alias("n_words"))
        .filter(F.col("reach") * 100 >= F.col("n_words") * percent)
        .select(KEY, "item")
    )
    items = bench.select(row_key(item_id, item_text).alias("item"), F.col(item_id).alias("item_id"), as_bytes(item_text).alias("item_text")).distinct()
    texts = pairs.join(items, "item").join(likely.drop("seeds"), KEY)

    def judge(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, got = [], []
        for d, b in zip(batch.column("t").to_pylist(), batch.column("item_text").to_pylist()):
            doc, item = words_of(d), words_of(b)
            n.append(len(item))
            got.append(int(tile(near_parts(doc, item, min(min_match, len(item))), item, min_match).sum()))
        own = batch.select([KEY, "id", "item_id"])
        return pa.RecordBatch.from_arrays([*own.columns, pa.array(n, pa.int64()), pa.array(got, pa.int64())], names=[KEY, "id", "item_id", "item_words", "covered_words"])

    item_kind = bench.schema[item_id].dataType.simpleString()
    tiled = map_arrow(texts.select(KEY, "id", "item_id", "t", "item_text"), judge, f"{KEY} string, id {kind}, item_id {item_kind}, item_words long, covered_words long", "t")
    return tiled.filter(F.col("covered_words") * 100 >= F.col("item_words") * percent).withColumnRenamed("id", doc_id)


def without_leaks(docs: DataFrame, bench: DataFrame, doc_id: str = "doc_id", text: str = "text", **parameters) -> DataFrame:
    """The rows of ``docs`` that leak no item, with their columns."""
    gone = leaks(docs, bench, doc_id, text, **parameters).select(F.col(KEY).alias("__gone")).distinct()
    return docs.join(gone, row_key(doc_id, text) == gone["__gone"], "left_anti")
