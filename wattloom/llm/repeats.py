"""Substring dedup by level-wise doubling: every word covered by a window of ``width`` words that occurs elsewhere goes.

Level 1 looks at short windows (a quarter of ``width``), level 2 at windows twice as long, and so on up to ``width``; only what
was repeated at one length is extended to twice that length. At the levels below ``width`` not all windows are counted: each
``width``-window is represented by the least-named short window inside it. Equal long windows have equal representatives, so a
long window whose representative is met once in the corpus cannot be repeated and is given up, with about two of 28 places
counted. At the last level every surviving window is counted, so the outcome is exact (64-bit names: a chance collision
among 10^9 surviving windows has a probability of 3 %, and removes one window).

After level 1 equal stretches of text are one form with a count. A form met twice is repeated all over and is only counted from
then on, as others may share parts of it; the other forms are cut down level by level. Names are counted with map-side combining and joined
back, so a window met in a third of all documents makes no large group. Texts are shuffled twice, to meet the
survivors of level 1 and what is to be removed; in between, stretches travel as word hashes. ``longest_repeats`` goes on doubling past
``width`` until no candidates survive.

Null and empty texts have no words. Repeated rows count as occurrences each. Extra columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import KEY, as_bytes, covered, map_arrow, row_key, signed, stored, window_names, word_hashes

WIDTH = 35
SPOT = f"{KEY} string, name long, at int"


def levels(width: int) -> list[int]:
    """Window lengths, each about twice the one before, ending at ``width``."""
    out = [width]
    while out[0] > 9:
        out.insert(0, -(-out[0] // 2))
    return out


def extreme(values: np.ndarray, span: int, of) -> np.ndarray:
    """Minimum or maximum of every ``span`` neighbours, by doubling."""
    have = 1
    while have < span:
        step = min(have, span - have)
        values, have = of(values[:-step], values[step:]), have + step
    return values


def least_names(words: np.ndarray, short: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(names of the short windows, for each ``width``-window the least name in it)."""
    names = window_names(words, short)
    return names, extreme(names, width - short + 1, np.minimum) if len(words) >= width else names[:0]


def spots(words: np.ndarray, short: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Names and places of the windows counted at a level, each place once: the least ones of some ``width``-window."""
    names, least = least_names(words, short, width)
    if not len(least):
        return least, np.zeros(0, np.int64)
    pad = np.zeros(width - short, np.uint64)
    at = np.flatnonzero(extreme(np.concatenate([pad, least, pad]), width - short + 1, np.maximum) == names)
    return names[at], at


def surviving(words: np.ndarray, repeated: np.ndarray, short: int, width: int) -> np.ndarray:
    """Mask of the words in ``width``-windows whose representative is at a repeated place."""
    names, least = least_names(words, short, width)
    return covered(len(words), np.flatnonzero(np.isin(least, names[repeated])), width)


def stretches(mask: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def counted(places: DataFrame, key: str, weight: str | None = None) -> DataFrame:
    """(key, at as a list) of the places whose name occurs more than once; with a weight, of those of weight 1."""
    times = F.count(F.lit(1)) if weight is None else F.sum(weight)
    again = places.groupBy("name").agg(times.alias("n")).filter("n > 1").select("name")
    asked = places if weight is None else places.filter(F.col(weight) == 1)
    return asked.join(again, "name", "left_semi").groupBy(key).agg(F.collect_set("at").alias("at"))


def places_in_texts(rows: DataFrame, short: int, width: int) -> DataFrame:
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [spots(word_hashes(t), short, width) for t in batch.column(1).to_pylist()]
        which = np.repeat(np.arange(len(found)), [len(f[0]) for f in found])
        return pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(which)), signed(np.concatenate([f[0] for f in found])), pa.array(np.concatenate([f[1] for f in found]).astype(np.int32))],
            names=[KEY, "name", "at"])

    return map_arrow(rows, run, SPOT, "t")


PART = f"{KEY} string, first int, words binary, form binary"


def parts_of(keys: list, firsts: list, masks: list[np.ndarray], words: list[np.ndarray]) -> pa.RecordBatch:
    """The masked stretches as rows (key, first, words, form); the form names the content."""
    out: tuple[list, ...] = ([], [], [], [])
    for key, first, mask, own in zip(keys, firsts, masks, words):
        for a, b in stretches(mask):
            raw = own[a:b].tobytes()
            for col, v in zip(out, (key, first + a, raw, xxhash.xxh3_128_digest(raw))):
                col.append(v)
    kinds = (pa.binary() if keys and isinstance(keys[0], bytes) else pa.string(), pa.int32(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=[KEY, "first", "words", "form"])


def first_stretches(rows: DataFrame, hits: DataFrame, short: int, width: int) -> DataFrame:
    """The stretches of text (as word hashes) that survive level 1."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = [word_hashes(t) for t in batch.column("t").to_pylist()]
        masks = [surviving(w, np.array(at), short, width) for w, at in zip(words, batch.column("at").to_pylist())]
        return parts_of(batch.column(KEY).to_pylist(), [0] * len(words), masks, words)

    return map_arrow(rows.join(hits, KEY), run, PART, "t")


FORM = "form binary, first int, words binary, times long"


def places_in_forms(forms: DataFrame, short: int, width: int) -> DataFrame:
    """Windows of a level in the surviving forms; ``at`` is the place in the form."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = []
        for first, words in zip(batch.column("first").to_pylist(), batch.column("words").to_pylist()):
            names, at = spots(np.frombuffer(words, np.uint64), short, width)
            found.append((names, at + first))
        which = pa.array(np.repeat(np.arange(len(found)), [len(f[0]) for f in found]))
        return pa.RecordBatch.from_arrays(
            [batch.column("form").take(which), signed(np.concatenate([f[0] for f in found])), pa.array(np.concatenate([f[1] for f in found]).astype(np.int32)), batch.column("times").take(which)],
            names=["form", "name", "at", "times"])

    return map_arrow(forms, run, "form binary, name long, at int, times long", "words")


def next_forms(forms: DataFrame, hits: DataFrame, short: int, width: int) -> DataFrame:
    """What of the forms met once survives a level."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = [np.frombuffer(w, np.uint64) for w in batch.column("words").to_pylist()]
        firsts, masks = batch.column("first").to_pylist(), []
        for own, first, at in zip(words, firsts, batch.column("at").to_pylist()):
            at = np.array(at) - first
            masks.append(surviving(own, at[(at >= 0) & (at <= len(own) - short)], short, width))
        out = parts_of(batch.column("form").to_pylist(), firsts, masks, words)
        return pa.RecordBatch.from_arrays([*out.columns[:3], pa.array(np.ones(out.num_rows, np.int64))], names=["form", "first", "words", "times"])

    return map_arrow(forms.filter("times = 1").join(hits, "form"), run, FORM, "words")


def level(forms: DataFrame, short: int, width: int) -> DataFrame:
    """The forms left after a level: those met once cut down, the others whole."""
    places = stored(places_in_forms(forms, short, width), "places")
    hits = counted(places, "form", "times")
    return stored(next_forms(forms, hits, short, width).unionByName(forms.filter("times > 1").select("form", "first", "words", "times")), "forms")


def survivors(docs: DataFrame, doc_id: str, text: str, short: int, width: int) -> tuple[DataFrame, DataFrame]:
    """After level 1: the stretches (key, first, form) and the forms (form, first, words, times)."""
    rows = docs.select(row_key(doc_id, text).alias(KEY), as_bytes(text).alias("t"))
    places = stored(places_in_texts(rows, short, width), "places")
    hits = stored(counted(places, KEY), "hits")
    parts = stored(first_stretches(rows, hits, short, width), "stretches")
    forms = parts.groupBy("form").agg(F.lit(0).alias("first"), F.first("words").alias("words"), F.count(F.lit(1)).alias("times"))
    return parts.select(KEY, F.col("first").alias("begin"), "form"), stored(forms, "forms")


def repeated_stretches(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """(key, gone): the stretches of words, as (first, end), covered by windows of ``width`` words that occur elsewhere."""
    short, *later = levels(width)
    parts, forms = survivors(docs, doc_id, text, short, width)
    for size in later:
        forms = level(forms, size, width)
    left = forms.select("form", F.struct("first", (F.col("first") + F.length("words") / 8).cast("int").alias("end")).alias("s")).groupBy("form").agg(F.collect_list("s").alias("s"))
    moved = F.transform("s", lambda s: F.struct((F.col("begin") + s["first"]).alias("first"), (F.col("begin") + s["end"]).alias("end")))
    return parts.join(left, "form").select(KEY, moved.alias("s")).groupBy(KEY).agg(F.flatten(F.collect_set("s")).alias("gone"))


def longest_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """(length, documents): how many documents have a repeated window of ``width``, twice that, and so on while any has."""
    parts, forms = survivors(docs, doc_id, text, width, width)
    size, out = width, None
    while not (forms := forms.filter(F.length("words") >= 8 * size)).isEmpty():
        having = parts.join(forms.select("form").distinct(), "form", "left_semi").agg(F.lit(size).alias("length"), F.countDistinct(KEY).alias("documents"))
        out, size = having if out is None else out.unionAll(having), size * 2
        forms = level(forms, size, size)
    return out if out is not None else docs.sparkSession.createDataFrame([], "length int, documents long")


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_text (words joined by one space), kept_sha256."""
    gone = repeated_stretches(docs, doc_id, text, width)
    rows = docs.select(F.col(doc_id).alias("id"), row_key(doc_id, text).alias(KEY), as_bytes(text).alias("t")).join(gone, KEY, "left").select("id", "t", "gone")
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, removed, texts = [], [], []
        for text, gone in zip(batch.column("t").to_pylist(), batch.column("gone").to_pylist()):
            words = text.split()
            n.append(len(words))
            if gone:
                mask = np.ones(len(words), bool)
                for s in gone:
                    mask[s["first"]: s["end"]] = False
                words = [words[i] for i in np.flatnonzero(mask)]
            removed.append(n[-1] - len(words))
            texts.append(b" ".join(words))
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string()), pa.array([hashlib.sha256(t).hexdigest() for t in texts])],
            names=["id", "n_words", "n_removed", "kept_text", "kept_sha256"])

    return map_arrow(rows, run, f"id {kind}, n_words long, n_removed long, kept_text string, kept_sha256 string", "t").withColumnRenamed("id", doc_id)
