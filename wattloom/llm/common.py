"""Helpers shared by the text operators: row keys, word hashes, window hashes, stored intermediates.

Words are runs of characters other than space and the ASCII controls 9-13; ``bytes.split()`` cuts UTF-8 at exactly
these. All hashes are 64-bit and depend on the bytes only, never on partitioning.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..session import scratch_dir

KEY = "__key"
CHUNK_BYTES = 4 << 20
ARROW_ROWS = 1000

M1, M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
LEFT, RIGHT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
S33 = np.uint64(33)


def table(spark, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


_places: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


@contextmanager
def cleaned(spark):
    """Spark removes the shuffle files of queries that are put together and run inside as soon as they end."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def stored(df: DataFrame, label: str) -> DataFrame:
    """The frame as a table in the shared folder: computed once, lineage cut, real size known to the planner.

    Spark removes the shuffle files of this step when the table is written; nothing reads them again.
    """
    spark = df.sparkSession
    path = scratch_dir(spark, label)
    with cleaned(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _places[out] = path
    return out


def released(*tables: DataFrame) -> None:
    """Removes stored tables; no frame that is still to be computed may read them."""
    for t in tables:
        if place := _places.pop(t, None):
            spark = t.sparkSession
            path = spark._jvm.org.apache.hadoop.fs.Path(place)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """Identifies a row by id and text, so that repeated and null ids keep their own results."""
    return F.concat_ws(":", F.coalesce(F.col(doc_id).cast("string"), F.lit("-")), F.hex(F.xxhash64(F.col(text))))


def as_bytes(text: str = "text") -> Column:
    return F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")


def chunked(batches: Iterator[pa.RecordBatch], by: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut so that column ``by`` holds about ``limit`` bytes each (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(by)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, "right")))
            yield batch.slice(at, to - at)
            at = to


def small_batches(df: DataFrame) -> DataFrame:
    """Texts may be long: the session's Arrow batches are held at ``ARROW_ROWS`` rows."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return df


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema, by: str, limit: int = CHUNK_BYTES) -> DataFrame:
    """``mapInArrow`` over small batches; ``fn`` may return None for no rows."""
    small_batches(df)

    def run(batches):
        for chunk in chunked(batches, by, limit):
            out = fn(chunk)
            if out is not None and out.num_rows:
                yield out

    return df.mapInArrow(run, schema)


BITS = 1 << 24


def bits_of(values: DataFrame, place: Column) -> Broadcast:
    """A broadcast bit array of ``BITS`` (2 MB, whatever the data) with the bit at ``place`` (0 to BITS - 1) of every row set.

    Rows elsewhere are passed over where they lie unless their bit is set, so large columns are not shuffled to find out; what passes by
    chance is left to an exact join. Destroy it when the step is stored.
    """
    at = place.cast("long") + 1
    with cleaned(values.sparkSession):
        maps = values.groupBy(F.bitmap_bucket_number(at).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")).collect()
    out = np.zeros((BITS >> 15, 1 << 12), np.uint8)
    for r in maps:
        out[r["part"] - 1] = np.frombuffer(r["bits"], np.uint8)
    return values.sparkSession.sparkContext.broadcast(out.ravel())


def has_bit(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def with_word_counts(df: DataFrame, text: str, out: str) -> DataFrame:
    """``df`` with the number of words of ``text`` (0 for null) in place of ``text``."""
    others = [c for c in df.columns if c != text]
    schema = T.StructType([*[df.schema[c] for c in others], T.StructField(out, T.LongType())])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts = [len(t.split()) for t in batch.column(0).to_pylist()]
        return pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(counts, pa.int64())], names=[*others, out])

    return map_arrow(df.select(as_bytes(text).alias("__bytes"), *others), run, schema, "__bytes")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> S33)) * M1
    x = (x ^ (x >> S33)) * M2
    return x ^ (x >> S33)


SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
BYTES = mix(np.arange(1, 257, dtype=np.uint64) * RIGHT)
BASE = 0x2545F4914F6CDD1D  # 5 mod 8
BLOCK_BYTES = 1 << 20
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and its inverse for i below ``n``, modulo 2 ** 64; kept and grown as needed."""
    if not _powers or len(_powers[0]) < n:
        size = 1 << max(12, (n - 1).bit_length())
        _powers[:] = []
        for factor in (BASE, pow(BASE, -1, 1 << 64)):
            steps = np.full(size, factor, np.uint64)
            steps[0] = 1
            _powers.append(np.multiply.accumulate(steps))
    return _powers[0], _powers[1]


def word_hashes(text: bytes) -> np.ndarray:
    """64-bit hashes of the words of a text: polynomials over random values of the bytes, from one running sum."""
    if len(text) > 2 * BLOCK_BYTES:
        cut = max(text.rfind(s, 0, BLOCK_BYTES) for s in SPACE_BYTES)
        if cut < 0:
            cut = min([k for s in SPACE_BYTES if (k := text.find(s)) >= 0], default=len(text))
        blocks, at = [], 0
        while at < len(text):
            blocks.append(_block_hashes(text[at: cut]))
            at, end = cut, cut + BLOCK_BYTES
            cut = max(text.rfind(s, at + 1, end) for s in SPACE_BYTES) if end < len(text) else len(text)
            if cut < 0:
                cut = min([k for s in SPACE_BYTES if (k := text.find(s, at + 1)) >= 0], default=len(text))
        return np.concatenate(blocks)
    return _block_hashes(text)


SPACE_BYTES = [bytes([c]) for c in (32, *range(9, 14))]


def _block_hashes(text: bytes) -> np.ndarray:
    data = np.frombuffer(text, np.uint8)
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~SPACE[data]
    edges = np.diff(inside)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTES[data] * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def window_names(hashes: np.ndarray, width: int) -> np.ndarray:
    """64-bit names of all windows of ``width`` words: windows of twice the length are made of two; the last step overlaps.

    Each step adds the right half times an odd factor of its own, so a name is a sum of word hashes with different factors.
    """
    names, have, factor = hashes, 1, LEFT
    while have < width:
        step = min(have, width - have)
        names = names[:-step] + names[step:] * factor if len(names) > step else names[:0]
        have, factor = have + step, np.uint64(int(factor) * int(RIGHT) % (1 << 64))
    return mix(names) if width > 1 else names


def signed(a: np.ndarray) -> pa.Array:
    return pa.array(a.view(np.int64))


def per_row(lengths: np.ndarray) -> np.ndarray:
    """Row number for each of the concatenated elements."""
    return np.repeat(np.arange(len(lengths)), lengths)


def offsets(lengths) -> np.ndarray:
    out = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


def covered(n: int, starts: np.ndarray, width: int) -> np.ndarray:
    """Mask of the ``n`` positions lying in a window of ``width`` that begins at one of ``starts``."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + width, n), -1)
    return np.cumsum(edge[:-1]) > 0


def grouped(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[tuple[tuple[int, ...], pa.Table]]:
    """(key, rows) of each group, from batches sorted by whole-numbered ``keys``; a group may span batches."""
    held: list[pa.RecordBatch] = []
    now: tuple[int, ...] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        at = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in keys])
        cuts = [0, *(np.flatnonzero((at[:, 1:] != at[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            key = tuple(at[:, a].tolist())
            if key != now and held:
                yield now, pa.Table.from_batches(held)
                held = []
            now = key
            held.append(batch.slice(a, b - a))
    if held:
        yield now, pa.Table.from_batches(held)
