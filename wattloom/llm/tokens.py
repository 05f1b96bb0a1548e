"""Token ids of documents in binary files of patched frame-of-reference blocks.

Layout of a file (little endian): ``PFOR``, version, number of documents, ids and blocks, then the documents' id counts and
doc ids, the byte offset of each block, and the blocks. A block covers ``BLOCK`` ids (the last one fewer): the minimum is subtracted, the differences
are packed with the number of bits that ``PERCENTILE`` percent of them need, and the others are stored as exceptions (place and high
bits). A block can be found from the offsets and decoded without the ones before.

Files follow each other in ascending order of doc_id: texts are dealt by ranges of (doc_id, row), and each task encodes its range in order,
cutting files at ``FILE_IDS`` ids. Equal doc ids are neighbours in no particular order beyond a hash of the text; null ids come first. A null or empty text
has the end id only. One document longer than a file's worth gets a file of its own.
"""

from __future__ import annotations

import os
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from ..session import scratch_dir
from .common import as_bytes, chunked, offsets, small_batches
from .files import make_folder, read_files, write_file

BLOCK, PERCENTILE, END = 1024, 90, 1
FILE_IDS = 4 << 20
MAGIC, HEAD = b"PFOR", struct.Struct("<4sIQQQ")
BLOCK_HEAD = struct.Struct("<IHBBH")  # minimum, ids, bits, high bytes, exceptions


def pack_bits(values: np.ndarray, bits: int) -> bytes:
    """Little-endian bit packing of unsigned 32-bit values."""
    spread = np.unpackbits(values.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, count=bits, bitorder="little")
    return np.packbits(spread, bitorder="little").tobytes()


def unpack_bits(data: bytes, count: int, bits: int) -> np.ndarray:
    spread = np.zeros((count, 32), np.uint8)
    spread[:, :bits] = np.unpackbits(np.frombuffer(data, np.uint8), count=count * bits, bitorder="little").reshape(count, bits)
    return np.packbits(spread, axis=1, bitorder="little").view("<u4").reshape(-1)


def encode_block(ids: np.ndarray) -> bytes:
    low = ids.min()
    rest = ids - low
    need = np.frexp(rest.astype(np.float64))[1]  # bits of each difference
    bits = int(np.partition(need, k := (len(need) * PERCENTILE - 1) // 100)[k])
    places = np.flatnonzero(need > bits).astype(np.uint16)
    high = (rest[places].astype(np.uint64) >> np.uint64(bits)).astype(np.uint32)
    body = pack_bits(rest & np.uint32((1 << bits) - 1) if bits < 32 else rest, bits)
    return BLOCK_HEAD.pack(int(low), len(ids), bits, 4, len(places)) + body + places.tobytes() + high.tobytes()


def decode_block(data: bytes, at: int) -> np.ndarray:
    low, n, bits, _, k = BLOCK_HEAD.unpack_from(data, at)
    at += BLOCK_HEAD.size
    end = at + (n * bits + 7) // 8
    rest = unpack_bits(data[at:end], n, bits)
    places = np.frombuffer(data, np.uint16, k, end)
    high = np.frombuffer(data[end + 2 * k: end + 6 * k], np.uint32)
    rest[places] |= (high.astype(np.uint64) << np.uint64(bits)).astype(np.uint32)
    return rest + np.uint32(low)


def encode_file(doc_ids: list[int | None], counts: list[int], ids: np.ndarray) -> bytes:
    blocks = [encode_block(ids[i: i + BLOCK]) for i in range(0, len(ids), BLOCK)]
    known = np.array([d is not None for d in doc_ids], np.uint8)
    index = offsets([len(b) for b in blocks])
    return b"".join([HEAD.pack(MAGIC, 1, len(doc_ids), len(ids), len(blocks)), np.array(counts, np.uint64).tobytes(),
                     np.array([d or 0 for d in doc_ids], np.int64).tobytes(), known.tobytes(), index.astype(np.uint64).tobytes(), *blocks])


def ids_in(head: bytes) -> int:
    """Number of ids of a file, from its header."""
    return HEAD.unpack(head)[3]


class Reader:
    """Random access to the ids of one file."""

    def __init__(self, data: bytes):
        self.data = data
        magic, version, docs, self.n_ids, blocks = HEAD.unpack_from(data)
        if magic != MAGIC or version != 1:
            raise ValueError("not a token file")
        at = HEAD.size
        self.counts = np.frombuffer(data, np.uint64, docs, at).astype(np.int64)
        self.doc_ids = np.frombuffer(data, np.int64, docs, at + 8 * docs)
        self.known = np.frombuffer(data, np.uint8, docs, at + 16 * docs).astype(bool)
        self.index = np.frombuffer(data[at + 17 * docs: at + 17 * docs + 8 * (blocks + 1)], np.uint64)
        self.first = at + 17 * docs + 8 * (blocks + 1)

    def ids(self, start: int = 0, end: int | None = None) -> np.ndarray:
        """The ids from place ``start`` to ``end``; only the blocks in between are decoded."""
        end = self.n_ids if end is None else end
        if end <= start:
            return np.zeros(0, np.uint32)
        lo, hi = start // BLOCK, (end - 1) // BLOCK
        flat = np.concatenate([decode_block(self.data, self.first + int(self.index[b])) for b in range(lo, hi + 1)])
        return flat[start - lo * BLOCK: end - lo * BLOCK]


SPACES, LETTERS, SIGNS, OTHERS = range(4)
KINDS = np.full(256, OTHERS, np.uint8)
KINDS[[32, *range(9, 14)]] = SPACES
KINDS[[*range(97, 123), *range(65, 91)]] = LETTERS
KINDS[[c for c in range(33, 127) if KINDS[c] == OTHERS and c != 39 and not 48 <= c < 58]] = SIGNS


def kinds_of(data: np.ndarray) -> np.ndarray:
    """The kind of every byte of UTF-8; of the letters beyond ASCII, those from U+00C0 to U+00FF are plain."""
    kinds = KINDS[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)
    tail = data[lead + 1]
    lead = lead[(tail != 0x97) & (tail != 0xB7)]  # signs for times and division
    kinds[lead] = kinds[lead + 1] = LETTERS
    return kinds


def cut_pieces(texts: list[bytes]) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The pieces of all texts in order, and how many each text has: runs of letters, runs of signs, and whole words with anything else."""
    data = np.frombuffer(b" ".join([b"", *texts, b""]).lower(), np.uint8)
    kinds = kinds_of(data)
    inside = kinds != SPACES
    word = np.cumsum(inside[1:] & ~inside[:-1], dtype=np.int32)  # of the bytes from the second on
    odd = np.zeros(int(word[-1]) + 1, bool) if len(word) else np.zeros(1, bool)
    odd[word[kinds[1:] == OTHERS]] = True
    kinds[1:][odd[word] & inside[1:]] = OTHERS
    starts = np.flatnonzero(inside[1:] & (kinds[1:] != kinds[:-1])) + 1
    place = np.cumsum(inside, dtype=np.int32)
    ends = np.append(place[starts] - 1, place[-1]).astype(np.int32)
    flat = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(data[inside])])
    first = 1 + offsets([len(t) + 1 for t in texts])
    return flat.dictionary_encode(), np.diff(np.searchsorted(starts, first))


class Encoder:
    """Whole texts to ids with a ``tokenizers`` file; what it gives for a piece of text is kept for the next time.

    The vocabulary drops white space, lower-cases, and never joins across white space or between letters and signs. So a text's
    ids are those of its pieces: runs of plain letters, runs of plain signs, and whole words that hold anything else. Texts with
    what may be a special token are encoded in one go.
    """

    LETTERS = re.compile("[a-zÀ-ÖØ-öø-ÿ]+")
    CACHED, TOGETHER = 400_000, 200

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[bytes, bytes] = {}  # ids as little-endian unsigned 32-bit integers

    def single(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece."""
        out = self.tokenizer.encode_batch_fast([p.decode() for p in pieces], add_special_tokens=False)
        return [struct.pack(f"<{len(ids := e.ids)}I", *ids) for e in out]

    def together(self, runs: list[bytes]) -> list[bytes]:
        """The ids of each run of letters, from one text of them; the tokenizer tells to which word an id belongs."""
        e = self.tokenizer.encode(b" ".join(runs).decode(), add_special_tokens=False)
        words = np.array(e.word_ids, np.int64)
        cuts = np.flatnonzero(words[1:] != words[:-1]) + 1
        if len(cuts) + 1 != len(runs) or words[0] != 0 or words[-1] != len(runs) - 1:
            return self.single(runs)
        ids = np.array(e.ids, "<u4").tobytes()
        at = [0, *(4 * cuts).tolist(), len(ids)]
        return [ids[a:b] for a, b in zip(at, at[1:])]

    def learn(self, new: list[bytes]) -> None:
        runs, rest = [], []
        for p in new:
            (runs if p.isalpha() or self.LETTERS.fullmatch(p.decode()) else rest).append(p)
        for some, step, how in ((runs, self.TOGETHER, self.together), (rest, 4096, self.single)):
            for i in range(0, len(some), step):
                self.known.update(zip(some[i: i + step], how(some[i: i + step])))

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of whole texts."""
        plain = [t if b"<|" not in t else b"" for t in texts]
        pieces, counts = cut_pieces(plain)
        distinct = pieces.dictionary.to_pylist()
        new = [p for p in distinct if p not in self.known]
        self.learn(new)
        ids = list(map(self.known.__getitem__, distinct))
        sizes = np.array([len(b) for b in ids], np.int64) // 4
        flat, first = np.frombuffer(b"".join(ids), "<u4"), offsets(sizes)
        which = pieces.indices.to_numpy()
        own = sizes[which]
        ends = offsets(own)
        out = flat[np.repeat(first[which] - ends[:-1], own) + np.arange(ends[-1])]
        cuts = ends[offsets(counts)]
        if len(self.known) > self.CACHED:  # what came first is met most often and stays
            for p in new:
                del self.known[p]
        return [np.frombuffer(self.single([t])[0], "<u4") if b"<|" in t else out[a:b] for t, a, b in zip(texts, cuts[:-1], cuts[1:])]


_encoders: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    """The worker's encoder: later tasks of the same worker find its pieces known."""
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = Encoder(path)
    return _encoders[path]


def write_tokens(docs: DataFrame, path: str, folder: str, doc_id: str = "doc_id", text: str = "text", end_id: int = END) -> None:
    """Encode ``docs`` and write files ``tokens-<partition>-<number>.pfor`` into ``folder``."""
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), as_bytes(text).alias("t"))
    ordered = rows.repartitionByRange("id", F.xxhash64("t")).sortWithinPartitions("id", F.xxhash64("t"))
    tokenizer = path

    def run(batches):
        encoder, part = encoder_of(tokenizer), TaskContext.get().partitionId()
        names, counts, ids, held, number = [], [], [], 0, 0

        def flush():
            nonlocal names, counts, ids, held, number
            write_file(folder, f"tokens-{part:07d}-{number:05d}.pfor", encode_file(names, counts, np.concatenate(ids)))
            done = pa.RecordBatch.from_arrays([pa.array([number], pa.int64())], names=["n"])
            names, counts, ids, held, number = [], [], [], 0, number + 1
            return done

        for batch in chunked(batches, "t", 1 << 20):
            for name, own in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1).to_pylist())):
                if held and held + len(own) >= FILE_IDS:
                    yield flush()
                names.append(name)
                counts.append(len(own) + 1)
                ids.append(np.append(own, np.uint32(end_id)))
                held += len(own) + 1
        if held:
            yield flush()

    small_batches(ordered).mapInArrow(run, "n long").write.format("noop").mode("overwrite").save()


def read_tokens(spark, folder: str) -> DataFrame:
    """One row per document: doc_id, start, n_tokens, ids_crc32, from the files alone."""

    def run(batches):
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                part, number = map(int, path.rsplit("/", 1)[1][7:-5].split("-"))
                r = Reader(data)
                starts = offsets(r.counts)
                flat = r.ids()
                crc = [zlib.crc32(flat[a:b].astype("<u4").tobytes()) for a, b in zip(starts[:-1], starts[1:])]
                n = len(crc)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * n, pa.int64()), pa.array([number] * n, pa.int64()), pa.array(r.doc_ids, mask=~r.known), pa.array(starts[:-1]), pa.array(r.counts), pa.array(crc, pa.int64())],
                    names=["part", "number", "doc_id", "within", "n_tokens", "ids_crc32"])

    rows = read_files(spark, folder, "*.pfor").mapInArrow(run, "part long, number long, doc_id long, within long, n_tokens long, ids_crc32 long")
    return rows


def file_starts(spark, folder: str) -> DataFrame:
    """(part, number, before): ids in all files before a file. Files are summed by partition first; one row per partition is ordered."""

    def run(batches):
        for batch in batches:
            at = [tuple(map(int, p.rsplit("/", 1)[1][7:-5].split("-"))) for p in batch.column(0).to_pylist()]
            n = [ids_in(h) for h in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in at], pa.int64()), pa.array([b for _, b in at], pa.int64()), pa.array(n, pa.int64())], names=["part", "number", "n"])

    heads = read_files(spark, folder, "*.pfor").select("path", F.expr(f"substring(content, 1, {HEAD.size})").alias("head")).mapInArrow(run, "part long, number long, n long")
    inside = Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = heads.groupBy("part").agg(F.sum("n").alias("n")).select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    files = heads.select("part", "number", F.coalesce(F.sum("n").over(inside), F.lit(0)).alias("ahead"))
    return files.join(parts, "part").select("part", "number", (F.col("ahead") + F.col("base")).alias("before"))


def token_index(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", folder: str | None = None) -> DataFrame:
    """Write the ids of ``docs`` and give one row per document read back: doc_id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    folder = make_folder(folder or scratch_dir(spark, "tokens"))
    write_tokens(docs, path, folder, doc_id, text)
    return (
        read_tokens(spark, folder).join(file_starts(spark, folder), ["part", "number"])
        .select(F.col("doc_id").alias(doc_id), (F.col("before") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")
    )
