"""Spelling variants: words one edit apart, found by a trie over letter-group counts, and the frequent form each word belongs to.

1. ``word_counts`` takes the letter runs of whole texts; counts combine inside the tasks, then by word.
2. A word's frequency vector holds its count of each letter group of ``GROUPS``. The trie branches by these counts, one group a level.
   An edit adds one to a group (surplus), takes one from a group (deficit), or both, or moves nothing.
3. ``routed``: the first ``TOP`` levels, counts clipped at ``CLIP``, have at most 65,536 nodes. Subtrees of at most ``SUBTREE`` words
   are cut off there and dealt to tasks; a word belongs to one and is sent as a query to all its budget reaches.
   A subtree that is still larger at the last of these levels is dealt on by equal word halves (see 5): no word is left out.
4. ``near_words``: each task sorts its words into a trie and searches it depth first with all its queries at once; a query spends
   a surplus and a deficit of one each on the way down. At leaves of ``LEAF`` words the words left are verified.
5. Two words one edit apart, the shorter of m code points, share the first m // 2 or the last m - m // 2 code points: hashes of these
   halves are compared first, then the words themselves.
6. ``forms`` keeps the near word of largest count, ``with_roots`` follows the forms by pointer doubling.

A word with very many near words is no matter: near words of one word are at most a few hundred for each of its letters, and are reduced
to a count and the best one before they are shuffled. Null texts hold no words; a null id counts as an empty string. Repeated rows count
each. Texts of any length are read in pieces; a word of any length is a word. Empty tables give no rows, other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import LEFT, RIGHT, as_bytes, chunked, grouped, mix, offsets, per_row, powers, signed, small_batches, stored

RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")
BREAK = re.compile(rb"[^a-z\x80-\xff]")
PIECE, FLUSH = 4 << 20, 300_000

#: letter groups in the order of the trie's levels, common letters first; whatever is in no group counts as the last one
GROUPS = ["e", "a", "i", "n", "r", "t", "s", "o", "l", "u", "d", "c", "m", "p", "g", "b", "h", "f", "v", "y", "kw", "jqxz",
          "".join(map(chr, range(0xC0, 0xE0))), "".join(map(chr, range(0xE0, 0x100))), ""]
TOP, CLIP, SUBTREE, LEAF, PAIRS = 8, 3, 40_000, 16, 1 << 19
UNSPENT, SURPLUS, DEFICIT = 0, 1, 2


# --- words ------------------------------------------------------------------------------------------------------------


def pieces(text: bytes) -> Iterator[bytes]:
    """The text in pieces that cut no run of letters."""
    at = 0
    while at < len(text):
        cut = BREAK.search(text, at + PIECE) if len(text) - at > PIECE else None
        to = cut.start() if cut else len(text)
        yield text[at:to] if at or cut else text
        at = to


def without_letter(word: bytes, h: int) -> bytes:
    chars = word.decode()
    k = h % len(chars)
    return (chars[:k] + chars[k + 1:]).encode()


def word_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_chars: int = 5, least: int = 3, slip: int | None = None) -> DataFrame:
    """(word, n) of the runs of ``[A-Za-z\\u00C0-\\u00FF]``, A-Z lower-cased, with at least so many code points and occurrences.

    With ``slip``, a run whose crc32 of ``<doc_id>:<run>`` is a multiple of it loses one code point, that at crc32 modulo its length.
    """

    def told(counts: Counter) -> pa.RecordBatch:
        words = [(w, n) for w, n in ((w.decode(), n) for w, n in counts.items()) if n > 0 and len(w) >= least_chars]
        return pa.RecordBatch.from_arrays([pa.array([w for w, _ in words], pa.string()), pa.array([n for _, n in words], pa.int64())], names=["word", "n"])

    def run(batches):
        counts: Counter = Counter()
        for chunk in chunked(batches, "t"):
            for i, t in zip(chunk.column(0).to_pylist(), chunk.column(1).to_pylist()):
                start = crc32(f"{'' if i is None else i}:".encode())
                for piece in pieces(t.lower()):
                    runs = RUN.findall(piece)
                    counts.update(runs)
                    if slip and (hit := [w for w in set(runs) if not crc32(w, start) % slip]):
                        own = Counter(runs)
                        for w in hit:
                            counts[w] -= own[w]
                            counts[without_letter(w, crc32(w, start))] += own[w]
                if len(counts) > FLUSH:
                    yield told(counts)
                    counts.clear()
        if counts:
            yield told(counts)

    rows = small_batches(docs.select(F.col(doc_id).cast("string").alias("id"), as_bytes(text).alias("t")))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


# --- vectors and halves -------------------------------------------------------------------------------------------------

_GROUP_OF = np.full(256, len(GROUPS) - 1, np.int64)
for _level, _letters in enumerate(GROUPS):
    _GROUP_OF[[ord(c) for c in _letters]] = _level


class Words:
    """Code points, frequency vectors and half hashes of a list of words."""

    def __init__(self, words: pa.Array):
        self.words = words
        flat = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le"), np.uint32)
        self.lengths = np.asarray(pc.utf8_length(words)).astype(np.int64)
        self.starts = offsets(self.lengths)
        self.flat = flat

    def __len__(self) -> int:
        return len(self.lengths)

    def vectors(self) -> np.ndarray:
        """Words x groups, counts clipped at 127: clipping never raises a difference."""
        groups = np.where(self.flat < 256, _GROUP_OF[np.minimum(self.flat, 255)], len(GROUPS) - 1)
        at = per_row(self.lengths) * len(GROUPS) + groups
        return np.minimum(np.bincount(at, minlength=len(self) * len(GROUPS)), 127).astype(np.int8).reshape(len(self), len(GROUPS))

    def halves(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of first and last half, words x 2: with the word as the shorter (or equal) of a pair, and as the longer."""
        up, down = powers(int(self.lengths.max(initial=0)) + 1)
        place = np.arange(len(self.flat)) - np.repeat(self.starts[:-1], self.lengths)
        total = np.zeros(len(self.flat) + 1, np.uint64)
        np.cumsum(mix((self.flat.astype(np.uint64) + np.uint64(1)) * RIGHT) * up[place], out=total[1:])
        first, last = (np.zeros((len(self), 2), np.uint64) for _ in range(2))
        for k in range(2):
            m = np.maximum(self.lengths - k, 0)
            h, off = m // 2, self.starts[:-1]
            first[:, k] = mix(total[off + h] - total[off] + m.astype(np.uint64) * LEFT)
            tail = self.lengths - (m - h)
            last[:, k] = mix((total[self.starts[1:]] - total[off + tail]) * down[tail] + m.astype(np.uint64) * RIGHT)
        return first, last


def one_edit(a: str, b: str) -> bool:
    """Whether the words differ by exactly one inserted, deleted or replaced code point."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) != 1:
        return False
    k = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[k:] == b[k + 1:]


# --- the top of the trie ------------------------------------------------------------------------------------------------


def top_codes(vectors: np.ndarray) -> np.ndarray:
    """The clipped counts of the first ``TOP`` groups as digits of one number."""
    code = np.zeros(len(vectors), np.int64)
    for level in range(TOP):
        code = code * (CLIP + 1) + np.minimum(vectors[:, level], CLIP)
    return code


def subtrees(sizes: dict[int, int], limit: int) -> tuple[dict, int]:
    """The top of the trie as nested dicts by count, cut where at most ``limit`` words are left; leaves are (number, oversized)."""
    found = 0

    def grow(level: int, own: list[tuple[int, int]]):
        nonlocal found
        words = sum(n for _, n in own)
        if words <= limit or level == TOP:
            found += 1
            return found - 1, words > limit
        by_count: dict[int, list] = {}
        for code, n in own:
            by_count.setdefault(code // (CLIP + 1) ** (TOP - 1 - level) % (CLIP + 1), []).append((code, n))
        return {c: grow(level + 1, rows) for c, rows in sorted(by_count.items())}

    return grow(0, sorted(sizes.items())), found


def spend(state: np.ndarray, diff: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which queries may take a branch whose count differs by ``diff``, and what they have spent then."""
    ok = (diff == 0) | ((diff == 1) & (state & SURPLUS == 0)) | ((diff == -1) & (state & DEFICIT == 0))
    return ok, np.where(diff == 1, state | SURPLUS, np.where(diff == -1, state | DEFICIT, state))


def reached(tree, vectors: np.ndarray) -> Iterator[tuple[int, bool, np.ndarray, np.ndarray]]:
    """For every subtree: number, oversized, the words whose budget reaches it, and what they have spent; depth first."""
    clipped = np.minimum(vectors[:, :TOP], CLIP)
    stack = [(tree, 0, np.arange(len(vectors)), np.zeros(len(vectors), np.int8))]
    while stack:
        node, level, idx, state = stack.pop()
        if not len(idx):
            continue
        if isinstance(node, tuple):
            yield *node, idx, state
            continue
        for count, child in node.items():
            ok, spent = spend(state, count - clipped[idx, level])
            stack.append((child, level + 1, idx[ok], spent[ok]))


def routed(words: DataFrame, limit: int = SUBTREE) -> DataFrame:
    """(subtree, half, tag, word, n, home): each word in its own subtree (home) and in those it must be looked up in.

    The subtrees' sizes are counted first: at most ``(CLIP + 1) ** TOP`` numbers reach the driver. In oversized subtrees, ``half`` is the
    hash of a word half and ``tag`` tells which: 2 m for the first, 2 m + 1 for the last half with a shorter word of m code points.
    """

    def coded(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(top_codes(Words(batch.column(0)).vectors()))], names=["code"])

    sizes = {r.code: r["count"] for r in words.select("word").mapInArrow(coded, "code long").groupBy("code").count().collect()}
    tree, _ = subtrees(sizes, limit)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            own = Words(batch.column(0))
            first, last = own.halves()
            for number, oversized, idx, state in reached(tree, own.vectors()):
                home = state == UNSPENT
                keyed = [(np.zeros(len(idx), np.uint64), np.full(len(idx), -1))]
                if oversized:
                    keyed = [(side[idx, k], 2 * (own.lengths[idx] - k) + s) for s, side in enumerate((first, last)) for k in range(2)]
                for half, tag in keyed:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(idx), number, np.int32)), signed(half), pa.array(tag.astype(np.int64)), batch.column(0).take(pa.array(idx)),
                         batch.column(1).take(pa.array(idx)), pa.array(home)],
                        names=["subtree", "half", "tag", "word", "n", "home"])

    return words.select("word", "n").mapInArrow(run, "subtree int, half long, tag long, word string, n long, home boolean")


# --- search -------------------------------------------------------------------------------------------------------------


class Trie:
    """Words in the order of their vectors; a node is a range of them that agrees in the counts so far."""

    def __init__(self, vectors: np.ndarray):
        self.order = np.lexsort(vectors.T[::-1])
        self.vectors = vectors[self.order]

    def leaves(self, queries: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(words, queries) of every leaf that queries reach: depth first, all queries of a node together."""
        levels = queries.shape[1]
        stack = [(0, len(self.order), 0, np.arange(len(queries)), np.zeros(len(queries), np.int8))]
        while stack:
            lo, hi, level, idx, state = stack.pop()
            if not len(idx) or lo == hi:
                continue
            if hi - lo <= LEAF or level == levels:
                yield self.order[lo:hi], idx
                continue
            column = self.vectors[lo:hi, level]
            cuts = [0, *(np.flatnonzero(column[1:] != column[:-1]) + 1).tolist(), hi - lo]
            own = queries[idx, level]
            for a, b in zip(cuts, cuts[1:]):
                ok, spent = spend(state, column[a] - own)
                stack.append((lo + a, lo + b, level + 1, idx[ok], spent[ok]))


def verified(own: Words, first: np.ndarray, last: np.ndarray, a: np.ndarray, b: np.ndarray, tag: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs (a, b) of rows one edit apart: lengths, then halves, then the words. Blocks bound the memory.

    In a group of one half, pairs that the first half shows already are left to the group of that half.
    """
    for at in range(0, len(a), PAIRS):
        x, y = a[at: at + PAIRS], b[at: at + PAIRS]
        m = np.minimum(own.lengths[x], own.lengths[y])
        near = np.maximum(own.lengths[x], own.lengths[y]) - m <= 1
        if tag >= 0:
            near &= m == tag // 2
        x, y, m = x[near], y[near], m[near]
        kx, ky = own.lengths[x] - m, own.lengths[y] - m
        by_first = first[x, kx] == first[y, ky]
        by_last = last[x, kx] == last[y, ky]
        hit = (by_first | by_last) if tag < 0 else by_first if tag % 2 == 0 else by_last & ~by_first
        x, y = x[hit], y[hit]
        if not len(x):
            continue
        p, q = (own.words.take(pa.array(k)).to_pylist() for k in (x, y))
        good = np.fromiter(map(one_edit, p, q), bool, len(x))
        if good.any():
            yield x[good], y[good]


def near_in_group(rows: pa.Table, tag: int) -> pa.RecordBatch | None:
    """(word, n_near, best_n, best) of the queries of one group, among the words at home in it."""
    own = Words(rows.column("word").combine_chunks())
    n, home = rows.column("n").to_numpy(), np.flatnonzero(rows.column("home").to_numpy(zero_copy_only=False))
    if not len(home):
        return None
    vectors, (first, last) = own.vectors(), own.halves()
    found, held, size = [], [], 0

    def check() -> None:
        found.extend(verified(own, first, last, np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), tag))
        held.clear()

    for words, queries in Trie(vectors[home]).leaves(vectors):
        step = max(1, PAIRS // len(words))
        for at in range(0, len(queries), step):
            some = queries[at: at + step]
            held.append((np.repeat(some, len(words)), np.tile(home[words], len(some))))
            size += len(some) * len(words)
            if size >= PAIRS:
                check()
                size = 0
    if held:
        check()
    if not found:
        return None
    x, y = (np.concatenate([f[k] for f in found]) for k in range(2))
    # UTF-8 keeps the order of code points, so the sort below ranks words as required
    rank = np.empty(len(own), np.int64)
    rank[np.asarray(pc.sort_indices(own.words))] = np.arange(len(own))
    order = np.lexsort((rank[y], -n[y], x))
    x, y = x[order], y[order]
    heads = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
    counts = np.diff(np.r_[heads, len(x)])
    return pa.RecordBatch.from_arrays(
        [own.words.take(pa.array(x[heads])), pa.array(counts), pa.array(n[y[heads]]), own.words.take(pa.array(y[heads]))],
        names=["word", "n_near", "best_n", "best"])


def near_words(words: DataFrame, limit: int = SUBTREE) -> DataFrame:
    """(word, n_near, best_n, best) for every word with near words; ``words`` are distinct, with counts ``n``."""

    def run(batches):
        for key, rows in grouped(batches, ("subtree", "half", "tag")):
            out = near_in_group(rows, key[2])
            if out is not None:
                yield out

    dealt = routed(words, limit).repartition("subtree", "half", "tag").sortWithinPartitions("subtree", "half", "tag")
    part = dealt.mapInArrow(run, "word string, n_near long, best_n long, best string")
    return part.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("k"), "best")).alias("top")).select(
        "word", "n_near", (-F.col("top.k")).alias("best_n"), F.col("top.best").alias("best"))


# --- forms ----------------------------------------------------------------------------------------------------------------


def forms(words: DataFrame, near: DataFrame, factor: int = 2) -> DataFrame:
    """(word, n, n_near, form, form_n): the near word of largest count as form, if it has ``factor`` times the word's own."""
    strong = F.col("best_n") >= factor * F.col("n")
    return words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(strong, F.col("best")).alias("form"), F.when(strong, F.col("best_n")).alias("form_n"))


def with_roots(formed: DataFrame) -> DataFrame:
    """``formed`` with ``root``, the end of the chain of forms.

    Pointers double each round. Counts at least double along a chain, so chains have at most 62 links and 6 rounds suffice; only words
    whose pointer still has a form are joined again.
    """
    formed = stored(formed, "forms")
    links = formed.filter("form is not null").select("word", F.col("form").alias("ptr"))
    target = links.select(F.col("word").alias("ptr"), F.lit(True).alias("open"))
    now = stored(links.join(target, "ptr", "left").select("word", "ptr", F.coalesce("open", F.lit(False)).alias("open")), "pointers")
    while not now.filter("open").isEmpty():
        step = now.select(F.col("word").alias("ptr"), F.col("ptr").alias("next"), F.col("open").alias("more"))
        moved = now.filter("open").join(step, "ptr").select("word", F.col("next").alias("ptr"), F.col("more").alias("open"))
        now = stored(now.filter("not open").unionAll(moved), "pointers")
    return formed.join(now.select("word", F.col("ptr").alias("root")), "word", "left").withColumn("root", F.coalesce("root", "word"))


def spelling_variants(words: DataFrame, limit: int = SUBTREE) -> DataFrame:
    """(word, n, n_near, form, form_n, root) for distinct ``words`` with counts ``n``; null words are no words."""
    words = stored(words.filter("word is not null"), "words")
    return with_roots(forms(words, near_words(words, limit)))
