"""Interaction audit of document filters: what each filter removes in every order of application, and its Shapley share.

A document is known by the set of filters it fails, one bit each. All a filter chain can remove follows from the counts of these
sets, so documents are aggregated once:

1. ``failures`` judges every text on its own and tells first holders of a text from later ones.
2. ``tallies`` counts documents by part and failed set; the counts combine on the map side, a part is at most 2 ** n rows.
3. ``coalitions`` tabulates v(S), the documents that the filters in S remove together, for all subsets S.
4. Step counts are differences of v along an order. Shapley values come from the constrained least squares problem

       minimise   sum over S of w(S) (v(S) - v({}) - sum of phi over S) ** 2     subject to   sum of phi = v(all) - v({})

   with the kernel w(S) = (n - 1) / (C(n, |S|) |S| (n - |S|)), solved through its normal equations in rational numbers.

A null text is an empty one, a null part an empty string. Rows with a null id hold no earlier copy and are none; repeated rows of one
id do not copy each other. A label counts if any row of the id has it. Other columns are not read; an empty table gives no rows.
Memory: one batch of documents, or the counts of one part.
"""

from __future__ import annotations

from fractions import Fraction
from functools import lru_cache
from itertools import permutations
from math import comb, factorial

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import as_bytes, map_arrow, stored, word_hashes

FILTERS = "ABCDE"
MIN_WORDS, DISTINCT_PERCENT, UPPER_PERCENT = 200, 50, 3
UPPER, SIGNS, INNER = bytes(range(65, 91)), b"#$%&*|", bytes(range(0x80, 0xC0))
COUNTS = ("n", "good", "toxic")


def text_failures(text: bytes) -> int:
    """Bits of the filters A to D that one text fails: few words, few distinct words, capitals, signs."""
    hashes = word_hashes(text)
    chars, without = len(text.translate(None, INNER)), lambda drop: len(text) - len(text.translate(None, drop))
    return (
        (len(hashes) < MIN_WORDS)
        | (100 * len(np.unique(hashes)) < DISTINCT_PERCENT * len(hashes)) << 1
        | (100 * without(UPPER) > UPPER_PERCENT * chars) << 2
        | (without(SIGNS) > 0) << 3
    )


def failures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(id, part, fails) for each row; bit 4 of ``fails`` is set if a smaller id anywhere holds the same text.

    Texts are compared by 128-bit digests. The least id of a digest is joined on (digest, id), so the rows of one much copied text
    spread over tasks by their ids.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(2).to_pylist()
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array([int(text_failures(t)) for t in texts], pa.int32()), pa.array([xxhash.xxh3_128_digest(t) for t in texts], pa.binary())],
            names=["id", "part", "fails", "digest"],
        )

    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(part), F.lit("")).alias("part"), as_bytes(text).alias("t"))
    judged = stored(map_arrow(rows, run, "id long, part string, fails int, digest binary", "t"), "judged")
    firsts = judged.groupBy("digest").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    copy = F.when(F.col("first").isNull() & F.col("id").isNotNull(), F.lit(1 << 4)).otherwise(F.lit(0))
    return judged.join(firsts, ["digest", "id"], "left").select("id", "part", F.col("fails").bitwiseOR(copy).alias("fails"))


def tallies(failed: DataFrame, labels: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """(part, fails, n, good, toxic): documents by part and failed set, with those of good quality and the toxic ones."""
    flag = lambda c: F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0))
    known = labels.groupBy(F.col(doc_id).cast("long").alias("id")).agg(flag("quality").alias("is_good"), flag("toxic").alias("is_toxic"))
    total = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0)).cast("long"))
    return failed.join(known, "id", "left").groupBy("part", "fails").agg(
        F.count(F.lit(1)).alias("n"), total("is_good").alias("good"), total("is_toxic").alias("toxic"))


def coalitions(fails: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    """v(S) for every subset S of ``n`` filters, one row of ``counts`` columns each: all that fails some filter of S."""
    subsets = np.arange(1 << n)
    return (subsets[:, None] & fails[None, :] != 0).astype(np.int64) @ counts


@lru_cache
def _inverse(n: int) -> list[list[Fraction]]:
    """Inverse of the normal equations of the kernel-weighted problem with its efficiency constraint as last row and column."""
    a = [[Fraction(0)] * (n + 1) + [Fraction(int(i == j)) for j in range(n + 1)] for i in range(n + 1)]
    for s in range(1, (1 << n) - 1):
        for i in range(n):
            for j in range(n):
                if s >> i & s >> j & 1:
                    a[i][j] += kernel(n, s.bit_count())
    for i in range(n):
        a[i][n] = a[n][i] = Fraction(1)
    for c in range(n + 1):
        p = next(r for r in range(c, n + 1) if a[r][c])
        a[c], a[p] = a[p], a[c]
        a[c] = [x / a[c][c] for x in a[c]]
        for r in range(n + 1):
            if r != c and a[r][c]:
                a[r] = [x - a[r][c] * y for x, y in zip(a[r], a[c])]
    return [row[n + 1:] for row in a]


def kernel(n: int, size: int) -> Fraction:
    return Fraction(n - 1, comb(n, size) * size * (n - size))


def shapley(v: list[int], n: int) -> list[Fraction]:
    """Shapley values of the game ``v`` (by subset) as the exact solution of the constrained least squares problem."""
    right = [sum((kernel(n, s.bit_count()) * (v[s] - v[0]) for s in range(1, (1 << n) - 1) if s >> i & 1), Fraction(0)) for i in range(n)]
    right.append(Fraction(v[-1] - v[0]))
    return [sum((x * y for x, y in zip(row, right)), Fraction(0)) for row in _inverse(n)[:n]]


def order_steps(part: str, fails: np.ndarray, counts: np.ndarray, filters: str) -> pd.DataFrame:
    """One row per order and step for a part with ``counts`` (columns as in ``COUNTS``) of documents by failed set."""
    n = len(filters)
    v, everything = coalitions(fails, counts, n), int(counts[:, 0].sum())
    shares = [int(factorial(n) * x) for x in shapley(v[:, 0].tolist(), n)]
    only = [int(counts[fails == 1 << f, 0].sum()) for f in range(n)]
    rows = []
    for order in permutations(range(n)):
        before, name = 0, "".join(filters[f] for f in order)
        for step, f in enumerate(order, 1):
            now = before | 1 << f
            removed, good, toxic = (v[now] - v[before]).tolist()
            rows.append((part, name, step, everything - int(v[now, 0]), removed, int(v[1 << f, 0]) - removed, only[f], good, toxic, shares[f]))
            before = now
    return pd.DataFrame(rows, columns=list(STEPS))


STEPS = {"part": "string", "filter_order": "string", "step": "int", "kept": "long", "removed": "long", "redundant": "long",
         "unique_fails": "long", "good_lost": "long", "toxic_lost": "long", "shapley": "long"}


def audit(counted: DataFrame, filters: str = FILTERS) -> DataFrame:
    """All orders of ``filters`` with their steps for each part of ``tallies``; ``shapley`` is the value times the number of orders.

    ``filters`` names bit 0 onwards; the result has n * n! rows a part, so n is meant to be small.
    """

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return order_steps(key[0], rows["fails"].to_numpy(np.int64), rows[list(COUNTS)].to_numpy(np.int64), filters)

    return counted.groupBy("part").applyInPandas(run, ", ".join(f"{c} {t}" for c, t in STEPS.items()))
