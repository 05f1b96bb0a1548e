"""The n-gram Jaccard join against plain Python over all pairs."""

import random

import brute
import numpy as np
import pyarrow as pa
import pytest

from wattloom.llm import overlap
from wattloom.llm.queries import QUERIES


def told(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def test_query(spark, folder):
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    expected = brute.near_duplicates(docs, 4, 85)
    assert told(QUERIES["op13_ngram_jaccard_join"](spark, folder)) == expected
    assert any(i != c for i, (_, c) in expected.items())


def test_odd_rows(frame, odd_rows):
    known = [(i, t) for i, t in odd_rows if i is not None and i not in (17, 18)]
    expected = brute.near_duplicates(known, 4, 85)
    rows = overlap.jaccard_links(frame(odd_rows)).collect()
    assert len(rows) == len(odd_rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows if r.doc_id in expected} == expected
    assert all(r.component_id is None for r in rows if r.doc_id is None)
    assert all(r.component_id == r.doc_id for r in rows if r.doc_id in (17, 18))
    assert overlap.jaccard_links(frame([])).count() == 0


def close_copies(rng, n, length, edits):
    """Copies of an absent text: many pairs lie about the threshold."""
    base = [f"w{rng.randrange(10000)}" for _ in range(length)]
    out = []
    for _ in range(n):
        words = list(base)
        for k in rng.sample(range(length), rng.randrange(*edits)):
            words[k] = f"n{rng.randrange(10 ** 6)}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize(("block", "rows", "dense"), [(1 << 19, 1024, 32), (3000, 7, 2), (200, 3, 1000)])
def test_copies_about_the_threshold(monkeypatch, frame, block, rows, dense):
    """Stars link few of them; blocks of any size give the same components."""
    for name, value in (("BLOCK", block), ("ROWS", rows), ("DENSE", dense), ("EXPANDED", 1 << 22 if dense == 32 else 50)):
        monkeypatch.setattr(overlap, name, value)
    rng = random.Random(11)
    texts = close_copies(rng, 60, 150, (1, 4)) + close_copies(rng, 40, 60, (0, 3)) + close_copies(rng, 30, 12, (0, 2)) + close_copies(rng, 30, 400, (4, 10))
    shared = " ".join(f"p{k}" for k in range(40))
    texts += [f"{shared} own{k} tail{k % 7}" for k in range(40)] + [f"{shared} " * (k % 5 + 1) for k in range(20)] + [f"a b c {k % 3}" for k in range(12)]
    docs = [(i * 3, t) for i, t in enumerate(texts)]
    rng.shuffle(docs)
    expected = brute.near_duplicates(docs, 4, 85)
    assert 20 < len({c for _, c in expected.values()}) < len(docs) - 60
    assert told(overlap.jaccard_links(frame(docs))) == expected


def test_other_widths_and_bounds(frame):
    rng = random.Random(5)
    docs = list(enumerate(close_copies(rng, 50, 80, (0, 8)) + close_copies(rng, 30, 6, (0, 3))))
    for width, percent in ((1, 60), (2, 50), (3, 95), (4, 100)):
        assert told(overlap.jaccard_links(frame(docs), width=width, percent=percent)) == brute.near_duplicates(docs, width, percent)


def test_product_of_blocks(monkeypatch):
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 300, rng.integers(0, 90)).astype(np.uint64)) for _ in range(70)]
    block = overlap.Block(pa.table({"node": range(70), "n": [len(s) for s in sets], "grams": [s.tobytes() for s in sets]}))
    a, b = np.arange(30), np.arange(25, 70)
    expected = [[len(np.intersect1d(sets[i], sets[j])) for j in b] for i in a]
    for dense, expanded in ((1, 1 << 20), (5, 100), (10 ** 6, 10)):
        monkeypatch.setattr(overlap, "DENSE", dense)
        monkeypatch.setattr(overlap, "EXPANDED", expanded)
        assert overlap.overlaps(block, a, b).tolist() == expected
    assert overlap.overlaps(block.before(0), a, b).sum() == 0
