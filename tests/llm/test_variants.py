"""Spelling variants against plain Python: words, near words, forms and roots."""

import random
import re
import zlib
from collections import Counter

import pytest

from wattloom.llm import variants
from wattloom.llm.queries import QUERIES


def plain_counts(docs, slip=97, least_chars=5, least=3):
    counts = Counter()
    for i, t in docs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if slip and h % slip == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            counts[w] += 1
    return {w: n for w, n in counts.items() if len(w) >= least_chars and n >= least}


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def plain_variants(counts):
    """word -> (n, n_near, form, form_n, root); candidates share what is left when one code point is deleted or masked."""
    keys = {}
    for w in counts:
        for k in range(len(w)):
            keys.setdefault(w[:k] + w[k + 1:], set()).add(w)
        keys.setdefault(w, set()).add(w)
    mates = {w: {m for k in [w, *(w[:k] + w[k + 1:] for k in range(len(w)))] for m in keys[k] if m != w and near(w, m)} for w in counts}
    form = {}
    for w, own in mates.items():
        best = min(own, key=lambda m: (-counts[m], m), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * counts[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {w: (counts[w], len(mates[w]), form[w], counts[form[w]] if form[w] else None, root(w)) for w in counts}


def told(df):
    rows = df.select("word", "n", "n_near", "form", "form_n", "root").collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: tuple(r)[1:] for r in rows}


def test_query(spark, folder):
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    expected = plain_variants(plain_counts(docs))
    assert told(QUERIES["op11_spelling_variants"](spark, folder)) == expected
    assert any(v[2] for v in expected.values())


def test_words_of_odd_rows(frame, odd_rows, monkeypatch):
    rows = odd_rows + [(31, "ÀÉ×÷ß Straße STRASSE straße STRAßE naïve Naïve naÏve x" * 7), (32, "word" * 3000 + " tail" * 9), (None, "repeated row words " * 4)]
    for slip in (None, 97, 2, 1):
        monkeypatch.setattr(variants, "PIECE", 50)
        monkeypatch.setattr(variants, "FLUSH", 40)
        got = {r.word: r.n for r in variants.word_counts(frame(rows), slip=slip).collect()}
        assert got == plain_counts(rows, slip)
    assert variants.word_counts(frame([])).count() == 0
    assert variants.spelling_variants(variants.word_counts(frame([]))).count() == 0


@pytest.mark.parametrize("limit", [10 ** 6, 60, 3])
def test_near_words(spark, monkeypatch, limit):
    """Close words over few letters, many of one vector, at any size of the subtrees; the smallest force oversized ones."""
    monkeypatch.setattr(variants, "LEAF", 4)
    monkeypatch.setattr(variants, "PAIRS", 500)
    rng = random.Random(limit)
    counts = {}
    for _ in range(700):
        counts["".join(rng.choice("abce") for _ in range(rng.randrange(1, 6)))] = rng.randrange(1, 60)
    for _ in range(300):
        counts["".join(rng.choice("eainé漢") for _ in range(rng.randrange(4, 8)))] = rng.randrange(1, 4)
    counts |= {"e" * 40: 3, "e" * 41: 9, "e" * 200: 1, "e" * 201: 2, "e" * 200 + "x": 50, "": 5}
    df = spark.createDataFrame([*counts.items(), (None, 5)], "word string, n long")
    assert told(variants.spelling_variants(df.repartition(4), limit)) == plain_variants(counts)


def test_long_chain_of_forms(spark):
    """Each word points to the next, counts doubling: roots come from pointer doubling."""
    words = ["a" * k + "b" * (25 - k) for k in range(26)]
    counts = {w: 2 ** k for k, w in enumerate(words)}
    got = told(variants.spelling_variants(spark.createDataFrame([*counts.items()], "word string, n long")))
    assert got == plain_variants(counts) and got["b" * 25][4] == "a" * 25
