"""Personal data: the base patterns against plain regular expressions, the field against enumeration, and held-out rewriting."""

from __future__ import annotations

import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from wattloom.llm import pii
from wattloom.llm.queries import QUERIES


def plain(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 14 <= len(digits) <= 19 and pii.luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def test_base_by_plain_patterns():
    rng = random.Random(0)
    for _ in range(20000):
        text = "".join(rng.choice("a1.@+-2 3()9 7%_\n5é") for _ in range(rng.randrange(45)))
        assert pii.base_spans(text) == plain(text), text
    for text in ("a" * 50000, "1" * 20000, "1." * 20000, "@" * 5000, "a@" * 5000, "+1 " * 5000):
        pii.base_spans(text)


@pytest.fixture(scope="module")
def field(spark, folder):
    docs = spark.read.parquet(folder.replace("sf0.001", "sf0.01") + "/documents.parquet")
    return pii.fit(pii.training_windows(docs, "doc_id", "text", 500, 60))


def test_query(spark, folder):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    for r in QUERIES["op1_pii"](spark, folder).collect():
        base = plain(docs[r.doc_id])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == kind for _, k, _ in base) for kind in range(4))
        assert r.base_sha256 == hashlib.sha256(pii.span_list(base).encode()).hexdigest()
        assert set(filter(None, pii.span_list(base).split(","))) <= set(r.spans.split(","))
        assert len(r.spans.split(",")) * bool(r.spans) == len(base) + r.n_added


def test_odd_rows(frame, odd_rows, field):
    got = pii.detect(frame([*odd_rows, (60, "mail a.b@c.org or x@y")]), field=field).collect()
    assert len(got) == len(odd_rows) + 1 and {r.spans for r in got if r.doc_id in (4, 5, 6)} == {""}
    assert [r.spans for r in got if r.doc_id == 60] == ["email:5:14"]
    assert pii.detect(frame([])).count() == 0
    assert pii.detect(frame([(1, "nothing here"), (2, None)])).count() == 2


def test_field_by_enumeration():
    """Best segmentation and likelihood gradient against all segmentations of a short window."""
    rng = np.random.default_rng(1)
    field = pii.Field(rng.normal(size=(len(pii.KINDS), pii.FEATURES)), rng.normal(size=(pii.STATES, pii.STATES)))
    segments = [(0, 2, [0, 3]), (1, 1, [2]), (1, 3, [0, 5]), (3, 1, [7]), (2, 2, [1, 4])]

    def ways(at):
        if at == 4:
            yield []
            return
        yield from ([(at, 1, pii.NONE), *rest] for rest in ways(at + 1))
        for i, size, _ in segments:
            if i == at:
                for y, rest in itertools.product(range(len(pii.KINDS)), list(ways(at + size))):
                    yield [(i, size, y), *rest]

    def score(way):
        total, before = 0.0, pii.NONE
        for i, size, y in way:
            total += field.after[before, y]
            if y != pii.NONE:
                total += field.weights[y, next(f for a, n, f in segments if (a, n) == (i, size))].sum()
            before = y
        return total

    every = list(ways(0))
    best = max(every, key=score)
    assert field.best(4, segments) == [s for s in best if s[2] != pii.NONE]
    gold = [(0, 2, 1), (2, 2, 3)]
    value, g, h = field.gradient(4, segments, gold)
    want = score([(0, 2, 1), (2, 2, 3)]) - np.logaddexp.reduce([score(w) for w in every])
    assert value == pytest.approx(want)
    for table, grad, at in ((field.weights, g, (1, 3)), (field.weights, g, (3, 4)), (field.after, h, (1, 3)), (field.after, h, (pii.NONE, pii.NONE))):
        table[at] += 1e-5
        up = field.gradient(4, segments, gold)[0]
        table[at] -= 1e-5
        assert grad[at] == pytest.approx((up - value) / 1e-5, rel=1e-3, abs=1e-4)


def test_held_out_rewriting(field):
    """Entities written in ways that the base does not know, on texts not used in training."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 9)))
    found = total = wrong = 0
    for n in range(120):
        kind = n % 4
        digits = "".join(rng.choice("123456789") for _ in range(15))
        card = digits + next(d for d in "0123456789" if pii.luhn(digits + d))
        entity = [f"{word()}.{word()}@{word()}.com", ".".join(str(rng.randrange(10, 255)) for _ in range(4)), card, f"+1 ({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)}"][kind]
        text = f"{word()} {word()} {entity} {word()} {word()}."
        a = text.index(entity)
        new, spans = pii.rewritten(text, [(a, kind, a + len(entity))], n)
        if pii.base_spans(new):
            continue
        got = pii.added_spans(new, [], field)
        total, found, wrong = total + 1, found + (spans[0] in got), wrong + len(set(got) - {spans[0]})
    assert total >= 60 and found >= 0.8 * total and wrong <= 0.1 * total, (found, wrong, total)


def test_plain_text_gets_nothing(field):
    for text in ("It cost 12,345.67 in 2024-05-17.", "from 1999 to 2005 at noon", "version 3.14 of the book", "chapter 12, verse 7 at the end"):
        assert pii.added_spans(text, [], field) == []


LONG_ENTITIES = [("jane.doe [at] mail [dot] example [dot] com", 0), ("6304 - 0000 - 0000 - 0000 - 000", 2)]


@pytest.mark.parametrize("entity,kind", LONG_ENTITIES)
def test_long_entities_are_candidates_and_training_examples(entity, kind):
    text = f"please write to {entity} before the end."
    a = text.index(entity)
    assert any(x <= a and a + len(entity) <= y for x, y in pii.windows(text))
    one = pii.example(text, [(a, kind, a + len(entity))])
    assert one and len(one[2]) == 1


def test_long_words_are_read_once():
    """Words of five million letters with a digit, a sign or a bracket take seconds, not hours."""
    import time

    start = time.perf_counter()
    for text in ("x" * 5_000_000 + " 7", "ab" * 2_500_000 + "@", "x" * 2_000_000 + "[at]" + "y" * 2_000_000, "(at)" * 200_000, "@" * 300_000, "x[" * 400_000 + " 1"):
        found = pii.stretches(text)
        assert all(0 <= a < b <= len(text) for a, b in found) and found == sorted(found)
    assert time.perf_counter() - start < 30
    assert pii.stretches("write to jane@x.org, or jane [at] x (dot) org or 12 34 56 78") == [(9, 20), (24, 45), (49, 60)]
