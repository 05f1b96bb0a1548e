"""Line dedup counts classes of documents: groups of copies, and lines that always have the same neighbours."""

from __future__ import annotations

import random

import brute

from wattloom.llm import templates


def own_lines(rng, n=2):
    return ["".join(rng.choice("abcdefgh") for _ in range(7)) + " " + " ".join("".join(rng.choice("abcdefgh") for _ in range(7)) for _ in range(11)) + "." for _ in range(n)]


def left_of(frame, docs, **more):
    return {r.doc_id: r.text for r in templates.without_recurring(frame(docs), **more).collect()}


def test_copies_do_not_shield_a_line(frame):
    rng, line = random.Random(3), "All rights reserved by the owner of this page."
    plain = {i: own_lines(rng) for i in range(60)}
    copied = own_lines(rng, 6)
    plain |= {1000 + i: copied for i in range(500)}
    for i in range(100):  # near copies
        words = "\n".join(copied).split(" ")
        words[rng.randrange(len(words) - 1)] = f"other{i}"
        plain[2000 + i] = " ".join(words).split("\n")
    got = left_of(frame, [(i, "\n".join([*x, line])) for i, x in plain.items()])
    assert got == {i: "\n".join(x) for i, x in plain.items()}


def test_near_copies_alone_keep_their_lines(frame):
    rng = random.Random(4)
    base, docs = "\n".join(own_lines(rng, 6)), []
    for i in range(150):
        words = base.split(" ")
        words[rng.randrange(len(words) - 1)] = f"other{'x' * i}"
        docs.append((i, " ".join(words)))
    assert left_of(frame, docs) == dict(docs)


def test_inner_lines_of_a_repeated_block_go(frame):
    rng = random.Random(5)
    footer = ["Terms of use and imprint of the site.", "Contact us by letter or by phone.", "Privacy notice for all our readers here.", "Back to the top of this page."]
    plain = {i: own_lines(rng) for i in range(40)}
    got = left_of(frame, [(i, "\n".join([*x, *footer])) for i, x in plain.items()])
    assert got == {i: "\n".join(x) for i, x in plain.items()}


def test_template_of_repeated_values_goes_at_any_size(frame):
    """Two fields of thirty values: three lines a value, then fifty."""
    for size in (100, 1500):
        rng = random.Random(size)
        name = lambda: "name" + rng.choice("abcdefghijklmnopqrstuvwxyzäöüß")
        plain = {i: own_lines(rng) for i in range(size)}
        docs = [(i, "\n".join([x[0], f"Posted here today by {name()} writing from {name()} for our readers.", x[1]])) for i, x in plain.items()]
        assert left_of(frame, docs) == {i: "\n".join(x) for i, x in plain.items()}, size


def test_rare_line_in_a_hot_leaf_goes(frame):
    """Twelve documents share a line; hundreds of others begin a line of the same length with the same words."""
    rng, docs = random.Random(6), []
    for i in range(400):
        docs.append((i, "\n".join([*own_lines(rng), "This is the " + " ".join("".join(rng.choice("abcdefgh") for _ in range(7)) for _ in range(9))])))
    plain = {1000 + i: "\n".join(own_lines(rng)) for i in range(12)}
    docs += [(i, x + "\nThis is the footer that all pages of the old site carry.") for i, x in plain.items()]
    assert left_of(frame, docs) == dict(docs) | plain


def test_copies_and_near_copies_by_brute_force(frame):
    """Templates at several levels, copies, near copies and unrelated documents against the rule in plain Python."""
    rng = random.Random(8)
    docs, base = [], own_lines(rng, 5)
    for i in range(30):
        docs.append((i, "\n".join([*base, "This whole page was copied without any change."])))
    for i in range(25):
        words = "\n".join(base).split(" ")
        words[rng.randrange(len(words) - 1)] = f"other{'y' * i}"
        docs.append((100 + i, " ".join(words) + f"\nThis whole page was changed by reader {i} today."))
    for i in range(60):
        lines = own_lines(rng, 3)
        if i % 2:
            lines.append(f"Seen here on {rng.choice(['monday', 'tuesday', 'sunday'])} by reader {i} of the page.")
        if i % 3 == 0:
            lines.insert(1, "This whole page was copied without any change.")
        if i % 5 == 0:
            lines.insert(0, "Rare line with words that stand in few texts only.")
        docs.append((200 + i, "\n".join(lines)))
    texts = [t for _, t in docs]
    for least in (4, 10):
        gone = brute.recurring_lines(texts, least)
        expected = {i: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in g) for (i, t), g in zip(docs, gone)}
        assert left_of(frame, docs, min_docs=least) == expected
        assert 0 < sum(map(len, gone)) < sum(t.count("\n") + 1 for t in texts)
