"""Plain Python versions of the operators over lists of (id, text), for small fixtures."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text, width=2):
    w = tuple(words(lower(text)))
    if not w:
        return frozenset()
    return frozenset([w]) if len(w) < width else frozenset(w[i:i + width] for i in range(len(w) - width + 1))


def near_duplicates(docs, width=2, percent=80):
    """doc_id -> (set size, component); ids are unique."""
    sets = {i: shingles(t, width) for i, t in docs}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    for i, s in sets.items():
        shared = Counter(j for x in s for j in holders[x] if j < i)
        for j, both in shared.items():
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(s), find(i)) for i, s in sets.items()}


def substring_dedup(docs, width=35):
    """[(doc_id, n_words, n_removed, sha256)] in order."""
    texts = [(i, words(t)) for i, t in docs]
    seen = Counter(tuple(w[k:k + width]) for _, w in texts for k in range(len(w) - width + 1))
    out = []
    for i, w in texts:
        gone = set()
        for k in range(len(w) - width + 1):
            if seen[tuple(w[k:k + width])] > 1:
                gone.update(range(k, k + width))
        kept = [x for k, x in enumerate(w) if k not in gone]
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return out


def quality_base(text):
    text = text or ""
    w, earlier, dup = words(text), set(), 0
    for line in text.split("\n"):
        if words(line):
            dup += line in earlier
            earlier.add(line)
    seen = Counter(tuple(w[k:k + 5]) for k in range(len(w) - 4))
    rep = set()
    for k in range(len(w) - 4):
        if seen[tuple(w[k:k + 5])] > 1:
            rep.update(range(k, k + 5))
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(rep), len(w) < 10 or 100 * len(rep) > 20 * len(w))


def tiled(doc, item, least=5):
    """Words of ``item`` covered by greedy string tiling, by trying all pairs of places."""
    d, b = words(lower(doc)), words(lower(item))
    least = min(least, len(b))
    md, mb = [False] * len(d), [False] * len(b)
    while least:
        best = []
        for p in range(len(b)):
            for q in range(len(d)):
                k = 0
                while p + k < len(b) and q + k < len(d) and b[p + k] == d[q + k] and not mb[p + k] and not md[q + k]:
                    k += 1
                if k >= least and (not best or k >= best[0][0]):
                    best = [m for m in best if m[0] == k] + [(k, p, q)]
        if not best:
            break
        for k, p, q in sorted(best):
            if not any(mb[p:p + k]) and not any(md[q:q + k]):
                mb[p:p + k] = md[q:q + k] = [True] * k
    return sum(mb)


def line_templates(own, least):
    """For each line of a leaf, (text, line number, masked words), its templates at all levels."""
    counts = Counter(place for _, _, w in own for place in enumerate(w) if place[1] != "<*>")
    counts = {place: n for place, n in counts.items() if n >= least}
    for n, k, w in own:
        lines = [counts.get(place, 0) for place in enumerate(w)]
        need, found = least, set()
        while need <= max(lines + [least]):
            if 2 * sum(c >= need for c in lines) >= len(w):
                found.add(" ".join(x if c >= need else "<*>" for x, c in zip(w, lines)))
            need *= 2
        yield n, k, found


def recurring_lines(texts, least=10):
    """For each text the numbers of the lines to drop: those with a template that stands in ``least`` classes of near-duplicate texts."""
    digit = lambda w: any(c in "0123456789" for c in w)
    leaves = defaultdict(list)
    for n, t in enumerate(texts):
        for k, x in enumerate((t or "").split("\n")):
            w = [("<*>" if digit(x) else x) for x in words(x)]
            if len(w) >= 3:
                leaves[(len(w), *w[:3])].append((n, k, w))
    placed = defaultdict(list)
    for own in leaves.values():
        if len({texts[n] for n, _, _ in own}) >= least:
            for n, k, found in line_templates(own, least):
                for template in found:
                    placed[template].append((n, k))
    wide = {template: own for template, own in placed.items() if len({texts[n] for n, _ in own}) >= least}
    compared = sorted({texts[n] for own in wide.values() for n, _ in own})
    classes = {compared[i]: c for i, (_, c) in near_duplicates(list(enumerate(compared)), 5, 80).items()}
    out = [set() for _ in texts]
    for own in wide.values():
        if len({classes[texts[n]] for n, _ in own}) >= least:
            for n, k in own:
                out[n].add(k)
    return out
