"""Personal data by fixed patterns and a semi-Markov conditional random field over whole spans.

Base: four patterns with their checks, leftmost non-overlapping for each kind. The field adds spans that no pattern states: written-out
addresses, phone numbers without a plus sign, cards and addresses with other separators.

The field works on windows: stretches of text with digits or an at sign, in pieces (runs of letters, runs of digits, single other
signs). A segmentation cuts a window into segments of at most ``MAX_UNITS`` pieces besides blanks and brackets, ``MAX_PIECES`` with them (the
bound of an entity), each with a kind or, for one piece, none. A segment is scored by features of the whole span (digits, groups, check sum, octets, shape, words before it) and
the kind of the segment before. Dynamic programming over pieces, lengths and kinds finds the best segmentation, so boundaries and kinds
are chosen together; the same sums give the gradient of the likelihood in training.

Training: at most ``SAMPLE_WINDOWS`` windows of ``SAMPLE_DOCS`` documents with digits or at signs (those with the least hash of id and
text) are labelled by the base patterns. Each labelled window comes also with its entities rewritten (at sign, dots, plus sign, separators), with
the labels kept, so that whole-span features carry over. Everything else, detection included, covers whole texts. Without
any such document (empty tables) all weights are zero and nothing is added to the base.

Null texts count as empty. Rows are judged one by one; repeated rows get equal results; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import map_arrow

KINDS = ("email", "ip", "card", "phone")
SAMPLE_DOCS, SAMPLE_WINDOWS, STEPS = 1000, 120, 40
MAX_UNITS, MAX_PIECES, WINDOW_PIECES = 15, 40, 120
NOT_UNITS = frozenset("[](){}<>")

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]")

Span = tuple[int, int, int]  # start, kind, end


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        total += v if i % 2 == 0 else (2 * v - 9 if v > 4 else 2 * v)
    return total % 10 == 0


def octets(parts: list[str]) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts)


def emails(text: str) -> list[tuple[int, int]]:
    """Matches of the address pattern, found from the at signs: the local part is the whole run before it."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        first = at
        while first > end and LOCAL_SET[min(ord(text[first - 1]), 128)]:
            first -= 1
        m = DOMAIN.match(text, at + 1) if first < at else None
        if m:
            out.append((first, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    return out


LOCAL_SET = [chr(c) in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-" for c in range(128)] + [False]


def base_spans(text: str) -> list[Span]:
    """Spans of the four patterns that pass their checks, by start, then kind."""
    out: list[Span] = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    for m in IP.finditer(text):
        if octets(m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if 14 <= m.end() - m.start():
            digits = NOT_DIGIT.sub("", m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


# --- windows -------------------------------------------------------------------------------------------------------

PIECE = re.compile(r"[0-9]+|[^\W\d_]+|[^\s]|\s+")
# a stretch with some digits, or an at sign, plain or written out; the words on both sides give context
DIGITS = re.compile(r"[+(]?[0-9][0-9 ()./\[\]_-]{5,}[0-9]|[0-9]+(?:\[?\.\]?[0-9]+){3}")
AT_SIGN = re.compile(r"[@＠]")
AT_WORD = re.compile(r"[\[({<][ ]?(?:at|AT)[ ]?[\])}>]")
AFTER_AT = re.compile(r"[ ]?\S+(?:[ ]?[\[({<][ ]?(?:dot|DOT)[ ]?[\])}>][ ]?[^\s\[({<]+)*")
BLANK = re.compile(r"\s")


def word_start(text: str, at: int, least: int) -> int:
    """Where the word that ends before ``at`` begins, not before ``least``."""
    while at > least and not text[at - 1].isspace():
        at -= 1
    return at


def stretches(text: str) -> list[tuple[int, int]]:
    """What may be an entity, by start. Every search begins at a sign and walks outwards, so long words are read once."""
    out, end = [(m.start(), m.end()) for m in DIGITS.finditer(text)], 0
    for m in AT_SIGN.finditer(text):
        if m.start() >= end:
            a = word_start(text, m.start(), end)
            blank = BLANK.search(text, m.end())
            end = blank.start() if blank else len(text)
            out.append((a, end))
    end = 0
    for m in AT_WORD.finditer(text):
        if m.start() < end:
            continue
        at = m.start() - (m.start() > end and text[m.start() - 1] == " ")
        a, rest = word_start(text, at, end), AFTER_AT.match(text, m.end())
        if a < at and rest:
            end = rest.end()
            out.append((a, end))
    return sorted(out)


def windows(text: str) -> list[tuple[int, int]]:
    """Stretches to be segmented: what may be an entity with up to three words around it, cut at line ends; overlapping ones are joined."""
    out: list[list[int]] = []
    for a, b in stretches(text):
        for _ in range(3):
            k = text.rfind(" ", max(0, a - 40), max(0, a - 1))
            if k < 0 or "\n" in text[k:a]:
                break
            a = k + 1
        e = text.find(" ", b + 1, b + 40)
        b = e if e > 0 and "\n" not in text[b:e] else b
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


class Window:
    """The pieces of a window and the features of its candidate segments.

    A window of more pieces than ``WINDOW_PIECES`` is worked on in parts that overlap by an entity's length.
    """

    def __init__(self, text: str):
        found = [(m.start(), m.end()) for m in PIECE.finditer(text)]
        self.text, self.at = text, found
        self.words = [text[a:b] for a, b in found]

    def segments(self) -> list[tuple[int, int, list[int]]]:
        """(first piece, pieces, features) of the spans that may be an entity: no space at the ends, no date; seven digits, an at sign or four numbers inside."""
        out = []
        n = len(self.words)
        for i in range(n):
            if self.words[i].isspace():
                continue
            digits = numbers = units = 0
            at = False
            for j in range(i, min(n, i + MAX_PIECES)):
                w = self.words[j]
                units += not w.isspace() and w not in NOT_UNITS
                if "\n" in w or units > MAX_UNITS:
                    break
                if w[0].isdigit():
                    digits, numbers = digits + len(w), numbers + 1
                at = at or w in "@＠" or w.lower() == "at"
                if (digits >= 7 or numbers == 4 or at and j > i + 1) and not w.isspace() and not DATE.fullmatch(self.text, self.at[i][0], self.at[j][1]):
                    out.append((i, j - i + 1, span_features(self.text, self.at[i][0], self.at[j][1], self.words[i: j + 1])))
        return out


FEATURES = 96
DOT_AFTER = re.compile(r"\s?[\[({<]\s?(?:dot|DOT)\s?[\])}>]")
DATE = re.compile(r"(?:19|20)[0-9]{2}([-/.])[0-9]{1,2}\1[0-9]{1,2}|[0-9]{1,2}([-/.])[0-9]{1,2}\2(?:19|20)[0-9]{2}")
CUES = {"tel": 0, "phone": 0, "call": 0, "mobile": 0, "fax": 0, "mail": 1, "email": 1, "contact": 1, "ip": 2, "host": 2, "server": 2, "card": 3, "visa": 3, "payment": 3}


def span_features(text: str, a: int, b: int, words: list[str]) -> list[int]:
    """Numbers of the features that hold for the whole span."""
    span = text[a:b]
    runs = [w for w in words if w[0].isdigit()]
    digits = sum(map(len, runs))
    letters = sum(len(w) for w in words if w[0].isalpha())
    before, after = text[a - 1: a], text[b: b + 1]
    plain = bool(runs) and not letters
    at = "@" in words or "＠" in words
    said_at = any(w.lower() == "at" for w in words)
    dots = words.count(".") + sum(w.lower() == "dot" for w in words)
    out = [0]
    out.append(1 + min(digits, 20))  # 1 .. 21
    out.append(22 + min(len(runs), 7))  # 22 .. 29
    if plain:
        out.append(30)
        flat = "".join(runs)
        if 14 <= digits <= 19:
            out.append(31 if luhn(flat) else 32)
        if 10 <= digits <= 15:
            out.append(33)
        if len(runs) == 4 and octets(runs):
            out.append(34 if dots == 3 else 35)
        if words[0] == "+" and words[-1][0].isdigit():
            out.append(36)
        if words[0] in "(+" or words[0].isdigit():
            out.append(37)
        if 2 <= len(runs) <= 5 and max(map(len, runs)) <= 4:
            out.append(38)
        if "(" in words and ")" in words and words.index("(") < words.index(")"):
            out.append(39)
        if len(runs) >= 3 and len(runs[-1]) == 4 and len(runs[-2]) == 3:
            out.append(40)
        if len(set(map(len, runs))) == 1 and len(runs) > 1:
            out.append(41)
        if len(runs) == 1:
            out.append(42)
        kinds = {w if not w.isspace() else " " for w in words if not w[0].isdigit()} - {"+", "(", ")", " "}
        out.append(43 + min(len(kinds), 3))  # 43 .. 46
        out.append(47 if kinds <= {"-"} else 48 if kinds <= {"."} else 49)
    elif letters:
        out.append(50 if runs else 51)
    if at:
        k = span.index("@") if "@" in span else span.index("＠")
        left, right = span[:k], span[k + 1:]
        good = bool(left) and "." in right and not re.search(r"\s", span)
        out.append(52 if good else 53)
        if good and DOMAIN.fullmatch(right):
            out.append(54)
        if LOCAL.match(left):
            out.append(55)
    elif said_at:
        out.append(56 if re.fullmatch(r"[\w.%+-]+\s?[\[({<]\s?(?:at|AT)\s?[\])}>]\s?[\w-]+(?:(?:\.|\s?[\[({<]\s?(?:dot|DOT)\s?[\])}>]\s?)[\w-]+)+", span) else 57)
    if before and not before.isspace():
        out.append(58 if before.isdigit() else 59 if before.isalpha() else 60 if before in ".+@-_%" else 61)
    else:
        out.append(62)
    if after and not after.isspace():
        tail = text[b + 1: b + 2]
        out.append(63 if after.isdigit() else 64 if after.isalpha() else 65 if after in "-@_" or after in ".)" and tail.isalnum() else 66)
    else:
        out.append(67)
    if not words[-1][0].isalnum():
        out.append(68)
    if not words[0][0].isalnum() and words[0] not in "+(":
        out.append(69)
    for w in re.findall(r"[^\W\d_]+", text[max(0, a - 30): a].lower())[-2:]:
        if w in CUES:
            out.append(70 + CUES[w])
    if plain and re.fullmatch(r"(?:\+?[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-]?[0-9]{3}[ .-]?[0-9]{4}", span):
        out.append(74)
    if plain and re.fullmatch(r"[0-9]{1,3}(?:(?:\.|\[\.\]| \. )[0-9]{1,3}){3}", span):
        out.append(75)
    if DOT_AFTER.match(text, b):
        out.append(76)
    return out


# --- the field -----------------------------------------------------------------------------------------------------

STATES = len(KINDS) + 1  # the last state is "none"
NONE = len(KINDS)


class Field:
    """Weights of a semi-Markov conditional random field: kind by feature, and kind after kind."""

    def __init__(self, weights: np.ndarray | None = None, after: np.ndarray | None = None):
        self.weights = np.zeros((len(KINDS), FEATURES)) if weights is None else weights
        self.after = np.zeros((STATES, STATES)) if after is None else after

    def scores(self, segments) -> list[np.ndarray]:
        return [self.weights[:, f].sum(axis=1) for _, _, f in segments]

    def best(self, n: int, segments) -> list[tuple[int, int, int]]:
        """(first piece, pieces, kind) of the entities in the best segmentation of ``n`` pieces."""
        ends: list[list[int]] = [[] for _ in range(n + 1)]
        for s, (i, size, _) in enumerate(segments):
            ends[i + size].append(s)
        scores = self.scores(segments)
        value = np.full((n + 1, STATES), -np.inf)
        value[0, NONE] = 0
        back: list[list] = [[None] * STATES for _ in range(n + 1)]
        for e in range(1, n + 1):
            step = value[e - 1] + self.after[:, NONE]
            p = int(step.argmax())
            value[e, NONE], back[e][NONE] = step[p], (e - 1, p, None)
            for s in ends[e]:
                i, size, _ = segments[s]
                for y in range(len(KINDS)):
                    step = value[i] + self.after[:, y]
                    p = int(step.argmax())
                    if step[p] + scores[s][y] > value[e, y]:
                        value[e, y], back[e][y] = step[p] + scores[s][y], (i, p, size)
        out, e, y = [], n, int(value[n].argmax())
        while e:
            i, p, size = back[e][y]
            if y != NONE:
                out.append((i, size, y))
            e, y = i, p
        return out[::-1]

    def gradient(self, n: int, segments, gold: list[tuple[int, int, int]]) -> tuple[float, np.ndarray, np.ndarray]:
        """Log-likelihood of the gold entities and its gradient, by forward and backward sums over segmentations."""
        scores = self.scores(segments)
        by_end: list[list[int]] = [[] for _ in range(n + 1)]
        by_start: list[list[int]] = [[] for _ in range(n + 1)]
        for s, (i, size, _) in enumerate(segments):
            by_end[i + size].append(s)
            by_start[i].append(s)
        a = np.full((n + 1, STATES), -np.inf)
        a[0, NONE] = 0
        into = np.full((n + 1, STATES), -np.inf)  # log sum over the state before, for a segment that begins here
        for e in range(n + 1):
            if e:
                a[e, NONE] = into[e - 1, NONE]
                for s in by_end[e]:
                    a[e, :NONE] = np.logaddexp(a[e, :NONE], into[segments[s][0], :NONE] + scores[s])
            into[e] = np.logaddexp.reduce(a[e][:, None] + self.after, axis=0)
        b = np.full((n + 1, STATES), -np.inf)
        b[n] = 0
        out_of = np.full((n + 1, STATES), -np.inf)  # log sum of what may begin here with a state
        for i in range(n - 1, -1, -1):
            out_of[i, NONE] = b[i + 1, NONE]
            for s in by_start[i]:
                out_of[i, :NONE] = np.logaddexp(out_of[i, :NONE], scores[s] + b[i + segments[s][1], :NONE])
            b[i] = np.logaddexp.reduce(self.after + out_of[i][None, :], axis=1)
        z = np.logaddexp.reduce(a[n])
        g, h = np.zeros_like(self.weights), np.zeros_like(self.after)
        for i in range(n):
            h -= np.exp(a[i][:, None] + self.after + out_of[i][None, :] - z)
        for s, (i, size, f) in enumerate(segments):
            g[:, f] -= np.exp(into[i, :NONE] + scores[s] + b[i + size, :NONE] - z)[:, None]
        where = {(i, size): s for s, (i, size, _) in enumerate(segments)}
        total, e, before, k = -z, 0, NONE, 0
        while e < n:
            if k < len(gold) and gold[k][0] == e:
                i, size, y = gold[k]
                s = where[i, size]
                total += scores[s][y] + self.after[before, y]
                g[y, segments[s][2]] += 1
                h[before, y] += 1
                before, e, k = y, e + size, k + 1
            else:
                total += self.after[before, NONE]
                h[before, NONE] += 1
                before, e = NONE, e + 1
        return total, g, h


def rewritten(text: str, spans: list[Span], seed: int) -> tuple[str, list[Span]]:
    """The window with its entities written another way, and their new places."""
    out, moved, at = [], [], 0
    for start, kind, end in spans:
        old = text[start:end]
        if kind == 0:
            new = [old.replace("@", "[at]"), old.replace("@", " [at] ").replace(".", "[dot]"), old.replace("@", " (at) "), old.replace("@", "＠"), old.replace("@", " [at] ").replace(".", " [dot] ")][seed % 5]
        elif kind == 1:
            new = [old.replace(".", "[.]"), old.replace(".", " . "), old, old.replace(".", "[.]", 1)][seed % 4]
        elif kind == 2:
            digits = NOT_DIGIT.sub("", old)
            new = [".", "/", "_", " - "][seed % 4].join(digits[i: i + 4] for i in range(0, len(digits), 4))
        else:
            new = [old.lstrip("+"), re.sub(r"^\+[0-9]+ ?", "", old), old.replace("-", ".").replace(" ", "").lstrip("+"), re.sub(r"[()]", "", re.sub(r"^\+[0-9]+ ?", "", old))][seed % 4]
        out += [text[at:start], new]
        first = sum(map(len, out)) - len(new)
        moved.append((first, kind, first + len(new)))
        at = end
    return "".join([*out, text[at:]]), moved


def example(text: str, spans: list[Span]) -> tuple[int, list, list] | None:
    """(pieces, segments, gold entities), or None if an entity is no candidate segment (its borders cut a piece)."""
    w = Window(text)
    if not w.words or len(w.words) > WINDOW_PIECES:
        return None
    segments = w.segments()
    starts, ends = {a: i for i, (a, _) in enumerate(w.at)}, {b: i + 1 for i, (_, b) in enumerate(w.at)}
    known, gold, last = {(i, size) for i, size, _ in segments}, [], 0
    for start, kind, end in spans:
        if start not in starts or end not in ends or (starts[start], ends[end] - starts[start]) not in known or starts[start] < last:
            return None
        gold.append((starts[start], ends[end] - starts[start], kind))
        last = ends[end]
    return len(w.words), segments, gold


def fit(texts: list[str], steps: int = STEPS, rate: float = 0.3, penalty: float = 0.002) -> Field:
    """Maximum likelihood (with a penalty) by adaptive gradient steps; the order of the texts does not matter."""
    examples = []
    for text in sorted(set(texts)):
        spans = base_spans(text)
        plain = [s for i, s in enumerate(spans) if not i or s[0] >= spans[i - 1][2]]
        seed = zlib.crc32(text.encode())
        for t, sp in [(text, plain)] + ([rewritten(text, plain, seed + k) for k in range(2)] if plain else []):
            one = example(t, sp)
            if one:
                examples.append(one)
    field = Field()
    if not examples:
        return field
    seen = [np.full_like(field.weights, 1e-6), np.full_like(field.after, 1e-6)]
    for _ in range(steps):
        g, h = -penalty * len(examples) * field.weights, -penalty * len(examples) * field.after
        for one in examples:
            _, dg, dh = field.gradient(*one)
            g, h = g + dg, h + dh
        for w, d, s in ((field.weights, g, seen[0]), (field.after, h, seen[1])):
            s += d * d
            w += rate * d / np.sqrt(s)
    return field


def added_spans(text: str, base: list[Span], field: Field) -> list[Span]:
    """Entities of the best segmentations that touch no base span."""
    out: list[Span] = []
    taken = sorted((a, b) for a, _, b in base)
    for a, b in windows(text):
        free, at = [], a
        for x, y in taken:
            if y > a and x < b:
                free.append((at, x))
                at = max(at, y)
        free.append((at, b))
        # only stretches that a base span does not fill
        if not any(stretches(text[x:y]) for x, y in free if y - x >= 6):
            continue
        w = Window(text[a:b])
        done = 0
        while done < len(w.words):
            part = Window.__new__(Window)
            part.text, part.at, part.words = w.text, w.at[done: done + WINDOW_PIECES], w.words[done: done + WINDOW_PIECES]
            found = field.best(len(part.words), part.segments())
            last = done + WINDOW_PIECES >= len(w.words)
            cut = WINDOW_PIECES - MAX_PIECES
            for i, size, kind in found:
                if last or i < cut:
                    out.append((a + part.at[i][0], kind, a + part.at[i + size - 1][1]))
            # go on behind the last entity that was taken, or at the overlap
            done = len(w.words) if last else done + max([cut, *[i + size for i, size, _ in found if i < cut]])
    return [(s, k, e) for s, k, e in out if all(e <= x or s >= y for x, y in taken)]


def span_list(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


HINT = re.compile(r"[0-9@＠]|[\[({<] ?(?:at|AT) ?[\])}>]")
OUT = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def training_windows(docs: DataFrame, doc_id: str, text: str, sample_docs: int, sample_windows: int) -> list[str]:
    """Texts of at most ``sample_windows`` windows of the ``sample_docs`` documents with the least hash."""
    marked = docs.filter(F.col(text).rlike("[0-9@]")).select(F.col(text).cast("binary").alias("t"), F.xxhash64(F.col(doc_id), F.col(text)).alias("h"))
    # only hashes are sorted; the texts below the last of them are read where they are
    last = marked.select("h").orderBy("h").limit(sample_docs).agg(F.max("h")).first()[0]
    if last is None:
        return []
    picked = marked.filter(F.col("h") <= last)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found, marks = [], []
        for t, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            s = t.decode()
            for a, b in windows(s):
                if b - a <= 400:
                    found.append(s[a:b])
                    marks.append(h)
        return pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(marks, pa.int64())], names=["w", "h"])

    return [r["w"] for r in map_arrow(picked, run, "w string, h long", "t").orderBy("h", "w").limit(sample_windows).collect()]


def detect(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", field: Field | None = None, sample_docs: int = SAMPLE_DOCS,
           sample_windows: int = SAMPLE_WINDOWS) -> DataFrame:
    """One row per document: doc_id, base counts, base_sha256, spans (base and added), n_added."""
    field = field if field is not None else fit(training_windows(docs, doc_id, text, sample_docs, sample_windows))
    weights, after = field.weights, field.after
    names = [doc_id, *[x.split()[0] for x in OUT.split(", ")]]
    nothing = hashlib.sha256(b"").hexdigest()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        model = Field(weights, after)
        rows = []
        for s in batch.column("__text").to_pylist():
            if not s or not HINT.search(s):
                rows.append((0, 0, 0, 0, nothing, "", 0))
                continue
            base = base_spans(s)
            more = added_spans(s, base, model)
            counts = [sum(k == kind for _, k, _ in base) for kind in range(len(KINDS))]
            rows.append((*counts, hashlib.sha256(span_list(base).encode()).hexdigest(), span_list(base + more), len(more)))
        cols = list(zip(*rows))
        kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([batch.column(doc_id), *[pa.array(c, k) for c, k in zip(cols, kinds)]], names=names)

    schema = T.StructType([docs.schema[doc_id]] + T.StructType.fromDDL(OUT).fields)
    return map_arrow(docs.select(doc_id, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("__text")), run, schema, "__text")
