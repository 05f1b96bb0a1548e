"""Quality rules, line first: rules judge single lines, failing lines are removed, and a document that loses too
much of its text is rejected.

Line rules (a line with words fails if one applies):

* navigation: at least ``nav_marks`` separator words (``|``, ``»``, ``/`` ...), or over a fifth of the words are separators;
* punctuation: no word ends a sentence; or symbols (``#*$%&|<>``) outnumber a third of the words; or doubled
  exclamation marks end over a third of them;
* boilerplate: a known phrase, a line repeated earlier in the text, or one word making up most of a longer line.

Empty and null texts have no words: they fail the base rule (fewer than 10 words) and are not kept. Every row is judged
on its own, so repeated rows get equal results; extra columns are not read. No shuffle, memory of one batch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import as_bytes, covered, map_arrow, window_names, word_hashes

MIN_WORDS, REPEAT_WINDOW, MAX_REPEAT_PERCENT = 10, 5, 20

SYMBOLS = [bytes([c]) for c in b"#*$%&|<>"]
SEPARATORS = {b"|", b"||", b"/", b"//", b">", b">>", b"<", b"<<", b"-", b"\xc2\xbb", b"\xc2\xab", b"\xc2\xb7", b"\xe2\x80\xa2"}
ENDS = (b".", b"!", b"?", b"\xe2\x80\xa6", b"\xe3\x80\x82", b"\xef\xbc\x81", b"\xef\xbc\x9f", b'."', b'!"', b'?"', b".)", b":", b";")
PHRASES = [
    b"all rights reserved", b"terms of use", b"terms of service", b"privacy policy", b"cookie policy", b"accept cookies",
    b"accept all cookies", b"enable javascript", b"lorem ipsum", b"sign up now", b"log in to", b"click here", b"subscribe to our",
    b"skip to content", b"skip to main content", b"powered by", b"licensed under", b"released under the", b"distributed under the",
    b"copyright (c)", b"copyright \xc2\xa9",
]

OUT = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
       "n_bad_lines long, n_lost_words long, kept boolean")


class LineRules:
    """The line rules for one text; what the whole text lacks is not looked for in its lines."""

    def __init__(self, text: bytes, words: list[bytes], nav_marks: int = 3):
        self.nav_marks = nav_marks
        self.marks = not SEPARATORS.isdisjoint(words)
        self.symbols = [c for c in SYMBOLS if c in text]
        low = text.lower()
        self.phrases = [p for p in PHRASES if p in low]

    def fails(self, line: bytes, words: list[bytes]) -> bool:
        """Whether one line (with at least one word) is navigation, boilerplate or not sentences."""
        n = len(words)
        if self.marks:
            marks = sum(w in SEPARATORS for w in words)
            if marks >= self.nav_marks or 5 * marks > n:
                return True
        if not any(w.endswith(ENDS) for w in words):
            return True
        if n >= 3 and self.symbols and 3 * sum(map(line.count, self.symbols)) > n:
            return True
        if n >= 6 and b"!!" in line and 3 * sum(w.endswith(b"!!") for w in words) > n:
            return True
        if n >= 10 and one_word_rules(words):
            return True
        return bool(self.phrases) and any(p in low for low in [line.lower()] for p in self.phrases)


def one_word_rules(words: list[bytes]) -> bool:
    """Whether one word is over half of the words: only the majority candidate can be."""
    # a word on over half of the places is met at every other place, or at two places in a row
    return any(2 * words.count(w) > len(words) for w in {*words[:2], *(a for a, b in zip(words, words[1:]) if a == b)})


def judge(text: bytes, max_lost: float) -> tuple:
    words = text.split()
    n = len(words)
    checks = LineRules(text, words)
    seen: set[bytes] = set()
    dup = bad = lost = 0
    for line in text.split(b"\n"):
        own = line.split()
        if not own:
            continue
        again = line in seen
        dup += again
        seen.add(line)
        if again or checks.fails(line, own):
            bad += 1
            lost += len(own)
    repeats = 0
    if n >= REPEAT_WINDOW:
        names = window_names(word_hashes(text), REPEAT_WINDOW)
        values, where, counts = np.unique(names, return_inverse=True, return_counts=True)
        if len(values) < len(names):
            repeats = int(covered(n, np.flatnonzero(counts[where] > 1), REPEAT_WINDOW).sum())
    chars = sum(map(len, words)) - int(np.count_nonzero((np.frombuffer(text, np.uint8) & 0xC0) == 0x80))
    failed = n < MIN_WORDS or 100 * repeats > MAX_REPEAT_PERCENT * n
    return n, chars, sum(map(text.count, SYMBOLS)), dup, repeats, failed, bad, lost, not failed and lost <= max_lost * n


def rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", max_lost: float = 0.5, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: ``doc_id``, the base counts, bad lines, lost words and the verdict ``kept``."""
    names = [x.split()[0] for x in OUT.split(", ")]
    schema = T.StructType([docs.schema[c] for c in (doc_id, *carry)] + T.StructType.fromDDL(OUT).fields)
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        judged = list(zip(*[judge(x, max_lost) for x in batch.column("__bytes").to_pylist()]))
        own = [batch.column(c) for c in (doc_id, *carry)]
        kinds_out = [pa.bool_() if x in ("base_failed", "kept") else pa.int64() for x in names]
        return pa.RecordBatch.from_arrays([*own, *[pa.array(v, k) for v, k in zip(judged, kinds_out)]], names=[doc_id, *carry, *names])

    return map_arrow(docs.select(doc_id, *carry, as_bytes(text).alias("__bytes")), run, schema, "__bytes")


def keep_good(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", max_lost: float = 0.5) -> DataFrame:
    """The accepted rows of ``docs``, with their columns: a filter, no join (the verdict travels with the row)."""
    cols = docs.columns
    packed = docs.select(F.struct(*cols).alias("__row"), F.lit(0).cast("long").alias("__id"), F.col(text).alias("__text"))
    judged = rules(packed, "__id", "__text", max_lost, carry=("__row",))
    return judged.filter("kept").select("__row.*")
