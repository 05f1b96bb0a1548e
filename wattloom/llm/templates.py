"""Line dedup by a log-template tree of fixed depth.

A line's words holding digits are variable at once. Tree levels are the number of words and the leading ``depth`` words;
a leaf holds the lines that agree on these. Inside a leaf a word is constant at a level if it stands at its place in as many lines
as the level asks: ``min_docs``, twice, four times as many, and so on. The line with its variable words replaced is its template
at that level. However often the values of a field repeat in a large leaf, some level lies between them and the words of
the template, and the first level finds rare lines in hot leaves. This needs counts only, so the result does not depend on
the order of lines, and no task ever holds a leaf.

A template of any level recurs, and all its lines are dropped, if at least half of its words are constant and it stands in ``min_docs``
classes of documents. A class is a group of near-duplicates of whole texts (``minhash.near_duplicates``, similarity 0.8 on shingles
of five words), so copies and near copies of one document count once, however many there are, and are left to document dedup.
Only texts that hold a template of ``min_docs`` different texts are compared for this.

Lines of fewer than ``min_words`` words stay. Null texts stay null, empty ones empty; a text without recurring lines stays
byte for byte. Other columns, whatever their names, are carried along unread.
"""

from __future__ import annotations

import re

import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F

from . import minhash
from .common import BITS, KEY, as_bytes, bits_of, has_bit, map_arrow, released, row_key, stored

VARIABLE = "<*>"
DIGIT = re.compile(rb"[0-9]")
MIN_DOCS, MIN_WORDS, DEPTH = 10, 3, 3
CLASS_WIDTH, CLASS_PERCENT = 5, 80


def masked(line: bytes) -> list[bytes]:
    return [VARIABLE.encode() if DIGIT.search(w) else w for w in line.split()] if DIGIT.search(line) else line.split()


def leaf_of(words: list[bytes], depth: int) -> int:
    return xxhash.xxh3_64_intdigest(b"%d %s" % (len(words), b" ".join(words[:depth]))) - (1 << 63)


def tree_lines(docs: DataFrame, depth: int, min_words: int, bits: Broadcast | None = None) -> DataFrame:
    """One row for each line of ``min_words`` or more: key, hash of the text, line number and leaf; with ``bits``, the masked words of
    the lines whose leaf has its bit set."""
    with_words = bits is not None

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        cols: tuple[list, ...] = ([], [], [], [], [])
        marked = bits.value if with_words else None
        for key, doc, text in zip(*(batch.column(c).to_pylist() for c in (KEY, "doc", "t"))):
            for i, words in enumerate(map(masked, text.split(b"\n"))):
                if words and len(words) >= min_words:
                    leaf = leaf_of(words, depth)
                    at = leaf & (BITS - 1)
                    if not with_words or marked[at >> 3] >> (at & 7) & 1:
                        for col, v in zip(cols, (key, doc, i, leaf, b" ".join(words) if with_words else None)):
                            col.append(v)
        kinds = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
        names = [KEY, "doc", "line", "leaf", "words"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)][: 4 + with_words], names=names[: 4 + with_words])

    schema = f"{KEY} string, doc long, line int, leaf long" + ", words binary" * with_words
    return map_arrow(docs, run, schema, "t")


def levels(words: Column, least: int) -> Column:
    """The distinct templates of a line, from its words with their counts: one for each level that leaves half of the words constant."""
    top = F.greatest(F.array_max(F.transform(words, lambda w: w["lines"])), F.lit(least))
    doublings = F.sequence(F.lit(0), F.floor(F.log2(top / least)).cast("int"))

    def at(k: Column) -> Column:
        need = F.lit(least) * F.pow(F.lit(2.0), k)
        shown = F.transform(words, lambda w: F.when(w["lines"] >= need, w["word"]).otherwise(F.lit(VARIABLE)))
        return F.when(F.size(F.filter(words, lambda w: w["lines"] >= need)) * 2 >= F.size(words), F.array_join(shown, " "))

    return F.array_distinct(F.filter(F.transform(doublings, at), lambda t: t.isNotNull()))


def in_classes(held: DataFrame, rows: DataFrame, least: int) -> DataFrame:
    """(template) of those that stand in ``least`` classes of documents, stored; ``held`` has distinct (template, doc)."""
    wide = held.groupBy("template").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).select("template")
    held = stored(held.join(wide, "template", "left_semi"), "held")
    bits = bits_of(held, F.pmod("doc", F.lit(BITS)))

    def marked(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(has_bit(bits.value, batch.column(0).to_numpy() & (BITS - 1))))

    # texts that pass the bits by chance are classes that hold no template
    texts = stored(map_arrow(rows.select("doc", "t"), marked, "doc long, t binary", "t").select("doc", F.col("t").cast("string").alias("t")), "texts")
    bits.destroy()
    near = minhash.near_duplicates(texts, "doc", "t", CLASS_WIDTH, CLASS_PERCENT)
    released(texts)
    classes = near.groupBy("doc").agg(F.min("component_id").alias("class"))
    out = stored(
        held.join(classes, "doc").groupBy("template", "class").agg(F.count(F.lit(1)).alias("n"))
        .groupBy("template").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).select("template"),
        "recurring",
    )
    released(held)
    return out


def recurring_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_docs: int = MIN_DOCS,
                    depth: int = DEPTH, min_words: int = MIN_WORDS) -> DataFrame:
    """(key, line, template) of the lines with a template that recurs, each once; the key is ``row_key`` of id and text."""
    rows = docs.select(row_key(doc_id, text).alias(KEY), F.xxhash64(text).alias("doc"), as_bytes(text).alias("t"))
    seen = tree_lines(rows, depth, min_words)
    leaves = stored(
        seen.groupBy("leaf", "doc").agg(F.count(F.lit(1)).alias("n")).groupBy("leaf").agg(F.count(F.lit(1)).alias("texts")).filter(F.col("texts") >= min_docs).select("leaf"), "leaves"
    )
    bits = bits_of(leaves, F.pmod("leaf", F.lit(BITS)))
    lines = tree_lines(rows, depth, min_words, bits).join(leaves, "leaf", "left_semi")
    lines = stored(lines.withColumn("words", F.col("words").cast("string")).withColumn("form", F.xxhash64("leaf", "words")), "lines")
    bits.destroy()
    released(leaves)

    forms = lines.groupBy("leaf", "form").agg(F.first("words").alias("words"), F.count(F.lit(1)).alias("n"))
    places = forms.select("leaf", "form", "n", F.posexplode(F.split("words", " ")).alias("place", "word"))
    constant = places.filter(F.col("word") != VARIABLE).groupBy("leaf", "place", "word").agg(F.sum("n").alias("lines")).filter(F.col("lines") >= min_docs)
    templates = (
        places.join(constant, ["leaf", "place", "word"], "left")
        .groupBy("leaf", "form")
        .agg(F.array_sort(F.collect_list(F.struct("place", "word", F.coalesce("lines", F.lit(0)).alias("lines")))).alias("words"))
        .select("leaf", "form", F.explode(levels(F.col("words"), min_docs)).alias("template"))
    )
    placed = stored(lines.select(KEY, "doc", "line", "leaf", "form").join(templates, ["leaf", "form"]).select(KEY, "doc", "line", "template"), "templates")
    released(lines)
    recurring = in_classes(placed.select("template", "doc").distinct(), rows, min_docs)
    out = stored(placed.join(recurring, "template", "left_semi").groupBy(KEY, "line").agg(F.min("template").alias("template")), "recurring_lines")
    released(placed, recurring)
    return out


def without_recurring(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n_lines: str | None = None, n_dropped: str | None = None,
                      **parameters) -> DataFrame:
    """``docs`` with recurring lines taken out of ``text``; optionally the numbers of lines and of dropped lines."""
    gone = recurring_lines(docs, doc_id, text, **parameters).groupBy(KEY).agg(F.collect_set("line").alias("__gone"))
    columns = docs.columns
    keyed = docs.select(F.struct(*columns).alias("__row"), row_key(doc_id, text).alias(KEY)).join(gone, KEY, "left")
    old = F.col("__row")[text]
    lines = F.split(old, "\n", -1)
    new = F.when(F.col("__gone").isNull(), old).otherwise(
        F.array_join(F.filter(lines, lambda _, i: ~F.array_contains("__gone", i)), "\n"))
    out = [new.alias(c) if c == text else F.col("__row")[c].alias(c) for c in columns]
    if n_lines:
        out.append(F.when(old.isNull(), 0).otherwise(F.size(lines)).cast("long").alias(n_lines))
    if n_dropped:
        out.append(F.when(F.col("__gone").isNull(), 0).otherwise(F.size("__gone")).cast("long").alias(n_dropped))
    return keyed.select(*out)
