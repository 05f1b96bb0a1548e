"""The corpus pipeline over ``documents``: quality rules, line dedup, near-duplicate removal, benchmark decontamination, packing.

Every stage is a function of (spark, docs, sf_dir) and returns what the next one works on; all but the last return
the columns of documents. ``run`` writes each stage's result to the shared folder and reads it again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from wattloom.llm import minhash, packing, quality, templates, tiling
from wattloom.llm.common import stored, table, with_word_counts

CAPACITY = 2048


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or lose over half of their words to the line rules go."""
    return quality.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go; ``n_chars`` follows the text. No document is dropped, even if no line is left."""
    left = templates.without_recurring(docs)
    return left.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in left.columns else left


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group at similarity 0.8 on shingles of five words, the document with the smallest id stays."""
    return minhash.drop_near_duplicates(docs, width=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which tiles cover three fifths of a benchmark item go."""
    return tiling.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents packed into sequences of ``CAPACITY`` words, no source or equal text twice in one."""
    items = docs.select("doc_id", "source", "text", F.xxhash64("text").alias("copies"))
    return packing.best_fit(with_word_counts(items, "text", "n"), "doc_id", "n", "source", "copies", capacity=CAPACITY)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: Signatures, components and best fit are not expressible in SQL; tests hold the rows against plain Python versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
