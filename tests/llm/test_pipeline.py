"""The pipeline and its stages against plain Python versions."""

from __future__ import annotations

import brute
import pytest

import corpus_pipeline as P
from wattloom.llm import quality


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def good(text):
    return quality.judge((text or "").encode(), 0.5)[-1] and not brute.quality_base(text)[-1]


def leaking(docs, bench):
    out = set()
    items = [(b, brute.words(brute.lower(b))) for b in bench]
    for i, t in docs:
        own = brute.words(brute.lower(t))
        have = {tuple(own[k:k + 5]) for k in range(len(own) - 4)}
        for b, item in items:
            if any(tuple(item[k:k + 5]) in have for k in range(len(item) - 4)) and 100 * brute.tiled(t, b) >= 60 * len(item):
                out.add(i)
                break
    return out


def test_whole_run(spark, folder):
    docs = rows_of(spark.read.parquet(f"{folder}/documents.parquet"))
    docs = sorted((i, t) for i, t in docs if good(t))
    gone = brute.recurring_lines([t for _, t in docs])
    docs = [(i, "\n".join(x for k, x in enumerate(t.split("\n")) if k not in g)) for (i, t), g in zip(docs, gone)]
    classes = brute.near_duplicates(docs, width=5)
    docs = [(i, t) for i, t in docs if classes[i][1] == i]
    leaks = leaking(docs, [r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()])
    docs = [(i, t) for i, t in docs if i not in leaks]
    packed = {}
    for r in P.run(spark, folder).collect():
        packed[r.doc_id] = packed.get(r.doc_id, 0) + r.n_tokens
    assert packed == {i: n for i, t in docs if (n := len(brute.words(t)))}


def test_clean_documents_stay(spark, folder):
    """Labelled documents of good quality leave the first stage only by its base rules."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    clean = {r.doc_id for r in spark.read.parquet(f"{folder}/labels.parquet").filter("quality = 1").collect()}
    kept = {i for i, _ in rows_of(P.quality_rules(spark, docs, folder))}
    lost = {i: t for i, t in rows_of(docs) if i in clean and i not in kept}
    assert all(brute.quality_base(t)[-1] for t in lost.values())


@pytest.mark.parametrize("name,stage", P.STAGES)
def test_stages_on_odd_and_empty_tables(spark, folder, frame, odd_rows, name, stage):
    docs = frame(odd_rows)
    got = stage(spark, docs, folder)
    if name != P.STAGES[-1][0]:
        assert got.columns == docs.columns and got.schema.simpleString() == docs.schema.simpleString()
    assert got.count() > 0 and stage(spark, frame([]), folder).count() == 0


def test_stage_order():
    assert [n for n, _ in P.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "decontamination", "best_fit_packing"]
