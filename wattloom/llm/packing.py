"""Best-fit packing into sequences of a fixed number of tokens, with conflicts.

A document longer than a sequence gives full sequences of its own and a rest; rests and shorter documents are packed. Two
pieces may not share a bin if they are of one source or of one duplicate cluster. Bins are ordered by residual capacity; the
search begins at the successor of the piece's size (the tightest bin that can hold it) and goes on to the next larger
residual until a compatible bin is found, else a bin is opened. Each bin has a bitmap of its sources and one of its
clusters.

Best fit is sequential, so documents are dealt by a hash of their row to shards of about ``shard_docs`` documents; every shard is
packed on its own, largest piece first. Shards keep their size however large the input or one source is. What is lost is at most the
open bins at the end of each shard.

Null lengths and lengths below one count as zero and give no piece. A null source or cluster conflicts with nothing. Repeated rows
are packed each.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from .common import stored

OUT = "piece int, n_tokens long, shard long, bin long, start long, bin_used long"


def pack(pieces: list[tuple[int, int, int]], capacity: int) -> list[tuple[int, int]]:
    """(bin, start) for pieces of (size, source bit, cluster bit) in the given order; bits of 0 conflict with nothing."""
    residuals: list[tuple[int, int]] = []  # (residual, bin), ascending
    sources: list[int] = []
    clusters: list[int] = []
    out = []
    for size, source, cluster in pieces:
        at = bisect_left(residuals, (size, -1))
        while at < len(residuals):
            b = residuals[at][1]
            if not (sources[b] & source or clusters[b] & cluster):
                break
            at += 1
        if at < len(residuals):
            left, b = residuals.pop(at)
        else:
            left, b = capacity, len(sources)
            sources.append(0)
            clusters.append(0)
        out.append((b, capacity - left))
        sources[b] |= source
        clusters[b] |= cluster
        if left > size:
            insort(residuals, (left - size, b))
    return out


def pack_shard(rows: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """Pieces of one shard with their bins; ``rows`` has n, source, cluster and the columns that order ties."""
    rows = rows.sort_values(["n", "tie"], ascending=[False, True], kind="stable", ignore_index=True)
    n = rows["n"].to_numpy()
    def codes(values) -> list[int]:
        own: dict = {}
        return [0 if v is None or v != v else 1 << own.setdefault(v, len(own)) for v in values]

    # a cluster met once in the shard cannot conflict; leaving it out keeps the bitmaps short
    often = rows["cluster"].map(rows["cluster"].value_counts()) > 1
    source, cluster = codes(rows["source"]), codes(rows["cluster"].where(often, None))
    whole = n // capacity
    rest = n - whole * capacity
    order = sorted(range(len(rows)), key=lambda i: (-rest[i], i))
    order = [i for i in order if rest[i]]
    placed = pack([(int(rest[i]), source[i], cluster[i]) for i in order], capacity)
    used: dict[int, int] = {}
    for i, (b, start) in zip(order, placed):
        used[b] = start + int(rest[i])
    out = [(i, int(whole[i]), int(rest[i]), b, start, used[b]) for i, (b, start) in zip(order, placed)]
    free = len(used)
    for i in range(len(rows)):
        for k in range(int(whole[i])):
            out.append((i, k, capacity, free, 0, capacity))
            free += 1
    at = [x[0] for x in out]
    cols = rows.drop(columns=["n", "tie", "cluster"]).iloc[at].reset_index(drop=True)
    for name, k in (("piece", 1), ("n_tokens", 2), ("bin", 3), ("start", 4), ("bin_used", 5)):
        cols[name] = [x[k] for x in out]
    return cols


def best_fit(items: DataFrame, doc_id: str, length: str, source: str, cluster: str, capacity: int = 2048, shard_docs: int = 4000) -> DataFrame:
    """One row per piece: ``doc_id``, source, piece number, n_tokens, shard, bin (unique within the shard), start, bin_used."""
    rows = items.select(
        F.col(doc_id).alias("doc"), F.col(source).cast("string").alias("source"), F.when(F.col(cluster).isNotNull(), F.hex(F.xxhash64(cluster))).alias("cluster"),
        F.greatest(F.coalesce(F.col(length).cast("long"), F.lit(0)), F.lit(0)).alias("n"))
    rows = stored(rows.filter("n > 0"), "items")
    shards = max(1, -(-rows.count() // shard_docs))
    tie = F.xxhash64("doc", "n", "cluster")
    dealt = rows.withColumn("tie", tie).withColumn("shard", F.pmod(F.col("tie"), F.lit(shards)))
    schema = T.StructType([T.StructField("doc", rows.schema["doc"].dataType), T.StructField("source", T.StringType())] + T.StructType.fromDDL(OUT).fields)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pack_shard(pdf.drop(columns=["shard"]), capacity).assign(shard=key[0])[[f.name for f in schema]]

    return dealt.groupBy("shard").applyInPandas(run, schema).withColumnRenamed("doc", doc_id)
