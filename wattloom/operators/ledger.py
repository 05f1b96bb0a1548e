"""Tamper-evident ledger: hashed rows, fixed-size blocks, a header chain per ledger."""

from __future__ import annotations

import hashlib
import json

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from .folds import Arrays, ordered_fold
from .series import null_safe_join, ordinal, over_series, running

ZERO_HASH = "0" * 64
GENESIS_ROOT = hashlib.sha256(b"GENESIS").hexdigest()
GENESIS_TIME = "1970-01-01 00:00:00"
HEADER = ["alert_count", "index", "normal_count", "previous_hash", "proposer", "row_end", "row_start",
          "source_file", "timestamp", "transaction_count", "transaction_root"]


def canonical_json(columns: dict[str, Column]) -> Column:
    """Sorted keys, no spaces; text is trimmed and null becomes empty."""
    return F.to_json(F.struct(*[columns[k].alias(k) for k in sorted(columns)]))


def text(c: str) -> Column:
    return F.coalesce(F.trim(F.col(c)), F.lit(""))


def ledger_rows(df: DataFrame, chain: str, order: list[str], payload: dict[str, Column]) -> DataFrame:
    """1-based row index per chain and the hash of the row's canonical form."""
    df = ordinal(df, [chain], order, rn="row_index")
    return df.withColumn("row_hash", F.sha2(canonical_json({**payload, "row_index": F.col("row_index")}), 256))


def ledger_blocks(rows: DataFrame, chain: str, size: int, authorities: list[str]) -> DataFrame:
    """Blocks of ``size`` rows: root over the ordered row hashes, counts, range, round-robin proposer."""
    rows = rows.withColumn("block_index", F.floor((F.col("row_index") - 1) / size) + 1)
    hashes = F.array_sort(F.collect_list(F.struct("row_index", "row_hash")))
    out = rows.groupBy(chain, "block_index").agg(
        F.sha2(F.array_join(F.transform(hashes, lambda x: x["row_hash"]), "|"), 256).alias("transaction_root"),
        F.count(F.lit(1)).alias("transaction_count"),
        F.sum((F.upper("statut") == "ALERTE").cast("long")).alias("alert_count"),
        F.min("row_index").alias("row_start"), F.max("row_index").alias("row_end"),
        F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("timestamp"))
    return out.withColumn("normal_count", F.col("transaction_count") - F.col("alert_count")).withColumn("proposer", proposer(F.col("block_index"), authorities))


def proposer(index: Column, authorities: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(a) for a in authorities]), (index % len(authorities) + 1).cast("int"))


def header_hash(row: dict) -> str:
    return hashlib.sha256(json.dumps(row, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def genesis(authorities: list[str]) -> dict:
    head = {"index": 0, "timestamp": GENESIS_TIME, "previous_hash": ZERO_HASH, "proposer": authorities[0], "transaction_root": GENESIS_ROOT,
            "transaction_count": 0, "alert_count": 0, "normal_count": 0, "row_start": 0, "row_end": 0, "source_file": "genesis"}
    return head | {"block_hash": header_hash(head)}


class ChainTail:
    """Hash of the last block of a chain, starting from its genesis block."""

    def __init__(self, authorities: list[str]) -> None:
        self.hash = genesis(authorities)["block_hash"]


def link(tail: ChainTail, blocks: Arrays, chain: str, source: str) -> Arrays:
    """Hash the headers of consecutive blocks onto the tail."""
    numbers = ["block_index", "transaction_count", "alert_count", "normal_count", "row_start", "row_end"]
    texts = ["timestamp", "proposer", "transaction_root"]
    before, after = [], []
    for row in zip(*[blocks[c].tolist() for c in (*numbers, *texts)]):
        head = dict(zip((*numbers, *texts), row))
        head["index"] = head.pop("block_index")
        before.append(tail.hash)
        tail.hash = header_hash({**head, "previous_hash": tail.hash, "source_file": source})
        after.append(tail.hash)
    n = len(after)
    return {chain: blocks[chain], "block_index": blocks["block_index"], "timestamp": blocks["timestamp"], "previous_hash": np.array(before, dtype=object),
            "proposer": blocks["proposer"], "transaction_root": blocks["transaction_root"], **{c: blocks[c] for c in numbers[1:]},
            "source_file": np.full(n, source, dtype=object), "block_hash": np.array(after, dtype=object)}


def chain_schema(chain: str) -> str:
    return (f"{chain} string, block_index long, timestamp string, previous_hash string, proposer string, transaction_root string, "
            "transaction_count long, alert_count long, normal_count long, row_start long, row_end long, source_file string, block_hash string")


def ledger_chain(blocks: DataFrame, chain: str, authorities: list[str], source: str = "readings") -> DataFrame:
    """Chain the block headers. Only headers are sequential, per chain; hashing rows and roots is parallel."""
    return ordered_fold(blocks, [chain], ["block_index"], lambda: ChainTail(authorities),
                        lambda tail, rows: link(tail, rows, chain, source), chain_schema(chain))


def genesis_rows(chains: DataFrame, chain: str, authorities: list[str]) -> DataFrame:
    g = genesis(authorities)
    kinds = dict(x.split() for x in chain_schema(chain).split(", "))
    cols = {("block_index" if k == "index" else k): v for k, v in g.items()}
    return chains.select(chain, *[F.lit(cols[c]).cast(k).alias(c) for c, k in kinds.items() if c != chain])


def header_json() -> Column:
    return canonical_json({h: F.col("block_index" if h == "index" else h) for h in HEADER})


def validate(stored: DataFrame, roots: DataFrame, chain: str, authorities: list[str]) -> DataFrame:
    """Errors of every stored block: count, root, proposer, link to the predecessor, header hash, row range."""
    linked = over_series(stored, [chain], ["block_index"], lambda w: {"__prev": F.lag("block_hash").over(w)}, back=1)
    expected = roots.select(chain, "block_index", F.col("transaction_root").alias("__root"), F.col("transaction_count").alias("__count"))
    rows = null_safe_join(linked, expected, [chain, "block_index"], "left")
    before = F.coalesce("__prev", F.lit(genesis(authorities)["block_hash"]))
    errors = F.array_compact(F.array(
        F.when(F.coalesce("__count", F.lit(0)) != F.col("transaction_count"), "transaction_count mismatch"),
        F.when(F.coalesce("__root", F.lit(GENESIS_ROOT)) != F.col("transaction_root"), "transaction root mismatch"),
        F.when(~F.col("proposer").isin(authorities), "unknown proposer"),
        F.when(F.col("previous_hash") != before, "previous hash mismatch"),
        F.when(F.sha2(header_json(), 256) != F.col("block_hash"), "block hash mismatch"),
        F.when(F.col("row_start") > F.col("row_end"), "invalid row range")))
    return rows.withColumn("errors", errors).drop("__prev", "__root", "__count")


def summary(chained: DataFrame, chain: str) -> DataFrame:
    """Totals per chain; the genesis block counts as a block without rows."""
    return chained.groupBy(chain).agg(
        (F.count(F.lit(1)) + 1).alias("total_blocks"), F.count(F.lit(1)).alias("data_blocks"), F.sum("transaction_count").alias("total_transactions"),
        F.sum("alert_count").alias("total_alerts"), F.sum("normal_count").alias("total_normals"), F.max_by("block_hash", "block_index").alias("latest_block_hash"))


def verified_rows(rows: DataFrame, sealed: DataFrame, chain: str, size: int) -> DataFrame:
    """Every row with the sealed block it is in; rows of open blocks get -1 and empty texts."""
    rows = rows.withColumn("__b", F.floor((F.col("row_index") - 1) / size) + 1)
    blocks = sealed.select(chain, F.col("block_index").alias("__b"), "block_index", "block_hash", "proposer")
    out = null_safe_join(rows, blocks, [chain, "__b"], "left").drop("__b")
    return out.withColumns({"block_index": F.coalesce("block_index", F.lit(-1).cast("long")),
                            "block_hash": F.coalesce("block_hash", F.lit("")), "proposer": F.coalesce("proposer", F.lit(""))})


def block_file(index: Column, row_start: Column, row_end: Column) -> Column:
    data = F.format_string("block_%04d_rows_%06d_%06d.json", index, row_start, row_end)
    return F.when(index == 0, "block_0000_genesis.json").otherwise(data)


def anchor_candidates(chained: DataFrame, every: int) -> DataFrame:
    """Blocks that reach ``every`` blocks since the last anchored one (none anchored counts as index -1)."""
    return chained.filter(F.col("block_index") % every == every - 1)


def anchor_audit(submissions: DataFrame, keys: list[str], order: list[str], index: str, hash_: str) -> DataFrame:
    """Accept an anchor if its hash is not empty and its index is above every accepted one before."""
    filled = F.col(hash_) != ""
    seen = running(submissions, keys, order, {"__top": F.when(filled, F.col(index))}, how="max", exclusive=True)
    rising = F.col("__top").isNull() | (F.col(index) > F.col("__top"))
    return seen.withColumn("accepted", filled & rising).withColumn(
        "reason", F.when(~filled, "empty hash").when(~rising, "index not increasing").otherwise("")).drop("__top")


def verify_anchors(candidates: DataFrame, anchored: DataFrame, keys: list[str], hash_: str) -> DataFrame:
    """``candidates`` with ``verified``: the accepted anchor of the same keys has the same hash, which is not empty."""
    known = anchored.filter("accepted").select(*keys, F.col(hash_).alias("__anchored"))
    out = null_safe_join(candidates, known, keys, "left")
    return out.withColumn("verified", F.coalesce((F.col(hash_) == F.col("__anchored")) & (F.col("__anchored") != ""), F.lit(False))).drop("__anchored")


def record_audit(records: DataFrame, ident: str, hash_: str, bps: str) -> DataFrame:
    """Accept a record if its confidence is in range and no accepted record before has its hash."""
    valid = F.col(bps).between(0, 10000)
    first = records.filter(valid).groupBy(hash_).agg(F.min(ident).alias("__first"))
    out = records.join(first, hash_, "left")
    fresh = F.coalesce(F.col(ident) <= F.col("__first"), F.lit(True))
    return out.withColumn("accepted", valid & fresh).withColumn(
        "reason", F.when(~valid, "confidence out of range").when(~fresh, "duplicate hash").otherwise("")).drop("__first")
