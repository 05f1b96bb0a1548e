"""Connected components by alternating large-star and small-star over an edge table.

Minima come from combinable aggregates and are joined back, so a node with very many neighbours is never gathered in one
task. Each round is written to the shared folder, which cuts the lineage; the number of rounds grows with the logarithm
of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import cleaned, released, stored


def _with_least(edges: DataFrame) -> DataFrame:
    """(u, v, m) for edges in both directions; m is the least of u and its neighbours."""
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u")


def large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the least of the node's neighbourhood; links may repeat."""
    return _with_least(edges).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")


def small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    ends = F.array(*[F.struct(F.col(c).alias("u"), F.col("m").alias("v")) for c in ("u", "v")])
    return down.join(least, "u").select(F.inline(ends)).filter("u <> v").distinct()


def _fingerprint(edges: DataFrame) -> tuple:
    with cleaned(edges.sparkSession):
        return tuple(edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))"), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 20)))).first())


def components(edges: DataFrame, a: str = "u", b: str = "v") -> DataFrame:
    """(node, component): the least node reachable, for every node of an edge; loops and null ends are ignored.

    An empty edge table gives an empty result, repeated edges change nothing.
    """
    now = stored(
        edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(),
        "edges",
    )
    seen = None
    while (mark := _fingerprint(now)) != seen:
        seen, last = mark, now
        now = stored(small_star(large_star(last)), "edges")
        released(last)
    # a star at the end: every node points to its root, roots to themselves
    found = stored(
        now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(
            now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
        ),
        "components",
    )
    released(now)
    return found
