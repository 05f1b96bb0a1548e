"""Joins of the large row table with a derived dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .series import fits_one_task, null_safe_join, stored


def lookup_join(rows: DataFrame, dim: DataFrame, keys: list[str], how: str = "inner", sized_by: DataFrame | None = None) -> DataFrame:
    """Join rows with one dimension row per key; null keys match a null dimension key, so no row is lost.

    An aggregate's size is unknown to the planner, so on large inputs the dimension is stored first. Its file
    size then decides: below the broadcast threshold the rows stay where they are, above it the join is a
    shuffle, with hot keys split by adaptive execution.
    """
    if not fits_one_task(sized_by if sized_by is not None else rows):
        dim = stored(dim, "dimension")
    return null_safe_join(rows, dim, keys, how)
