"""Column helpers shared by the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dbl(c) -> Column:
    return col(c).cast("double")


def r(c, digits: int = 6) -> Column:
    """Round for output; adding zero turns -0.0 into 0.0."""
    return F.round(col(c).cast("double"), digits) + F.lit(0.0)


def div0(a, b, default: float = 0.0) -> Column:
    """a / b, or ``default`` where b is zero or either side is null."""
    return F.coalesce(F.try_divide(dbl(a), dbl(b)), F.lit(float(default)))


def clip(c, lo: float, hi: float) -> Column:
    return F.least(F.greatest(col(c), F.lit(lo)), F.lit(hi))


def total(conditions: Column) -> Column:
    """Number of rows where the condition holds (0 on empty input)."""
    return F.coalesce(F.sum(conditions.cast("long")), F.lit(0))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-clip(x, -500.0, 500.0)))


def first_max_name(scores: dict[str, Column]) -> Column:
    """Name of the largest value; the earliest name wins ties."""
    top = F.greatest(*scores.values())
    out = F.lit(None).cast("string")
    for name, value in reversed(list(scores.items())):
        out = F.when(value == top, F.lit(name)).otherwise(out)
    return out


def micros(ts) -> Column:
    """Microseconds since the epoch of a timestamp column (with or without zone)."""
    return F.unix_micros(col(ts).cast("timestamp"))


MIX_MODULUS = 2_147_483_647


def mix_factor(seed: int) -> int:
    return 1_103_515_245 + 209_458 * seed


def mix_uniform(ident, seed: int) -> Column:
    """Integer-mix uniform in [0, 1): depends on the row id only, never on partitioning."""
    ident = col(ident).cast("long") % F.lit(MIX_MODULUS)
    mixed = (ident * F.lit(mix_factor(seed)) + F.lit(104_729 * (seed + 1))) % F.lit(MIX_MODULUS)
    return mixed.cast("double") / F.lit(float(MIX_MODULUS))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)
