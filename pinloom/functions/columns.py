"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MULTIPLIER, SEED_STEP, MODULUS = 7919, 104729, 1000003


def lcg(key: str | Column, seed: int) -> Column:
    """A portable hash in [0, 1000003): the same in Spark and any SQL engine. Ids must be non-negative."""
    c = F.col(key) if isinstance(key, str) else key
    return (c % MODULUS * MULTIPLIER + seed % MODULUS * SEED_STEP) % MODULUS


def mixed(key: str | Column, *seeds: int) -> Column:
    """A 64-bit hash for choices that need no portability."""
    return F.xxhash64(F.col(key) if isinstance(key, str) else key, *[F.lit(s) for s in seeds])


def scaled_cost(cost: str = "cost", size: str = "size") -> Column:
    """cost / (size - 1); null for nets of fewer than two pins, which can never be cut."""
    return F.when(F.col(size) > 1, F.col(cost) / (F.col(size) - 1))


def interval_label(side: str | Column, low: int | Column, high: int | Column) -> Column:
    """The label of a side of a bisection: `low` for side 0, else `high`."""
    side = F.col(side) if isinstance(side, str) else side
    low, high = (x if isinstance(x, Column) else F.lit(x).cast("bigint") for x in (low, high))
    return F.when(side == 0, low).otherwise(high)
