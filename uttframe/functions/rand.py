"""Random choices that depend on keys alone, so reruns, retries and other partitionings agree."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def order_key(*keys: Column | str, op: str, seed: int = 0, epoch: int = 0) -> Column:
    """A 64-bit hash to order by, or to pick with."""
    return F.xxhash64(F.lit(op), F.lit(seed), F.lit(epoch), *keys)


def uniform(*keys: Column | str, op: str, seed: int = 0, epoch: int = 0) -> Column:
    """A double from 0 (included) to 1."""
    return F.pmod(order_key(*keys, op=op, seed=seed, epoch=epoch), F.lit(1 << 52)) / float(1 << 52)


def below(n: Column | int, *keys: Column | str, op: str, seed: int = 0, epoch: int = 0) -> Column:
    """An integer from 0 to n - 1."""
    return F.pmod(order_key(*keys, op=op, seed=seed, epoch=epoch), n if isinstance(n, Column) else F.lit(n)).cast("int")
