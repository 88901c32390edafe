"""Small join helpers."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(Column.__or__, conditions, F.lit(False))


def all_of(conditions: Iterable[Column]) -> Column:
    found = list(conditions)
    return reduce(Column.__and__, found) if found else F.lit(True)


def match(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal keys, a null key matching a null key; the left key columns are kept."""
    renamed = right.select(
        *[F.col(k).alias(f"_r_{k}") for k in keys], *[F.col(c) for c in right.columns if c not in set(keys)]
    )
    on = all_of(F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys)
    return left.join(renamed, on, how).drop(*[f"_r_{k}" for k in keys])
