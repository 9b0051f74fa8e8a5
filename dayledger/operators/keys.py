"""Joins of rows to a table with one row per key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_groups(rows: DataFrame, groups: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Equi join to grouped rows in which NULL equals NULL, as it does in a grouping.

    A hot key among ``rows`` is left to the adaptive skew join, which splits it over many tasks.
    That works only between two fresh shuffles: on the plain keys the grouped side would keep the
    partitions of its grouping. The NULL-safe keys are expressions, so it is shuffled once more,
    one row per key.
    """
    renamed = groups.withColumnsRenamed({c: f"__{c}" for c in on})
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in on])
    return rows.join(renamed, same, how).drop(*[f"__{c}" for c in on])
