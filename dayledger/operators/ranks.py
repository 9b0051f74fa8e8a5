"""Largest, latest and first rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dayledger.operators.keys import join_groups
from dayledger.operators.slices import sliced

#: The largest k for which map tasks prune a window before its shuffle, so that a group's task gets
#: at most so many rows from each of them; beyond it, rows are selected by rank.
PRUNED = 100


def largest(df: DataFrame, n: int, value: str, tie: str) -> DataFrame:
    """The ``n`` largest rows overall."""
    return df.orderBy(F.desc(value), F.asc(tie)).limit(n)


def first_rows(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows per group in one window; Spark prunes it in the map tasks."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("rank", rank).where(F.col("rank") <= k)


def up_to_rank(
    rows: DataFrame, by: list[str], order: list[Column], k: int, n: Column, slices: int | None
) -> DataFrame:
    """The rows of each group that start at a rank below ``k``, with that rank (from 0) as ``__start``.

    A row stands for ``n`` rows. Totals per group and slice tell where each slice starts; slices that
    start at ``k`` or later are dropped before anything is ordered, and a task orders one slice.
    """
    cut = sliced(rows, order, slices)
    before = Window.partitionBy(*by).orderBy("__slice")
    pieces = (
        cut.groupBy(*by, "__slice").agg(F.sum(n).alias("__rows"))
        .select(*by, "__slice", (F.sum("__rows").over(before) - F.col("__rows")).alias("__below"))
        .where(F.col("__below") < k)
    )
    inside = Window.partitionBy(*by, "__slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        join_groups(cut, pieces, [*by, "__slice"])
        .withColumn("__start", F.col("__below") + F.sum(n).over(inside) - n)
        .where(F.col("__start") < k)
        .drop("__slice", "__below")
    )


def top_values(df: DataFrame, by: list[str], value: str, k: int, slices: int | None) -> DataFrame:
    """Each group's values among its ``k`` largest rows (NULL last), with the ``rank`` of their first row."""
    counts = df.groupBy(*by, F.col(value).alias("__v")).agg(F.count("*").alias("__n"))
    heads = up_to_rank(counts, by, [F.desc("__v")], k, F.col("__n"), slices)
    return heads.select(*by, F.col("__v").alias(value), (F.col("__start") + 1).cast("int").alias("rank"))


def select_by_rank(
    df: DataFrame, by: list[str], value: str, k: int, tie: str, slices: int | None = None
) -> DataFrame:
    """The ``k`` largest rows per group for any ``k``, without a group or a hot value in one task.

    The k-th value of a group comes from its counted values. Rows from it on are cut into slices by
    value and tie, and ranked inside their slice.
    """
    kth = top_values(df, by, value, k, slices).groupBy(*by).agg(F.max_by(value, "rank").alias("__kth"))
    known = join_groups(df, kth, by)
    reached = F.col("__kth").isNull() | (F.col(value) >= F.col("__kth"))
    some = known.where(reached).select(*df.columns)
    ranked = up_to_rank(some, by, [F.desc(value), F.asc(tie)], k, F.lit(1), slices)
    return ranked.withColumn("rank", (F.col("__start") + 1).cast("int")).drop("__start")


def topk(
    df: DataFrame, by: list[str], value: str, k: int, tie: str | None = None, slices: int | None = None
) -> DataFrame:
    """The ``k`` largest rows per group, with their ``rank``; NULL values come last.

    With ``tie``, a unique column, the lower tie wins and a group has at most ``k`` rows. Without it
    all rows that share the k-th value stay; however many they are, they are joined to the k largest
    values and never gathered in one task. ``slices`` is used from a ``k`` of more than ``PRUNED`` on.
    """
    if not by:
        return topk(df.withColumn("__all", F.lit(0)), ["__all"], value, k, tie, slices).drop("__all")
    if tie is not None:
        if k <= PRUNED:
            return first_rows(df, by, [F.desc(value), F.asc(tie)], k)
        return select_by_rank(df, by, value, k, tie, slices)
    if k <= PRUNED:
        values = first_rows(df.select(*by, value), by, [F.desc(value)], k)
        ranks = values.groupBy(*by, value).agg(F.min("rank").alias("rank"))
    else:
        ranks = top_values(df, by, value, k, slices)
    return join_groups(df, ranks, [*by, value])


def as_of(
    df: DataFrame, key: list[str], ts_col: str, ts: Column, tie: str
) -> DataFrame:
    """The latest record per key that was published by ``ts``; the higher tie column wins.

    One aggregate: map tasks keep one record per key, whatever the number of records of a key.
    """
    latest = F.max_by(F.struct(*df.columns), F.struct(ts_col, tie)).alias("__row")
    return df.where(F.col(ts_col) <= ts).groupBy(*key).agg(latest).select("__row.*")
