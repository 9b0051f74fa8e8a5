"""Which days and kinds are there, and which are not.

Every operator reduces rows to distinct days or kinds per key before anything else, so what one
task holds per key is bounded by the calendar or by the number of kinds, not by the rows.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def kind_matrix(df: DataFrame, keys: list[str], kind: str, kinds: list[str]) -> DataFrame:
    """One row per key and one 0/1 column per kind."""
    return df.groupBy(*keys).agg(*[
        F.max(F.when(F.col(kind) == k, 1).otherwise(0)).alias(k) for k in kinds
    ])


def kind_signature(df: DataFrame, keys: list[str], kind: str) -> DataFrame:
    """Number of keys per distinct set of kinds."""
    return (
        df.select(*keys, kind).distinct()
        .groupBy(*keys)
        .agg(F.concat_ws("+", F.array_sort(F.collect_set(kind))).alias("signature"))
        .groupBy("signature")
        .agg(F.count("*").alias("n_keys"))
    )


def missing_days(
    df: DataFrame, date_col: str, keys: list[str], start: dt.date | str, end: dt.date | str
) -> DataFrame:
    """Days of the calendar without a record, per key.

    Each key collects its distinct days, at most one calendar of them, and subtracts them from the
    calendar in place; there is no grid of keys and days to build or join.
    """
    start, end = (F.lit(dt.date.fromisoformat(str(d))) for d in (start, end))
    seen = F.collect_set(F.when(F.col("day").between(start, end), F.col("day")))
    return distinct_days(df, date_col, keys).groupBy(*keys).agg(seen.alias("__days")).select(
        *keys, F.explode(F.array_except(F.sequence(start, end), "__days")).alias("missing_day")
    )


def distinct_days(df: DataFrame, date_col: str, keys: list[str]) -> DataFrame:
    return df.select(*keys, F.col(date_col).cast("date").alias("day")).distinct()


def coverage_gaps(df: DataFrame, date_col: str, keys: list[str]) -> DataFrame:
    """Stretches of missing days between two recorded days."""
    ordered = Window.partitionBy(*keys).orderBy("day")
    return (
        distinct_days(df, date_col, keys)
        .withColumn("previous", F.lag("day").over(ordered))
        .where(F.date_diff("day", "previous") > 1)
        .select(
            *keys,
            F.date_add("previous", 1).alias("gap_start"),
            F.date_sub("day", 1).alias("gap_end"),
            (F.date_diff("day", "previous") - 1).alias("n_days"),
        )
    )


def coverage_runs(df: DataFrame, date_col: str, keys: list[str]) -> DataFrame:
    """Stretches of consecutive recorded days."""
    ordered = Window.partitionBy(*keys).orderBy("day")
    return (
        distinct_days(df, date_col, keys)
        .withColumn("run", F.date_sub("day", F.row_number().over(ordered)))
        .groupBy(*keys, "run")
        .agg(
            F.min("day").alias("run_start"),
            F.max("day").alias("run_end"),
            F.count("*").alias("n_days"),
        )
        .drop("run")
    )


def expected_minus_actual(
    df: DataFrame, keys: list[str], kind: str, kinds: list[str], days: DataFrame | None = None
) -> DataFrame:
    """The kinds each key (day) lacks: of the recorded ones, and of those in ``days`` if given.

    An expected day without any record lacks every kind.
    """
    rows = df.select(*keys, kind)
    if days is not None:
        unseen = F.lit(None).cast(df.schema[kind].dataType).alias(kind)
        rows = rows.unionByName(days.select(*keys, unseen))
    seen = has_kinds(rows, keys, kind, kinds)
    lacking = [F.when(~F.col(f"__has_{i}"), k) for i, k in enumerate(kinds)]
    return seen.select(
        *keys, F.explode(F.array_compact(F.array(*lacking))).alias("missing_kind")
    )


def has_kinds(df: DataFrame, keys: list[str], kind: str, kinds: list[str]) -> DataFrame:
    """One flag per key and kind."""
    return df.groupBy(*keys).agg(*[
        F.coalesce(F.bool_or(F.col(kind) == k), F.lit(False)).alias(f"__has_{i}")
        for i, k in enumerate(kinds)
    ])


def days_in_all(df: DataFrame, keys: list[str], kind: str, kinds: list[str]) -> DataFrame:
    """Keys that have every one of the kinds: one grouped pass instead of one intersect per kind."""
    seen = has_kinds(df.where(F.col(kind).isin(kinds)), keys, kind, kinds)
    every = reduce(lambda a, b: a & b, [F.col(f"__has_{i}") for i in range(len(kinds))])
    return seen.where(every).select(*keys)


def days_in_any(df: DataFrame, keys: list[str], kind: str, kinds: list[str]) -> DataFrame:
    """Keys that have at least one of the kinds."""
    return df.where(F.col(kind).isin(kinds)).select(*keys).distinct()
