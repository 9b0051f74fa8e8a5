"""Counts, sums, sizes and duplicates by group. All of them combine on the map side."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dayledger.operators.keys import join_groups


def volume(
    df: DataFrame,
    dims: list[str],
    size: str,
    mode: str = "groupby",
    sets: list[list[str]] | None = None,
) -> DataFrame:
    """``files`` and ``bytes`` by ``dims``; with subtotals and their ``level`` in the other modes.

    Subtotals are totals of the groups by all ``dims``: rows are grouped once, and only the groups are
    repeated for each grouping set.
    """
    base = df.groupBy(*dims).agg(F.count("*").alias("files"), F.sum(size).alias("bytes"))
    if mode == "groupby":
        return base
    grouped = {
        "rollup": lambda: base.rollup(*dims),
        "cube": lambda: base.cube(*dims),
        "sets": lambda: base.groupingSets([[F.col(c) for c in s] for s in sets or []], *dims),
    }[mode]()
    files = F.sum("files").alias("files")
    total = F.sum("bytes").cast(base.schema["bytes"].dataType).alias("bytes")
    return grouped.agg(files, total, F.grouping_id().alias("level"))


def duplicate_groups(df: DataFrame, content: list[str], key: str) -> DataFrame:
    """Known contents held more than once: number of copies, first and last key."""
    return (
        df.dropna(subset=content)
        .groupBy(*content)
        .agg(
            F.count("*").alias("copies"),
            F.min(key).alias("first_key"),
            F.max(key).alias("last_key"),
        )
        .where("copies > 1")
    )


def duplicate_content(df: DataFrame, content: list[str], key: str) -> DataFrame:
    """Every record whose content is held more than once. Copies stay rows, never a list in a cell."""
    groups = duplicate_groups(df, content, key).select(*content, "copies", "first_key")
    return join_groups(df.select(key, *content), groups, content)


def tag_collisions(df: DataFrame, tag: str, digest: str) -> DataFrame:
    """Tags with several digests and digests with several tags."""
    pairs = df.select(tag, digest).distinct()

    def several(by: str, what: str) -> DataFrame:
        return (
            pairs.groupBy(F.col(by).alias("value"))
            .agg(F.count("*").alias("n_values"))
            .where("n_values > 1")
            .select(F.lit(what).alias("direction"), "value", "n_values")
        )

    return several(tag, "tag_with_digests").unionByName(several(digest, "digest_with_tags"))


def cardinality(df: DataFrame, cols: list[str], exact: bool = True) -> DataFrame:
    """Distinct values per column, one row."""
    if not exact:
        return df.agg(*[F.approx_count_distinct(c).alias(c) for c in cols])
    return df.agg(*[F.count_distinct(F.col(c)).alias(c) for c in cols])


def extremes(df: DataFrame, by: list[str], value: str, key: str) -> DataFrame:
    """Smallest and largest record per group; the lower key wins a tie.

    The smallest is the least pair of value and key, the largest the first row by value from above
    and key; both leave one row per group and task to shuffle.
    """
    if not by:
        whole = df.select(value, key, F.lit(0).alias("__all"))
        return extremes(whole, ["__all"], value, key).drop("__all")
    valued = F.col(value).isNotNull()
    least = F.min(F.when(valued, F.struct(F.col(value).alias("v"), F.col(key).alias("k"))))
    smallest = df.groupBy(*by).agg(least.alias("__min"))
    first = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(value), F.asc(key)))
    largest = df.where(valued).select(*by, value, key).withColumn("__rank", first).where("__rank = 1")
    largest = largest.select(*by, F.col(value).alias("max_value"), F.col(key).alias("max_key"))
    ends = smallest.select(
        *by, F.col("__min.v").alias("min_value"), F.col("__min.k").alias("min_key")
    )
    return join_groups(ends, largest, by, "left")


def label_profile(
    labels: DataFrame, dims: list[str], hosts: list[str], mode: str = "groupby", exact: bool = False
) -> DataFrame:
    """Label rows per ``dims`` (with subtotals under ``rollup``) and distinct hosts per column."""
    distinct = F.count_distinct if exact else F.approx_count_distinct
    grouped = labels.rollup(*dims) if mode == "rollup" else labels.groupBy(*dims)
    return grouped.agg(
        F.count("*").alias("rows"),
        *[distinct(F.col(h)).alias(f"distinct_{h}") for h in hosts],
    )
