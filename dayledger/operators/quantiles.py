"""Quantiles per group, exact at any size, and outliers by median and deviation."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dayledger.operators.keys import join_groups
from dayledger.operators.slices import sliced
from dayledger.session import kept


def counted_values(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Each group's values ``__v`` with their number ``__n``.

    Counting first combines on the map side and spreads a large group over its values.
    """
    values = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("__v"))
    return values.agg(F.count("*").alias("__n"))


def placed_in_slices(
    rows: DataFrame, by: list[str], wanted: Callable[[Column, Column], Column]
) -> DataFrame:
    """The rows of the slices that hold a ``wanted`` rank, with ``__start``, the rank of the first
    row of a value in its group.

    Totals per group and slice tell where each slice starts; no other slice is ordered.
    """
    ordered, group = Window.partitionBy(*by).orderBy("__slice"), Window.partitionBy(*by)
    pieces = (
        rows.groupBy(*by, "__slice")
        .agg(F.sum("__n").alias("__rows"), F.min("__v").alias("__min"), F.max("__v").alias("__max"))
        .select(
            *by, "__slice", "__rows",
            (F.sum("__rows").over(ordered) - F.col("__rows")).alias("__below"),
            F.sum("__rows").over(group).alias("n_rows"),
            F.min("__min").over(group).alias("min_value"),
            F.max("__max").over(group).alias("max_value"),
        )
        .where(wanted(F.col("__below"), F.col("__rows")))
    )
    inside = Window.partitionBy(*by, "__slice").orderBy("__v").rowsBetween(
        Window.unboundedPreceding, 0
    )
    return join_groups(rows, pieces, [*by, "__slice"]).withColumn(
        "__start", F.col("__below") + F.sum("__n").over(inside) - F.col("__n")
    )


def quantiles_of_counts(
    counted: DataFrame, by: list[str], fractions: dict[str, float], slices: int | None = None
) -> DataFrame:
    """Count, minimum, maximum and interpolated quantiles of counted values."""
    def position(p: float) -> Column:
        return F.lit(p) * (F.col("n_rows") - 1)

    def holds(rank: Column, start: Column, rows: Column) -> Column:
        return (rank >= start) & (rank < start + rows)

    def wanted(start: Column, rows: Column) -> Column:
        ranks = [f(position(p)) for p in fractions.values() for f in (F.floor, F.ceil)]
        return reduce(lambda a, b: a | b, [holds(rank, start, rows) for rank in ranks])

    placed = placed_in_slices(sliced(counted, ["__v"], slices), by, wanted)

    def at(rank: Column) -> Column:
        return F.max(F.when(holds(rank, F.col("__start"), F.col("__n")), F.col("__v")))

    picked = placed.groupBy(*by).agg(
        *[F.max(c).alias(c) for c in ("n_rows", "min_value", "max_value")],
        *[at(F.floor(position(p))).alias(f"__low_{name}") for name, p in fractions.items()],
        *[at(F.ceil(position(p))).alias(f"__high_{name}") for name, p in fractions.items()],
    )

    def between(name: str, p: float) -> Column:
        low, high = F.col(f"__low_{name}"), F.col(f"__high_{name}")
        share = position(p) - F.floor(position(p))
        return (low + (high - low) * share).alias(name)

    return picked.select(
        *by, "n_rows", "min_value",
        *[between(name, p) for name, p in fractions.items()],
        "max_value",
    )


def size_distribution(
    df: DataFrame,
    by: list[str],
    value: str,
    exact: bool = True,
    accuracy: int = 10_000,
    slices: int | None = None,
) -> DataFrame:
    """Count, minimum, quartiles, 99th percentile and maximum of the non-NULL values per group.

    The built-in exact percentile keeps all distinct values of a group in one task; the exact form
    here does not, and the approximate form keeps a sketch of ``accuracy`` points.
    """
    fractions = {"q1": 0.25, "median": 0.5, "q3": 0.75, "p99": 0.99}
    if exact:
        return quantiles_of_counts(counted_values(df, by, value), by, fractions, slices)
    return df.where(F.col(value).isNotNull()).groupBy(*by).agg(
        F.count("*").alias("n_rows"),
        F.min(value).alias("min_value"),
        *[F.percentile_approx(value, p, accuracy).alias(name) for name, p in fractions.items()],
        F.max(value).alias("max_value"),
    )


def robust_outliers(
    df: DataFrame, by: list[str], value: str, k: float = 3.5, slices: int | None = None
) -> DataFrame:
    """Rows further from their group's median than ``k`` scaled median absolute deviations.

    Without ``by`` all rows are one group. The input is read twice: to count its values and to pick
    the outliers. Medians and deviations come from the counted values. The tables in between are
    written: each is needed more than once, and the planner broadcasts a table of medians only if it
    is small.
    """
    if not by:
        whole = df.withColumn("__all", F.lit(0))
        return robust_outliers(whole, ["__all"], value, k, slices).drop("__all")
    counted = kept(counted_values(df, by, value), "values")
    medians = kept(
        quantiles_of_counts(counted, by, {"median": 0.5}, slices).select(*by, "median"), "medians"
    )
    # Two values may share a deviation; they stay two rows, so that no grouping follows this join
    # and a hot group can be split in it.
    deviations = kept(
        join_groups(counted, medians, by).select(
            *by, "median", F.abs(F.col("__v") - F.col("median")).alias("__v"), "__n"
        ),
        "deviations",
    )
    spreads = kept(
        quantiles_of_counts(deviations, [*by, "median"], {"mad": 0.5}, slices)
        .select(*by, "median", "mad"),
        "spreads",
    )
    # Fixed value: 1.4826 turns the deviation of a normal distribution into its standard deviation.
    far = F.abs(F.col(value) - F.col("median")) > F.lit(k * 1.4826) * F.col("mad")
    return join_groups(df, spreads, by).where(far)
