"""Distinct counts and quantiles over ranges of days, from sketches stored by day.

A day's sketch has a bounded size whatever the day holds, and sketches merge, so a range of any length
reads one small row per day and group instead of the rows. Counts of distinct values use HyperLogLog
sketches, quantiles KLL sketches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The logarithm of a distinct sketch's size, its relative error (three standard deviations), the size
#: of a quantile sketch and its error in ranks.
LOG_SIZE = 12
DISTINCT_ERROR = 3 * 1.04 / 2 ** (LOG_SIZE / 2)
POINTS = 400
RANK_ERROR = 0.015


def daily_sketches(
    df: DataFrame, by: list[str], distinct: list[str] | None = None, values: list[str] | None = None
) -> DataFrame:
    """One row per group of ``by`` (the day among them): ``n_rows`` and a sketch of each column.

    ``values`` are whole numbers; NULLs count in neither.
    """
    sketches = [
        F.hll_sketch_agg(F.col(c).cast("string"), LOG_SIZE).alias(f"distinct_{c}") for c in distinct or []
    ]
    sketches += [F.kll_sketch_agg_bigint(F.col(c).cast("bigint"), POINTS).alias(f"values_{c}") for c in values or []]
    return df.groupBy(*by).agg(F.count("*").alias("n_rows"), *sketches)


def merged_cardinality(sketches: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """About how many distinct values each column has per group, over all days of ``sketches``."""
    return sketches.groupBy(*by).agg(*[
        F.hll_sketch_estimate(F.hll_union_agg(f"distinct_{c}")).alias(c) for c in columns
    ])


def merged_quantiles(
    sketches: DataFrame, by: list[str], column: str, fractions: dict[str, float]
) -> DataFrame:
    """Quantiles of a column per group within ``RANK_ERROR`` of the rank, over all days of ``sketches``."""
    merged = sketches.groupBy(*by).agg(F.kll_merge_agg_bigint(f"values_{column}").alias("__all"))
    return merged.select(*by, *[
        F.kll_sketch_get_quantile_bigint("__all", F.lit(p)).alias(name) for name, p in fractions.items()
    ])
