"""Contiguous slices of an order, the unit in which hot groups are split.

A window over a group runs in one task. Operators that need a running total or the row before
therefore cut the order into slices, work inside a slice, and carry one small row per group and slice
from each slice to the next. Slices are the partitions of Spark's range partitioner, written once to
the shared folder with their number, so that every branch of a plan and every retried task sees the
same ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayledger.session import kept

#: Rows of a slice, where the number of slices is not given.
SLICE_ROWS = 1_000_000


def sliced(
    df: DataFrame, order: list[str | Column], slices: int | None = None, least: int = 1,
    rows: int = SLICE_ROWS,
) -> DataFrame:
    """``df`` as a stored table with ``__slice``; later rows of ``order`` have no lower number.

    Unless ``slices`` is given, their number follows from that of the rows, ``rows`` each and ``least``
    slices at least: the table is stored and counted from its files first. Rows that are equal in ``order`` share a slice: end
    ``order`` in a unique column.
    """
    if slices is None:
        df = kept(df.withColumn("__slice", F.lit(0)), "rows")
        slices = max(least, -(-df.count() // rows))
        if slices <= 1:
            return df
        df = df.drop("__slice")
    dealt = df.repartitionByRange(slices, *order)
    return kept(dealt.withColumn("__slice", F.spark_partition_id()), "slices")
