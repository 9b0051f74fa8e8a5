"""Changes along an order, moving totals, growth and transfer batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dayledger.operators.slices import sliced
from dayledger.session import kept


def transitions(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    value: str,
    slices: int | None = None,
) -> DataFrame:
    """Rows whose value differs from the row before, with that ``previous`` value.

    ``order`` should end in a unique column. Rows are worked in slices of the order, whatever their
    number. One window finds the changes inside a slice and the slice's first and last row; these rows are written,
    and a second window over the first and last rows alone, two per key and slice, finds the changes
    from slice to slice.
    """
    box = F.struct(F.col(value).alias("v"))
    line = Window.partitionBy(*keys, "__slice").orderBy(*order)
    changed = F.col("__before").isNotNull() & ~F.col("__before.v").eqNullSafe(F.col(value))
    first = F.col("__before").isNull()

    def result(marked: DataFrame) -> DataFrame:
        return marked.where(changed).select(*df.columns, F.col("__before.v").alias("previous"))

    marked = sliced(df, order, slices).withColumns({
        "__before": F.lag(box).over(line), "__last": F.lead(box).over(line).isNull(),
    })
    written = kept(marked.where(changed | first | F.col("__last")), "changes")
    ends = Window.partitionBy(*keys).orderBy("__slice", *order)
    seams = (
        written.where(first | F.col("__last"))
        .withColumn("__carried", F.lag(box).over(ends))
        .where(first)
        .withColumn("__before", F.col("__carried"))
    )
    return result(written).unionByName(result(seams))


def daily(df: DataFrame, keys: list[str], date_col: str, total: Column) -> DataFrame:
    return df.groupBy(*keys, F.col(date_col).cast("date").alias("day")).agg(total.alias("total"))


def rolling(
    df: DataFrame, keys: list[str], date_col: str, total: Column, days: int
) -> DataFrame:
    """Sum and mean per recorded day over the last ``days`` calendar days.

    ``total`` is the aggregate of one day. The frame counts days, not rows, so gaps count as empty.
    """
    window = (
        Window.partitionBy(*keys).orderBy(F.unix_date("day")).rangeBetween(1 - days, 0)
    )
    return daily(df, keys, date_col, total).select(
        *keys, "day", "total",
        F.sum("total").over(window).alias("rolling_sum"),
        (F.sum("total").over(window) / F.lit(days)).alias("rolling_mean"),
    )


def growth(
    df: DataFrame, period: Column, total: Column, keys: list[str] | None = None
) -> DataFrame:
    """Total per period, with the change from the recorded period before."""
    keys = keys or []
    ordered = Window.partitionBy(*keys).orderBy("period")
    before = F.lag("total").over(ordered)
    return df.groupBy(*keys, period.alias("period")).agg(total.alias("total")).select(
        *keys, "period", "total",
        before.alias("previous_total"), (F.col("total") - before).alias("change"),
    )


def running_total(
    df: DataFrame, order: list[str], size: str, slices: int | None = None
) -> DataFrame:
    """Add ``running``, the total of ``size`` up to and with the row, over the whole table.

    Two passes instead of one task: totals of the slices first (one row each), then a running total
    inside each slice on top of the slices before it. A NULL size counts as 0.
    """
    rows = sliced(df, order, slices)
    sized = F.coalesce(F.col(size), F.lit(0))
    inside = F.sum(sized).over(Window.partitionBy("__slice").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, 0
    ))
    earlier = Window.orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.groupBy("__slice").agg(F.sum(sized).alias("__total"))
        .select("__slice", F.coalesce(F.sum("__total").over(earlier), F.lit(0)).alias("__offset"))
    )
    return (
        rows.withColumn("__inside", inside)
        .join(offsets, "__slice")
        .withColumn("running", F.col("__offset") + F.col("__inside"))
        .drop("__slice", "__inside", "__offset")
    )


def byte_bins(
    df: DataFrame, order: list[str], size: str, budget: int, slices: int | None = None
) -> DataFrame:
    """Number contiguous transfer batches of about ``budget`` bytes, by where each row starts."""
    start = F.col("running") - F.coalesce(F.col(size), F.lit(0))
    return (
        running_total(df, order, size, slices)
        .withColumn("bin", F.call_function("div", start, F.lit(budget)))
        .drop("running")
    )


def bin_totals(binned: DataFrame, size: str) -> DataFrame:
    """Files and bytes per batch."""
    return binned.groupBy("bin").agg(F.count("*").alias("files"), F.sum(size).alias("bytes"))
