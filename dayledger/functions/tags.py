"""Source tags and publication times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: both parts fit a BIGINT.
TRACE_TAG = r"^(0*[0-7]?[0-9a-f]{1,15})-(0*[0-7]?[0-9a-f]{1,15})$"


def hex_value(text: Column) -> Column:
    """Hex digits to BIGINT."""
    return F.conv(text, 16, 10).cast("bigint")


def decode_source_tag(df: DataFrame, tag_col: str) -> DataFrame:
    """Add ``tag_size`` and ``tag_modified`` from ``<size>-<microseconds>``; NULL for other tags."""
    tag = F.col(tag_col)
    hexed = tag.rlike(TRACE_TAG)
    return df.withColumns({
        "tag_size": F.when(hexed, hex_value(F.regexp_extract(tag, TRACE_TAG, 1))),
        "tag_modified": F.when(
            hexed, F.timestamp_micros(hex_value(F.regexp_extract(tag, TRACE_TAG, 2)))
        ),
    })


def publish_lag(df: DataFrame, published: str, captured: str) -> DataFrame:
    """Add ``lag_seconds`` from capture to publication."""
    moment = [F.unix_micros(F.col(c).cast("timestamp")) for c in (published, captured)]
    return df.withColumn("lag_seconds", (moment[0] - moment[1]) / F.lit(1_000_000))
