"""Reports on a catalogue."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayledger.functions.names import KINDS
from dayledger.operators import coverage, joins, volume
from dayledger.sources.pointers import SUFFIX, in_range, without_suffix

# Fixed value: the scheme and the authority of a URI.
SCHEME = "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?"


def day_report(
    records: DataFrame, start: dt.date | str, end: dt.date | str, kinds: list[str] | None = None
) -> DataFrame:
    """Every calendar day of the range: number of files, their bytes and the kinds it lacks."""
    kinds = kinds or KINDS
    has = [F.coalesce(F.bool_or(F.col("kind") == k), F.lit(False)) for k in kinds]
    per_day = (
        in_range(records, start, end)
        .groupBy("capture_date")
        .agg(
            F.count("*").alias("files"),
            F.sum("out.size").alias("bytes"),
            F.array_compact(F.array(*[F.when(~flag, k) for flag, k in zip(has, kinds)])).alias("lacks"),
        )
    )
    absent = coverage.missing_days(per_day, "capture_date", [], start, end).select(
        F.col("missing_day").alias("capture_date"),
        F.lit(0).cast("bigint").alias("files"),
        F.lit(0).cast("bigint").alias("bytes"),
        F.array(*[F.lit(k) for k in kinds]).alias("lacks"),
    )
    return per_day.unionByName(absent)


def below(path: Column, root: str) -> Column:
    """A path relative to a root, whatever their schemes; the full path if it lies elsewhere."""
    bare = F.regexp_replace(path, SCHEME, "")
    top = re.sub(SCHEME, "", root).rstrip("/") + "/"
    inside = F.startswith(bare, F.lit(top))
    return F.when(inside, F.substring(bare, len(top) + 1, 2**31 - 1)).otherwise(bare)


def verify_archive(
    records: DataFrame, files: DataFrame, records_root: str, files_root: str, suffix: str = SUFFIX
) -> DataFrame:
    """Status of every recorded payload and every file, matched by their paths below their roots.

    A record in a file of its own stands for the payload of that name; one of many in a file for the
    payload it names, in the same folder. ``files`` is an inventory, with an ``md5`` column once
    digests are computed.
    """
    own = without_suffix(F.col("file_path"), suffix)
    named = F.endswith(own, F.concat(F.lit("/"), F.col("out.path")))
    beside = F.concat(F.regexp_extract("file_path", r"^(.*/)[^/]*$", 1), F.col("out.path"))
    many = F.regexp_extract("file_path", r"/(part-[^/]*)$", 1) != ""
    recorded = records.select(
        below(F.when(many & ~named, beside).otherwise(own), records_root).alias("path"),
        F.col("out.size").alias("size"),
        F.col("out.md5").alias("md5"),
    )
    digest = F.col("md5") if "md5" in files.columns else F.lit(None).cast("string")
    found = files.select(
        below(F.col("path"), files_root).alias("path"),
        F.col("length").alias("size"),
        digest.alias("md5"),
    )
    return joins.verify_payloads(recorded, found)


def yearly_volume(records: DataFrame) -> DataFrame:
    """Files and bytes by year and kind, with totals per year and overall."""
    sized = records.select("year", "kind", F.col("out.size").alias("size"))
    return volume.volume(sized, ["year", "kind"], "size", "rollup")
