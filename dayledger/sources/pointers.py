"""Catalogue records: scan, select by day and kind, and write back."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dayledger.functions.names import blank_to_null, classify_kind, strict_date
from dayledger.functions.records import parse_pointer, render_pointer, split_records
from dayledger.functions.tags import decode_source_tag
from dayledger.operators.keys import join_groups
from dayledger.session import kept

# The payload names of each kind.
NAME_GLOBS = {
    "notice_csv": "*_notice.csv",
    "notice_xml": "*_notice.xml",
    "anomalous_csv": "*_anomalous_suspicious.csv",
    "anomalous_xml": "*_anomalous_suspicious.xml",
    "trace": "*.gz",
}
SUFFIX = ".dvc"
RECORD_SCHEMA = "value STRING, year INT, month INT, day INT"


def name_glob(kinds: Iterable[str] | None, suffix: str = SUFFIX) -> str:
    """Files that may hold records of the kinds: those named for one, and files of many records."""
    if kinds is None:
        return "*" + suffix
    return "{" + ",".join([*(NAME_GLOBS[k] + suffix for k in kinds), "part-*" + suffix]) + "}"


def plain_path(path: Column) -> Column:
    """A path as it is named on disk; Spark gives that of a file as an encoded URI."""
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def without_suffix(path: Column, suffix: str) -> Column:
    """The path of the payload that a record of this path stands for."""
    bare = F.left(path, F.length(path) - len(suffix))
    return F.when(F.endswith(path, F.lit(suffix)), bare).otherwise(path)


def with_path_columns(df: DataFrame, suffix: str = SUFFIX) -> DataFrame:
    """One row per record of each file, with file path, version, calendar date and kind.

    The kind is that of the file's name. A file of many records is named for none of them: its
    records get theirs when they are parsed.
    """
    named = df.select("value", plain_path(F.col("_metadata.file_path")).alias("file_path"))
    return with_place(split_records(named), suffix)


def with_place(placed: DataFrame, suffix: str = SUFFIX) -> DataFrame:
    """Add what a record's ``file_path`` tells."""
    path = F.col("file_path")

    def part(name: str) -> Column:
        return blank_to_null(F.regexp_extract(path, rf"/{name}=(\d+)/", 1)).cast("int")

    dated = placed.withColumns({name: part(name) for name in ("year", "month", "day")})
    digits = F.concat_ws("", F.lpad("year", 4, "0"), F.lpad("month", 2, "0"), F.lpad("day", 2, "0"))
    named = dated.select(
        "value", "file_path",
        F.regexp_extract(path, r"/(v\d[^/]*)/year=", 1).alias("version"),
        "year", "month", "day",
        strict_date(digits).alias("capture_date"),
        without_suffix(path, suffix).alias("payload_path"),
    )
    return classify_kind(named, "payload_path").drop("payload_path", "compression")


def scan_pointers(
    spark: SparkSession, root: str, kinds: Iterable[str] | None = None, suffix: str = SUFFIX
) -> DataFrame:
    """One row per record below ``root``, as raw text with path columns.

    ``root`` is a folder of any level above the records, also one of several versions, or a pattern
    of folders; kinds and suffix narrow the file listing. Days are read from the paths.
    """
    raw = spark.read.option("recursiveFileLookup", "true").text(
        root, wholetext=True, pathGlobFilter=name_glob(kinds, suffix)
    )
    return with_path_columns(raw, suffix)


def catalogue(
    spark: SparkSession, root: str, kinds: Iterable[str] | None = None, suffix: str = SUFFIX
) -> DataFrame:
    """The parsed records below ``root``."""
    return parsed(scan_pointers(spark, root, kinds, suffix))


def parsed(raw: DataFrame) -> DataFrame:
    """Raw records to typed columns, with the source tag decoded.

    Records of a file that is named for no payload get kind and format from their own path.
    """
    tagged = decode_source_tag(
        parse_pointer(raw).withColumn("etag", F.col("dep.etag")), "etag"
    ).drop("etag")
    own = ["kind", "label_set", "format"]
    named = tagged.withColumnsRenamed({c: f"__{c}" for c in own}).withColumn("__name", F.col("out.path"))
    filled = classify_kind(named, "__name").drop("compression", "__name")
    return filled.withColumns({
        c: F.when(F.col("__kind").isNull(), F.col(c)).otherwise(F.col(f"__{c}")) for c in own
    }).select(*tagged.columns)


def in_range(
    df: DataFrame, start: dt.date | str, end: dt.date | str, date_col: str | None = None
) -> DataFrame:
    """Rows of the days ``start`` to ``end``, both included.

    On year/month/day partitions the test is plain arithmetic on partition columns, so folders
    outside the range are never read; on a date column it reaches the file's statistics.
    """
    start, end = (dt.date.fromisoformat(str(d)) for d in (start, end))
    if date_col:
        return df.where(
            (F.col(date_col) >= F.lit(start)) & (F.col(date_col) < F.lit(end + dt.timedelta(1)))
        )
    year, number = F.col("year"), F.col("year") * 10000 + F.col("month") * 100 + F.col("day")
    first, last = (d.year * 10000 + d.month * 100 + d.day for d in (start, end))
    return df.where(year.between(start.year, end.year) & number.between(first, last))


def folders_of(start: dt.date, end: dt.date) -> list[str]:
    """The fewest folders that hold the days of a range: whole years, whole months, single days."""
    found, day = [], start
    while day <= end:
        year_end, month_end = dt.date(day.year, 12, 31), (day.replace(day=28) + dt.timedelta(4)).replace(day=1)
        month_end -= dt.timedelta(1)
        if (day.month, day.day) == (1, 1) and year_end <= end:
            found.append(f"year={day:%Y}")
            last = year_end
        elif day.day == 1 and month_end <= end:
            found.append(f"year={day:%Y}/month={day:%m}")
            last = month_end
        else:
            found.append(f"year={day:%Y}/month={day:%m}/day={day:%d}")
            last = day
        if last == dt.date.max:
            break
        day = last + dt.timedelta(1)
    return found


class DataLoader:
    """Loads the records of a range of days.

    ``root`` holds the ``year=`` folders, or versions (``v1.1``) that hold them. Months and days in
    folder names have two digits.
    """

    def __init__(self, spark: SparkSession, root: str, suffix: str = SUFFIX):
        self.spark, self.root, self.suffix = spark, root.rstrip("/"), suffix

    def load(
        self,
        start: dt.date | str,
        end: dt.date | str,
        kinds: Iterable[str] | None = None,
        version: str | None = None,
    ) -> DataFrame:
        """Records of the days ``start`` to ``end``, of all kinds and versions unless named.

        Only the folders of the range are listed.
        """
        start, end = (dt.date.fromisoformat(str(d)) for d in (start, end))
        folders = "{" + ",".join(folders_of(start, end)) + "}"
        kinds = None if kinds is None else list(kinds)
        found = None
        # A version is a folder between the root and the years, or part of the root's own path.
        for place in ([version, "."] if version else [".", "v[0-9]*"]):
            try:
                raw = scan_pointers(self.spark, f"{self.root}/{place}/{folders}", kinds, self.suffix)
            except AnalysisException as error:
                if error.getCondition() != "PATH_NOT_FOUND":
                    raise
                continue
            found = raw if found is None else found.union(raw)
        if found is None:
            found = with_place(
                self.spark.range(0).select(F.lit("").alias("value"), F.lit("").alias("file_path"))
            )
        raw = in_range(found, start, end)
        if version is not None:
            raw = raw.where(F.col("version") == version)
        records = parsed(raw)
        return records if kinds is None else records.where(F.col("kind").isin(kinds))


def write_catalogue(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Columnar copy by year.

    Range partitioning by day and path spreads a heavy year, or a heavy day, over many files,
    and keeps each file to a few days so that its statistics prune.
    """
    ordered = ["year", "capture_date", "kind", "file_path"]
    (
        df.repartitionByRange(*ordered)
        .sortWithinPartitions(*ordered)
        .write.mode(mode).partitionBy("year").parquet(path)
    )


def merge_days(
    df: DataFrame, path: str, key: list[str], ts: str, tie: str, parts: tuple[str, ...] = ("year", "month", "day")
) -> DataFrame:
    """Add newly delivered records to a columnar copy by day; returns the copy.

    Only the days of ``df`` are read and written again; each key keeps the record that was published
    last, the higher ``tie`` among equals, so records delivered again leave the copy as it was. One
    writer at a time.
    """
    spark = df.sparkSession
    arrived = kept(df, "arrived")
    days = kept(arrived.select(*parts).distinct(), "days")
    try:
        known = spark.read.schema(df.schema).parquet(path)
        arrived = join_groups(known.select(*df.columns), days, list(parts), "left_semi").union(arrived)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
    latest = F.max_by(F.struct(*df.columns), F.struct(ts, tie)).alias("__row")
    # Stored before it replaces what it was read from.
    merged = kept(arrived.groupBy(*parts, *[k for k in key if k not in parts]).agg(latest).select("__row.*"), "merged")
    (
        merged.repartitionByRange(*parts, *key).sortWithinPartitions(*parts, *key)
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path)
    )
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)


def write_pointers(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Record texts by day; a file holds the records one task has for that day.

    Scanned back (with the suffix ``.txt``) they give the same records.
    """
    write_texts(render_pointer(df).repartitionByRange("year", "month", "day", "out.path"), path, mode)


def write_texts(rendered: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """The texts in ``value`` to files below the folder of their day."""
    (
        rendered.select(
            "year",
            F.lpad("month", 2, "0").alias("month"),
            F.lpad("day", 2, "0").alias("day"),
            "value",
        )
        .write.mode(mode).partitionBy("year", "month", "day").text(path)
    )
