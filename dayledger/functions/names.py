"""File names, dates and URLs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The six kinds of payload, counted as five because a day has one trace in either format.
KINDS = ["notice_csv", "notice_xml", "anomalous_csv", "anomalous_xml", "trace"]
LABEL_NAME = r"^(\d{8})_(notice|anomalous_suspicious)\.(csv|xml)$"
TRACE_NAME = r"^(\d{12})\.(dump|pcap)\.gz$"


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def blank_to_null(value: Column) -> Column:
    return F.when(value != "", value)


def strict_date(digits: Column) -> Column:
    """The date of eight digits, or NULL where they name no calendar day."""
    parts = [F.substring(digits, at, length) for at, length in ((1, 4), (5, 2), (7, 2))]
    return F.concat_ws("-", *parts).try_cast("date")


def kind_of(name: Column) -> Column:
    """The kind a file name stands for; NULL for other names."""
    label_set, label_format, trace_format = name_parts(name)
    short = F.when(label_set == "notice", "notice").otherwise("anomalous")
    return F.when(label_set != "", F.concat_ws("_", short, label_format)).when(
        trace_format != "", "trace"
    )


def name_parts(name: Column) -> tuple[Column, Column, Column]:
    """Label set, label format and trace format, each empty where the name has none."""
    return (
        F.regexp_extract(name, LABEL_NAME, 2),
        F.regexp_extract(name, LABEL_NAME, 3),
        F.regexp_extract(name, TRACE_NAME, 2),
    )


def date_of(name: Column) -> Column:
    """The day a file name starts with."""
    return strict_date(F.regexp_extract(name, r"^(\d{8})", 1))


def classify_kind(df: DataFrame, path_col: str) -> DataFrame:
    """Add ``kind``, ``label_set``, ``format`` and ``compression``; NULL for other names."""
    name = base_name(F.col(path_col))
    label_set, label_format, trace_format = name_parts(name)
    return df.withColumns({
        "kind": kind_of(name),
        "label_set": blank_to_null(label_set),
        "format": F.coalesce(blank_to_null(label_format), blank_to_null(trace_format)),
        "compression": F.when(trace_format != "", "gzip"),
    })


def capture_time(df: DataFrame, path_col: str, zone: str = "Asia/Tokyo") -> DataFrame:
    """Add ``name_date`` and, for names that hold a time of day, ``captured_at``.

    The names state no time zone, so it is a parameter.
    """
    name = base_name(F.col(path_col))
    day = date_of(name)
    clock = F.regexp_extract(name, r"^\d{8}([01]\d|2[0-3])([0-5]\d)", 0)
    minutes = F.substring(clock, 9, 2).cast("bigint") * 60 + F.substring(clock, 11, 2).cast("bigint")
    # The time of day as if in UTC; reading it in the zone does not involve the session's zone.
    as_written = F.timestamp_micros((F.unix_date(day) * 1440 + minutes) * 60_000_000)
    return df.withColumns({
        "name_date": day,
        "captured_at": F.when(clock != "", F.to_utc_timestamp(as_written, zone)),
    })


def url_parts(df: DataFrame, url_col: str) -> DataFrame:
    """Add the parts of a URL: scheme, host, path, query, fragment, base name and date."""
    url = F.col(url_col)
    parts = {
        f"url_{label}": blank_to_null(F.try_parse_url(url, F.lit(part)))
        for label, part in (("scheme", "PROTOCOL"), ("host", "HOST"), ("path", "PATH"),
                            ("query", "QUERY"), ("fragment", "REF"))
    }
    path = F.try_parse_url(url, F.lit("PATH"))
    parts["url_name"] = blank_to_null(base_name(path))
    parts["url_date"] = url_date(path)
    return df.withColumns(parts)


def url_date(path: Column) -> Column:
    """The day a path names, as ``/YYYY/MM/DD/`` folders or as ``/YYYY/YYYYMMDDhhmm`` names."""
    folders = F.concat(*[F.regexp_extract(path, r"/(\d{4})/(\d{2})/(\d{2})/", i) for i in (1, 2, 3)])
    named = F.regexp_extract(path, r"/(\d{4})/(\1\d{4})\d{4}\.", 2)
    return strict_date(F.coalesce(blank_to_null(folders), blank_to_null(named)))
