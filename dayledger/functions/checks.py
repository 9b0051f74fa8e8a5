"""Rules that every record has to meet."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayledger.functions.names import base_name, date_of, strict_date, url_date
from dayledger.functions.tags import TRACE_TAG, hex_value


def record_rules(suffix: str = ".dvc") -> dict[str, Column]:
    """The conditions of a sound catalogue record, by the name of the rule.

    ``name_is_file`` is for records in files of their own; ``suffix`` is that of these files.
    """
    digest = r"^[0-9a-f]{32}$"
    day = F.concat_ws(
        "", F.lpad("year", 4, "0"), F.lpad("month", 2, "0"), F.lpad("day", 2, "0")
    )
    partition_date = strict_date(day)
    tag_size = F.when(
        F.col("dep.etag").rlike(TRACE_TAG),
        hex_value(F.regexp_extract(F.col("dep.etag"), TRACE_TAG, 1)),
    )
    path = F.try_parse_url(F.col("dep.url"), F.lit("PATH"))
    return {
        "frozen": F.col("frozen"),
        "hash_name": (F.col("dep.hash") == "md5") & (F.col("out.hash") == "md5"),
        "digest_shape": F.col("stage_md5").rlike(digest) & F.col("out.md5").rlike(digest),
        "one_dep_one_out": (F.col("n_deps") == 1) & (F.col("n_outs") == 1),
        "sizes_agree": F.col("dep.size") == F.col("out.size"),
        "name_is_file": F.concat(F.col("out.path"), F.lit(suffix)) == base_name(F.col("file_path")),
        "name_is_url": F.col("out.path") == base_name(path),
        "name_date": date_of(F.col("out.path")) == partition_date,
        "url_date": url_date(path) == partition_date,
        "size_positive": F.col("out.size") > 0,
        "tag_size": ~F.col("kind").eqNullSafe("trace") | (tag_size == F.col("out.size")),
        "calendar_date": partition_date.isNotNull(),
    }


def validate(df: DataFrame, rules: Mapping[str, Column], into: str = "failed") -> DataFrame:
    """Add the names of the rules a row fails. A condition that comes out NULL has failed."""
    failures = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]
    return df.withColumn(into, F.array_compact(F.array(*failures)))


def violations(df: DataFrame, rules: Mapping[str, Column], keys: list[str]) -> DataFrame:
    """One row per record and failed rule."""
    checked = validate(df, rules)
    return checked.where(F.size("failed") > 0).select(*keys, F.explode("failed").alias("rule"))


def content_digest(df: DataFrame, col: str) -> DataFrame:
    """Add ``md5`` and ``n_bytes`` of a text or binary column."""
    return df.withColumns({"md5": F.md5(F.col(col)), "n_bytes": F.octet_length(F.col(col))})


def is_empty_payload(
    df: DataFrame, min_sizes: Mapping[str, int], kind: str = "kind", size: str = "size"
) -> DataFrame:
    """Flag payloads no larger than the empty file of their kind (a header and nothing else)."""
    flag = F.lit(False)
    for name, largest in min_sizes.items():
        flag = flag | ((F.col(kind) == name) & (F.col(size) <= largest))
    return df.withColumn("is_empty", F.coalesce(flag, F.lit(False)))
