"""Pointer text to columns and back, and the digest that ties the columns together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayledger.functions.names import blank_to_null

LINE_WIDTH = 80
# Fixed value: what may stand between a key and its value.
GAP = r"(?:[ \t]+|[ \t]*\n    )"


def parse_pointer(df: DataFrame, text_col: str = "value") -> DataFrame:
    """Replace the record text by typed columns.

    Keys are looked up by name over the whole text of their section, so their order and a URL
    folded on to its own line do not matter. A value stands on the line of its key or, folded, on
    the next one behind four spaces. What a record lacks, or leaves empty, is NULL.
    """
    text = F.col(text_col)
    source = F.regexp_extract(text, r"(?s)\ndeps:(.*?)(?=\nouts:|$)", 1)
    local = F.regexp_extract(text, r"(?s)\nouts:(.*)$", 1)

    def field(section: Column, key: str, shape: str = r"(\S+)") -> Column:
        return blank_to_null(F.regexp_extract(section, rf"\n[- ] {key}:{GAP}{shape}", 1))

    def bytes_of(section: Column) -> Column:
        return field(section, "size").try_cast("bigint")

    return df.select(
        *[c for c in df.columns if c != text_col],
        blank_to_null(F.regexp_extract(text, r"^md5:[ \t]+(\S+)", 1)).alias("stage_md5"),
        field_flag(text).alias("frozen"),
        F.struct(
            field(source, "checksum", r"'\"([^\"]*)\"'").alias("etag"),
            bytes_of(source).alias("size"),
            field(source, "hash").alias("hash"),
            field(source, "path").alias("url"),
        ).alias("dep"),
        F.struct(
            field(local, "hash").alias("hash"),
            field(local, "path").alias("path"),
            field(local, "md5").alias("md5"),
            bytes_of(local).alias("size"),
        ).alias("out"),
        F.regexp_count(source, F.lit(r"\n- ")).alias("n_deps"),
        F.regexp_count(local, F.lit(r"\n- ")).alias("n_outs"),
    )


def field_flag(text: Column) -> Column:
    return F.regexp_extract(text, r"\nfrozen:[ \t]+(\S+)", 1).try_cast("boolean")


def split_records(df: DataFrame, text_col: str = "value") -> DataFrame:
    """One row per record of a text that holds any number of them, one after the other.

    A record begins with its digest, the only key of that name at the start of a line.
    """
    starts = F.split(F.col(text_col), r"(?m)(?=^md5:)")
    return df.withColumn(text_col, F.explode(starts))


def render_pointer(df: DataFrame, text_col: str = "value") -> DataFrame:
    """Add the record text in the usual key order; a URL too long for its line gets its own.

    The text of an incomplete record is NULL.
    """
    url_line = F.concat(F.lit("  path: "), F.col("dep.url"))
    folded = F.concat(F.lit("  path: \n    "), F.col("dep.url"))
    lines = [
        F.concat(F.lit("md5: "), F.col("stage_md5")),
        F.concat(F.lit("frozen: "), F.col("frozen").cast("string")),
        F.lit("deps:"),
        F.concat(F.lit("- checksum: '\""), F.col("dep.etag"), F.lit("\"'")),
        F.concat(F.lit("  size: "), F.col("dep.size").cast("string")),
        F.concat(F.lit("  hash: "), F.col("dep.hash")),
        F.when(F.length(url_line) > LINE_WIDTH, folded).otherwise(url_line),
        F.lit("outs:"),
        F.concat(F.lit("- hash: "), F.col("out.hash")),
        F.concat(F.lit("  path: "), F.col("out.path")),
        F.concat(F.lit("  md5: "), F.col("out.md5")),
        F.concat(F.lit("  size: "), F.col("out.size").cast("string")),
    ]
    return df.withColumn(text_col, F.concat(*[F.concat(line, F.lit("\n")) for line in lines]))


def stage_text() -> Column:
    """The JSON text whose md5 is the stage digest; sizes and the frozen flag are not part of it."""
    return F.concat(
        F.lit('{"deps": [{"checksum": "\\"'), F.col("dep.etag"),
        F.lit('\\"", "hash": "'), F.col("dep.hash"),
        F.lit('", "path": "'), F.col("dep.url"),
        F.lit('"}], "outs": [{"hash": "'), F.col("out.hash"),
        F.lit('", "md5": "'), F.col("out.md5"),
        F.lit('", "path": "'), F.col("out.path"), F.lit('"}]}'),
    )


def stage_digest(df: DataFrame) -> DataFrame:
    """Add the recomputed ``stage_digest`` and whether it equals the one on record."""
    return df.withColumn("stage_digest", F.md5(stage_text())).withColumn(
        "stage_ok", F.col("stage_digest").eqNullSafe(F.col("stage_md5"))
    )
