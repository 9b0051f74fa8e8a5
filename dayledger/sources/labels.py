"""Label tables and label documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dayledger.functions.names import base_name, date_of, kind_of
from dayledger.operators.joins import DAMAGED
from dayledger.sources.pointers import plain_path

# The columns of the label table, in file order.
LABEL_SCHEMA = (
    "anomalyID INT, srcIP STRING, srcPort INT, dstIP STRING, dstPort INT, taxonomy STRING, "
    "heuristic INT, distance DOUBLE, nbDetectors INT, label STRING"
)


CORRUPT = "__corrupt"


def as_type(schema: str | T.StructType) -> T.StructType:
    return schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)


def as_text(schema: T.StructType) -> T.StructType:
    """The schema to read with: plain fields as text, and the text of rows that do not split."""
    plain = (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BooleanType)
    fields = [
        T.StructField(f.name, T.StringType() if isinstance(f.dataType, plain) else f.dataType)
        for f in schema
    ]
    return T.StructType([*fields, T.StructField(CORRUPT, T.StringType())])


def typed(rows: DataFrame, schema: T.StructType) -> DataFrame:
    """The fields in their types, and ``damaged`` where one has text that its type cannot hold."""
    broken = [F.col(CORRUPT).isNotNull()]
    columns = {}
    for field in schema:
        if isinstance(rows.schema[field.name].dataType, T.StringType):
            columns[field.name] = F.col(field.name).try_cast(field.dataType)
            broken.append(F.col(field.name).isNotNull() & columns[field.name].isNull())
    damaged = reduce(lambda a, b: a | b, broken)
    return rows.withColumns({DAMAGED: damaged, **columns}).drop(CORRUPT)


def with_file_columns(df: DataFrame) -> DataFrame:
    """Add path, day and kind of the file a row came from."""
    path = plain_path(F.col("_metadata.file_path"))
    name = base_name(path)
    return df.withColumns({
        "file_path": path, "capture_date": date_of(name), "file_kind": kind_of(name),
    })


def read_labels_csv(
    spark: SparkSession, paths: str | list[str], schema: str | T.StructType = LABEL_SCHEMA
) -> DataFrame:
    """Label rows with the day and kind of their file; an empty field is NULL.

    A file whose header names other columns, or in another order, fails the read. A row with a field
    that cannot be read has ``damaged`` set: its NULL is no wildcard.
    """
    schema = as_type(schema)
    rows = (
        spark.read.schema(as_text(schema))
        .option("header", "true")
        .option("enforceSchema", "false")
        .option("columnPruning", "false")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .option("ignoreLeadingWhiteSpace", "true")
        .option("ignoreTrailingWhiteSpace", "true")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.csv")
        .csv(paths)
    )
    return typed(with_file_columns(rows), schema)


def read_labels_xml(
    spark: SparkSession, paths: str | list[str], row_tag: str, schema: str | T.StructType
) -> DataFrame:
    """Label elements as rows; the caller knows the element and its fields.

    An element that cannot be read whole has ``damaged`` set.
    """
    schema = as_type(schema)
    rows = (
        spark.read.format("xml")
        .schema(as_text(schema))
        .option("columnNameOfCorruptRecord", CORRUPT)
        .option("rowTag", row_tag)
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.xml")
        .load(paths)
    )
    return typed(with_file_columns(rows), schema)
