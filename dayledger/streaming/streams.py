"""The catalogue as a stream: arrivals, sessions, re-delivery, lateness and completeness.

Every operator is a DataFrame to DataFrame function that also runs on a batch DataFrame.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dayledger.operators.coverage import has_kinds
from dayledger.session import fresh_path
from dayledger.sources.pointers import (
    RECORD_SCHEMA,
    SUFFIX,
    name_glob,
    parsed,
    with_path_columns,
)
from dayledger.streaming.results import ResultTable

#: Parts in which `day_alarms` keeps the keys of a day.
ALARM_PARTS = 64
#: How keys are written as text and read back, times to the microsecond.
KEY_TEXT = {
    "timeZone": "UTC",
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}


def stream_pointers(
    spark: SparkSession,
    root: str,
    kinds: Iterable[str] | None = None,
    files_per_batch: int | None = None,
    suffix: str = SUFFIX,
) -> DataFrame:
    """New records below ``root`` as a stream of parsed rows; a file may hold any number of them."""
    reader = (
        spark.readStream.format("text")
        .schema(RECORD_SCHEMA)
        .option("wholetext", "true")
        .option("pathGlobFilter", name_glob(kinds, suffix))
    )
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    records = parsed(with_path_columns(reader.load(root), suffix))
    return records if kinds is None else records.where(F.col("kind").isin(list(kinds)))


def stream_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A parquet table as a stream, be it one file in ``folder`` or a folder of files."""
    path = f"{folder.rstrip('/')}/{name}.parquet"
    table = spark.read.parquet(path)
    reader = spark.readStream.schema(table.schema)
    first = table.select("_metadata.file_name").first()
    if first and first["file_name"] == f"{name}.parquet":
        return reader.option("pathGlobFilter", first["file_name"]).parquet(folder)
    return reader.parquet(path)


def zoned(df: DataFrame, ts: str) -> DataFrame:
    """Event time with a zone, which watermarks require."""
    return df.withColumn(ts, F.col(ts).cast("timestamp"))


def arrivals(
    df: DataFrame,
    ts: str,
    window: str,
    measures: dict[str, Column],
    slide: str | None = None,
    delay: str = "1 day",
) -> DataFrame:
    """Measures per tumbling or sliding window."""
    framed = df.withWatermark(ts, delay).groupBy(F.window(ts, window, slide))
    return framed.agg(*[m.alias(name) for name, m in measures.items()]).select(
        F.col("window.start").alias("window_start"),
        F.col("window.end").alias("window_end"),
        *measures,
    )


def coverage_sessions(
    df: DataFrame, ts: str, gap: str, keys: list[str], delay: str = "1 day"
) -> DataFrame:
    """Stretches of records with no pause longer than ``gap``.

    With the session's settings map tasks merge what they hold into sessions before the shuffle, so
    a busy key sends its sessions and not its rows to one task.
    """
    framed = df.withWatermark(ts, delay).groupBy(*keys, F.session_window(ts, gap))
    return framed.agg(F.count("*").alias("n_rows")).select(
        *keys,
        F.col("session_window.start").alias("session_start"),
        F.col("session_window.end").alias("session_end"),
        "n_rows",
    )


def dedup_stream(
    df: DataFrame, ts: str, key: list[str], delay: str, spread: int = 0
) -> DataFrame:
    """Drop records that are delivered again within ``delay``; state holds keys only that long.

    ``spread`` first drops copies among that many groups of input partitions, for streams in which
    one record is delivered so often that its copies would burden one task.
    """
    if not df.isStreaming:
        return df.dropDuplicates(key)
    marked = df.withWatermark(ts, delay)
    if spread:
        salted = marked.withColumn("__salt", F.spark_partition_id() % spread)
        marked = salted.dropDuplicatesWithinWatermark([*key, "__salt"]).drop("__salt")
    return marked.dropDuplicatesWithinWatermark(key)


def late_split(df: DataFrame, captured: str, published: str, limit_seconds: int) -> DataFrame:
    """Flag records published later than the limit. Late rows are kept, so no watermark is set."""
    lag = F.unix_micros(F.col(published)) - F.unix_micros(F.col(captured))
    return df.withColumn("is_late", lag > F.lit(limit_seconds * 1_000_000))


def day_completeness(
    df: DataFrame, keys: list[str], kind: str, kinds: list[str], ts: str | None = None,
    delay: str = "1 day",
) -> DataFrame:
    """Kinds seen so far per key and whether that is all of them; state is one flag per kind.

    With ``ts`` the result is also by ``day`` of that time, and a day's state ends when the watermark
    passes it.
    """
    ordered = sorted(kinds)
    if ts is None:
        seen = has_kinds(df, keys, kind, ordered)
    else:
        daily = df.withWatermark(ts, delay).withColumn("__day", F.window(ts, "1 day"))
        seen = has_kinds(daily, [*keys, "__day"], kind, ordered).withColumn(
            "day", F.to_date("__day.start")
        ).drop("__day")
    flags = [F.col(f"__has_{i}") for i in range(len(ordered))]
    named = F.concat_ws("+", *[F.when(flag, k) for flag, k in zip(flags, ordered)])
    complete = reduce(lambda a, b: a & b, flags)
    return seen.withColumns({"seen": named, "complete": complete}).drop(*flags)


def day_alarms(
    df: DataFrame, keys: list[str], kind: str, kinds: list[str], ts: str, delay: str = "1 day",
    spread: int = ALARM_PARTS,
) -> DataFrame:
    """One row per key and day: ``complete`` as soon as all kinds were seen, or not complete once the
    watermark has passed the day's end.

    A day's state is one bit per kind and ends with a timer on event time, so a day that stays
    incomplete is told once, by the batch that moves the watermark past it, even if nothing of that
    key arrives any more. Days of a key may be null as keys may; rows without a time take no part. A
    batch DataFrame gives all days that it holds.

    The keys of a day share their timer, so they are kept and told in ``spread`` parts a day, by hash,
    and not one by one: a call of the state function costs much more than a key. A batch writes anew
    the parts it touches. Raise ``spread`` where a day has many millions of keys; a stream keeps the
    value it began with.
    """
    ordered = sorted(kinds)
    if not df.isStreaming:
        return day_completeness(df.where(F.col(ts).isNotNull()), keys, kind, ordered, ts)
    whole = (1 << len(ordered)) - 1
    bit = F.lit(0).cast("bigint")
    for i, name in enumerate(ordered):
        bit = F.when(F.col(kind) == name, F.lit(1 << i).cast("bigint")).otherwise(bit)
    ends = F.unix_millis(F.date_add(F.to_date(ts), 1).cast("timestamp"))
    # The key travels and is kept as a line of text, which has nulls and whole numbers of any size.
    packed = F.to_json(F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)]), KEY_TEXT)
    rows = df.withWatermark(ts, delay).where(F.col(ts).isNotNull()).select(
        ts, ends.alias("__ends"), packed.alias("__key"), bit.alias("__bit")
    ).withColumn("__part", F.pmod(F.xxhash64("__key"), F.lit(spread)))

    def of_part(part: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        masks = {}
        if state.exists:
            lines, numbers = state.get
            masks = dict(zip(lines.split("\n"), np.frombuffer(numbers, np.int64).tolist()))
        if state.hasTimedOut:
            state.remove()
            told = [key for key, mask in masks.items() if mask != whole]
        else:
            told = []
            for frame in frames:
                codes, found = pd.factorize(frame["__key"])
                bits = np.zeros(len(found), np.int64)
                np.bitwise_or.at(bits, codes, frame["__bit"].to_numpy(np.int64))
                for key, new in zip(found, bits.tolist()):
                    before = masks.get(key, 0)
                    masks[key] = before | new
                    if before | new == whole != before:
                        told.append(key)
            state.update(("\n".join(masks), np.fromiter(masks.values(), np.int64).tobytes()))
            state.setTimeoutTimestamp(int(part[0]))
        if told:
            yield pd.DataFrame({"__key": told, "__ends": part[0], "__mask": [masks[key] for key in told]})

    told = rows.groupBy("__ends", "__part").applyInPandasWithState(
        of_part, "__key STRING, __ends BIGINT, __mask BIGINT", "keys STRING, masks BINARY",
        "append", "EventTimeTimeout",
    )
    fields = T.StructType([T.StructField(f"k{i}", df.schema[k].dataType) for i, k in enumerate(keys)])
    key = F.from_json("__key", fields, {**KEY_TEXT, "mode": "FAILFAST"})
    named = [F.when(F.col("__mask").bitwiseAND(F.lit(1 << i)) != 0, name) for i, name in enumerate(ordered)]
    day = F.date_sub(F.to_date(F.timestamp_millis("__ends")), 1)
    return told.withColumn("__key", key).select(
        *[F.col(f"__key.k{i}").alias(k) for i, k in enumerate(keys)], day.alias("day"),
        F.concat_ws("+", *named).alias("seen"), (F.col("__mask") == whole).alias("complete"),
    )


def append_to_table(stream: DataFrame, out: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Process what has arrived, append finished rows to a parquet table and return the table."""
    spark = stream.sparkSession
    out = out or fresh_path(spark, "stream-out")
    (
        stream.writeStream.outputMode("append")
        .format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint or fresh_path(spark, "stream-state"))
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
    return spark.read.schema(stream.schema).parquet(out)


def batches_written(
    stream: DataFrame, mode: str, out: str | None, checkpoint: str | None
) -> DataFrame | None:
    """Process what has arrived, each batch to a folder of its own (a repeated batch replaces its own
    output only), and return what all runs so far have written, with the number of the batch."""
    spark = stream.sparkSession
    out = out or fresh_path(spark, "stream-out")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    (
        stream.writeStream.outputMode(mode)
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint or fresh_path(spark, "stream-state"))
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
    try:
        return spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])).parquet(out)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def latest_result(stream: DataFrame, out: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Process what has arrived and return the whole result so far.

    After a restart on the same ``out`` and ``checkpoint`` the last result stands until a batch
    replaces it.
    """
    written = batches_written(stream, "complete", out, checkpoint)
    if written is None:
        return stream.sparkSession.createDataFrame([], stream.schema)
    numbers = [int(n) for f in written.inputFiles() for n in re.findall(r"/batch=(\d+)/", f)]
    return written.where(F.col("batch") == max(numbers, default=0)).drop("batch")


def updated_result(
    stream: DataFrame, keys: list[str], out: str | None = None, checkpoint: str | None = None
) -> DataFrame:
    """Process what has arrived and return the last state of every key.

    Batches write only the keys that changed, to a ``ResultTable``; state that the watermark has
    passed is gone from the stream and stays in the result. A folder that a stream with another
    checkpoint writes is refused.
    """
    spark = stream.sparkSession
    checkpoint = checkpoint or fresh_path(spark, "stream-state")
    result = ResultTable(spark, out or fresh_path(spark, "stream-out"), stream.schema, keys)
    result.claim(checkpoint)
    (
        stream.writeStream.outputMode("update")
        .foreachBatch(result.write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
    return result.read()
