"""Payload files: inventory and digests.

Listing and digests open files from tasks, through pyarrow's file systems: local folders as they
are, other schemes with pyarrow's own settings and credentials on every executor (Hadoop's settings
are not read).
"""

from __future__ import annotations

import fnmatch
import hashlib
import math
import os
import re
import sys
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dayledger.operators.slices import sliced
from dayledger.session import kept

# How a URI begins, and names that Spark's readers take as hidden.
ORIGIN = re.compile(r"^([A-Za-z][A-Za-z0-9+.-]*):(//[^/]*)?")
HIDDEN = ("_", ".")
BLOCK = 8 * 1024 * 1024
#: Entries of a folder that a task holds at a time.
PAGE = 2000
#: Folders from which on each one is walked with all below it; fewer are listed level by level.
WIDE = 64
#: The factor between the lengths that bound a class of files, when files are dealt by length.
CLASS = 1.02
ENTRIES = "path STRING, name STRING, is_folder BOOLEAN, length BIGINT, modified_us BIGINT"


@lru_cache(maxsize=16)
def opened(origin: str):
    """The file system of a scheme and authority."""
    from pyarrow import fs

    if origin in ("", "file:", "file://"):
        return fs.LocalFileSystem()
    scheme = re.sub("^s3[an]:", "s3:", origin)
    return fs.FileSystem.from_uri(scheme + "/")[0]


def file_system(uri: str):
    """The file system of a URI as Spark writes it, the URI's beginning and the plain path in it."""
    found = ORIGIN.match(uri)
    origin = found.group(0) if found else ""
    path = uri[len(origin):]
    if re.match("s3", origin):
        path = origin.split("//", 1)[1] + path
    return opened(origin), uri[: len(uri) - len(path)], path


def by_value(function: Callable) -> Callable:
    """A function that travels with the job, so executors need no copy of this package."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    return function


def entries_of(folder: str) -> Iterator[tuple]:
    """The entries of a folder one by one, hidden ones left out; none of a folder that is gone.

    A local folder is read as it is iterated, without length and time, which take a call an entry.
    The other file systems answer page by page, with both, but pyarrow gathers their pages.
    """
    from pyarrow import fs

    filesystem, start, path = file_system(folder)
    if isinstance(filesystem, fs.LocalFileSystem):
        try:
            with os.scandir(path) as found:
                for e in found:
                    if not e.name.startswith(HIDDEN):
                        yield f"{start}{path.rstrip('/')}/{e.name}", e.name, e.is_dir(), None, None
        except FileNotFoundError:
            return
    else:
        for e in filesystem.get_file_info(fs.FileSelector(path, allow_not_found=True)):
            if not e.base_name.startswith(HIDDEN):
                yield (
                    start + e.path, e.base_name, e.type == fs.FileType.Directory,
                    0 if e.size is None else e.size, (e.mtime_ns or 0) // 1000,
                )


def walked(folder: str, deep: bool) -> Iterator[tuple]:
    """The entries of a folder, and of all folders below it if ``deep``."""
    open_folders = [folder]
    while open_folders:
        for entry in entries_of(open_folders.pop()):
            if deep and entry[2]:
                open_folders.append(entry[0])
            yield entry


def lister(deep: bool) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Lists each folder, a page of entries at a time."""
    columns = [c.split()[0] for c in ENTRIES.split(", ")]

    def framed(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=columns).astype({"length": "Int64", "modified_us": "Int64"})

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        page: list[tuple] = []
        for batch in batches:
            for folder in batch["path"]:
                for entry in walked(folder, deep):
                    page.append(entry)
                    if len(page) >= PAGE:
                        yield framed(page)
                        page = []
        yield framed(page)

    return listed


def described(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Files with their length and time of modification, where the listing has not told them."""
    for batch in batches:
        rows = []
        for path, length, modified in zip(batch["path"], batch["length"], batch["modified_us"], strict=True):
            if pd.isna(length):
                filesystem, _, plain = file_system(path)
                info = filesystem.get_file_info(plain)
                length, modified = info.size or 0, (info.mtime_ns or 0) // 1000
            rows.append((path, int(length), int(modified)))
        yield pd.DataFrame(rows, columns=["path", "length", "modified_us"])


def scan_payloads(spark: SparkSession, root: str, name_glob: str = "*") -> DataFrame:
    """Path, length and modification time of the files below ``root``; contents stay unread.

    Folders are listed from tasks, one folder per row, level by level until there are ``WIDE`` of
    them; then each is walked whole. The driver sees only the number of folders of those few levels.
    Tasks pass the entries on in pages, so a folder of any size is many rows, and the names are dealt
    to as many tasks as shuffles have to look up lengths and times. Files without content, which file
    sources leave out, are listed too. Hidden files and all below hidden folders are not.
    """
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    level = spark.createDataFrame([(root.rstrip("/") or "/",)], "path STRING")
    files, folders = None, 1
    while folders:
        deep = folders >= WIDE
        spread = level.repartition(min(tasks, folders), "path")
        entries = kept(spread.mapInPandas(by_value(lister(deep)), ENTRIES), "level")
        own = entries.where("NOT is_folder")
        files = own if files is None else files.union(own)
        level = entries.where("is_folder").select("path")
        folders = 0 if deep else level.count()
    pattern = F.col("name").rlike(fnmatch.translate(name_glob).replace(r"\Z", "$").replace(r"\z", "$"))
    named = files.where(pattern).select("path", "length", "modified_us").repartition(tasks, "path")
    return named.mapInPandas(
        by_value(described), "path STRING, length BIGINT, modified_us BIGINT"
    ).select("path", "length", F.timestamp_micros("modified_us").alias("modificationTime"))


def file_md5(uri: str) -> str:
    """The digest of a file's bytes as they are, compressed or not."""
    filesystem, _, path = file_system(uri)
    digest = hashlib.md5()
    with filesystem.open_input_stream(path, compression=None) as stream:
        while block := stream.read(BLOCK):
            digest.update(block)
    return digest.hexdigest()


def digest_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield batch[["path", "length"]].assign(md5=[file_md5(path) for path in batch["path"]])


def shares(lengths: np.ndarray, counts: np.ndarray, tasks: int) -> np.ndarray:
    """How many files of each class each task gets: largest class first, to the tasks with least.

    ``lengths`` falls. The files of a class fill the tasks up to a common level, a file at a time, so
    a task's bytes exceed the mean by less than a file.
    """
    load = np.zeros(tasks)
    given = np.zeros((len(lengths), tasks), np.int64)
    for i, (length, count) in enumerate(zip(lengths, counts, strict=True)):
        size = max(float(length), 1.0)
        low, high = load.min(), load.min() + size * (count + 1)
        for _ in range(100):
            level = (low + high) / 2
            if np.maximum(0, np.floor((level - load) / size)).sum() < count:
                low = level
            else:
                high = level
        given[i] = np.maximum(0, np.floor((low - load) / size))
        # What the level leaves goes to the tasks that have least now.
        rest = int(count - given[i].sum())
        least = np.argsort(load + given[i] * size, kind="stable")
        given[i, least[np.arange(rest) % tasks]] += 1
        load += given[i] * size
    return given


def dealt_by_length(files: DataFrame, tasks: int) -> DataFrame:
    """``files`` (path, length) in ``tasks`` partitions of about equal bytes.

    A histogram of lengths, some two thousand classes at most, tells how many files of which class a
    task gets. Files are numbered from the largest down, in slices, and the number finds the task.
    """
    floor = F.greatest(F.coalesce("length", F.lit(0)), F.lit(1))
    # The class of a length, the same in the histogram and in the order.
    classed = files.withColumn("__class", F.ceil(F.log(floor) / F.lit(math.log(CLASS))))
    order = [F.desc("__class"), F.asc("path")]
    cut = sliced(classed, order)
    classes = cut.groupBy("__class").agg(F.count("*").alias("n")).collect()
    classes.sort(key=lambda r: -r["__class"])
    counts = np.array([r["n"] for r in classes], np.int64)
    given = shares(np.array([CLASS ** r["__class"] for r in classes]), counts, tasks)
    ends = np.cumsum(given.ravel())

    earlier = Window.orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut.groupBy("__slice").agg(F.count("*").alias("__rows")).select(
        "__slice", F.coalesce(F.sum("__rows").over(earlier), F.lit(0)).alias("__start")
    )
    inside = F.row_number().over(Window.partitionBy("__slice").orderBy(*order)) - 1
    numbered = cut.withColumn("__inside", inside).join(starts, "__slice")

    def task_of(number: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(ends, number.to_numpy(), side="right") % tasks)

    task = F.pandas_udf(by_value(task_of), "int")(F.col("__start") + F.col("__inside"))
    return numbered.select("path", "length", task.alias("__task")).repartitionById(tasks, "__task")


def digest_files(paths: DataFrame, tasks: int | None = None) -> DataFrame:
    """Path, length and md5 of files of any size, read in blocks.

    An md5 cannot be split, so the unit of work is a file. Files are dealt by their length, so that
    the tasks (as many as shuffles have unless named) read about the same number of bytes.
    """
    listed = paths.select("path", "length")
    tasks = tasks or int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt_by_length(listed, tasks).select("path", "length").mapInPandas(
        by_value(digest_batches), "path STRING, length BIGINT, md5 STRING"
    )


def payload_digests(spark: SparkSession, root: str, name_glob: str = "*") -> DataFrame:
    """Digests of all files below ``root``."""
    return digest_files(scan_payloads(spark, root, name_glob))
