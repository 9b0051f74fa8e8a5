"""The result of an update stream as a table: a base, the batches after it, a committed version.

A batch writes only the keys that changed, to a folder of its own. Every ``COMPACT`` batches the base
and the batches after it are merged into a new base, whose number is then committed by an empty
marker file; readers take the last committed base and the later batches, so what a read touches does
not grow with the number of batches. A batch that is repeated after a failure replaces its own output
and merges again only if its base was not committed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Batches between two bases.
COMPACT = 20


class ResultTable:
    """Rows by key below ``out``; ``stream`` names the one stream that may write it."""

    def __init__(self, spark: SparkSession, out: str, schema: T.StructType, keys: list[str]):
        self.spark, self.out, self.schema, self.keys = spark, out.rstrip("/"), schema, keys
        self.stored = T.StructType([*schema.fields, T.StructField("__batch", T.LongType())])

    def _at(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.out}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _names(self, name: str) -> list[str]:
        files, path = self._at(name)
        return [s.getPath().getName() for s in files.listStatus(path)] if files.exists(path) else []

    def _mark(self, name: str) -> None:
        files, path = self._at(name)
        files.create(path, True).close()

    def _drop(self, name: str) -> None:
        files, path = self._at(name)
        files.delete(path, True)

    def claim(self, stream: str) -> None:
        """Refuse a folder that another stream, known by its checkpoint, writes."""
        owner = stream.replace("/", "|")
        owners = [n for n in self._names("_owner") if not n.endswith(".crc")]
        if owners and owners != [owner]:
            raise ValueError(f"{self.out} holds the result of another stream: {owners[0]}")
        if not owners:
            self._mark(f"_owner/{owner}")

    def versions(self) -> list[int]:
        """The committed bases."""
        return sorted(int(n) for n in self._names("_commits") if n.isdigit())

    def batches(self) -> list[int]:
        """The batches that are written whole."""
        numbers = sorted(int(n[6:]) for n in self._names("") if n.startswith("batch="))
        return [n for n in numbers if "_SUCCESS" in self._names(f"batch={n}")]

    def _merged(self, base: int | None, batches: list[int]) -> DataFrame:
        paths = [f"{self.out}/base={base}"] if base is not None else []
        paths += [f"{self.out}/batch={n}" for n in batches]
        if not paths:
            return self.spark.createDataFrame([], self.stored)
        rows = self.spark.read.schema(self.stored).parquet(*paths)
        if not batches:
            return rows
        others = [c for c in rows.columns if c not in self.keys]
        last = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*others), "__batch").alias("__last"))
        return last.select(*self.keys, "__last.*").select(*rows.columns)

    def read(self) -> DataFrame:
        """The last row of every key."""
        base = max(self.versions(), default=None)
        later = [n for n in self.batches() if base is None or n > base]
        return self._merged(base, later).select(*self.schema.fieldNames())

    def write(self, batch: DataFrame, number: int) -> None:
        """The changed rows of a batch, and a new base if enough batches have come since the last."""
        rows = batch.withColumn("__batch", F.lit(number).cast("bigint"))
        rows.write.mode("overwrite").parquet(f"{self.out}/batch={number}")
        versions = self.versions()
        if number in versions:
            return
        base = max((v for v in versions if v < number), default=None)
        later = [n for n in self.batches() if n <= number and (base is None or n > base)]
        if len(later) < COMPACT:
            return
        self._merged(base, later).write.mode("overwrite").parquet(f"{self.out}/base={number}")
        self._mark(f"_commits/{number}")
        # Readers may still hold the base before; what that one replaced can go.
        if base is not None:
            for n in self.batches():
                if n <= base:
                    self._drop(f"batch={n}")
            for v in versions:
                if v < base:
                    self._drop(f"_commits/{v}")
                    self._drop(f"base={v}")
