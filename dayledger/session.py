"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot join partition even when that costs one more shuffle afterwards.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Records are files of half a kilobyte: pack thousands of them into one task.
    "spark.sql.files.openCostInBytes": "65536",
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
}


def session(app: str = "dayledger", **settings: str) -> SparkSession:
    """The session with the settings above; arguments use ``__`` for the dots in a key."""
    builder = SparkSession.builder.appName(app)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in settings.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can read, as the cluster names it in ``spark.checkpoint.dir``.

    Only a session whose executors are threads of the driver may go without the setting.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return named or local_folder(spark.sparkContext.master)


@lru_cache(maxsize=1)
def local_folder(master: str) -> str:
    """A temporary folder for a process that is the whole cluster."""
    if not re.fullmatch(r"local(\[.*\])?", master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="dayledger-")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, below a folder of this application's own.

    That folder can be deleted as a whole when the application has ended.
    """
    application = f"{shared_folder(spark).rstrip('/')}/{spark.sparkContext.applicationId}"
    return f"{application}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Used for small results that a plan needs more than once. The size Spark sees afterwards is
    that of the files, so the planner broadcasts the table only below its own threshold.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
