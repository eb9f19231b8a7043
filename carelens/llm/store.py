"""Intermediate tables in the shared folder that the cluster names."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame


#: Spark's setting to remove an execution's shuffle files at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark) -> str:
    """``spark.checkpoint.dir`` of the session; only a local session (tests) that
    leaves it unset gets a folder of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="carelens-shared-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def stored(df: DataFrame, settings: dict | None = None) -> DataFrame:
    """Write once, read back: later plans and retries start from the table.

    The shuffle files of the write are dropped when it has ended, so that a chain
    of such steps needs the disk of its largest step and not of all of them.
    ``settings`` of the session hold for the write."""
    spark = df.sparkSession
    path = os.path.join(shared_folder(spark), "tables", uuid.uuid4().hex)
    settings = {CLEANUP: True} | (settings or {})
    before = {key: spark.conf.get(key, None) for key in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables of ``stored`` that no later plan reads."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def buckets_for(spark, size: int, per_bucket: int) -> int:
    """Number of buckets so that each holds about ``per_bucket``; at least the
    session's shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // per_bucket))
