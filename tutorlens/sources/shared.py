"""Places that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables: the session's spark.checkpoint.dir.

    Where it is unset, a temporary folder serves a local master, as in tests; on a cluster
    that is an error, as each executor would write to a disk of its own.
    """
    context = spark.sparkContext
    had = context._jsc.sc().getCheckpointDir()
    if had.isDefined():
        return had.get()
    given = spark.conf.get("spark.checkpoint.dir", None)
    if not given and not (context.master == "local" or context.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(given or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


def settled(df: DataFrame) -> DataFrame:
    """The same rows, computed once and kept in the shared checkpoint folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path below the shared checkpoint folder."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
