"""Cutting lineage through the shared folder of the cluster."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from kelpline.sources.files import Files


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; only where that is unset (tests, a
    single machine) a temporary one."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="kelpline-"))
    return context.getCheckpointDir()


_WRITTEN: list[str] = []


def cut_lineage(df: DataFrame) -> DataFrame:
    """*df* written as a table in the shared folder and read again.

    Later reads survive lost executors and prune columns.  The table stays until ``release``
    is called or the driver ends, since results made from it may be read until then.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/kelpline-tables/{uuid.uuid4().hex}"
    if not _WRITTEN:
        atexit.register(_release_quietly, spark)
    _WRITTEN.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Remove the tables written so far; to be called by a driver that lives on, once the results made
    from them have been written or collected.  Returns how many there were."""
    n = len(_WRITTEN)
    while _WRITTEN:
        Files(spark).remove(_WRITTEN.pop())
    return n


def _release_quietly(spark: SparkSession) -> None:
    try:
        release(spark)
    except Exception:  # the session has ended; its cluster's folder is the cluster's to clean
        pass
