"""Rows kept between the stages of a job, in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def kept(df: DataFrame) -> DataFrame:
    """The rows of df as a checkpoint, so that what follows reads them instead of making them again, and a lost executor costs nothing."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, purpose: str = "kept") -> tuple[DataFrame, str]:
    """The rows of df, as kept() has them, but by columns and compressed, for tables that are large; and the folder that holds them."""
    folder = shared_folder(df.sparkSession, purpose)
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder), folder


def delete_folder(spark: SparkSession, folder: str) -> None:
    """Deletes a folder in the shared one, which nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def shared_folder(spark: SparkSession, purpose: str = "kept") -> str:
    """A new folder name in the one that driver and executors share.

    spark.checkpoint.dir names that. Where it is unset, a temporary folder serves if driver and executors are one process; a cluster needs a shared one.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if not configured and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        context.setCheckpointDir(configured or "file://" + tempfile.mkdtemp(prefix="sceneloom-"))
    return f"{context._jsc.sc().getCheckpointDir().get()}/{purpose}-{uuid.uuid4().hex[:12]}"
