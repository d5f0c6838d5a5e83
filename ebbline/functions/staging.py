"""The session's folder for derived tables, below the shared checkpoint folder.

`spark.checkpoint.dir` names the shared folder on a cluster. What is staged lives as long
as the session: the file system removes the session's folder when it is closed.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session.

    A session on one machine without one gets a temporary folder; any cluster, a local
    one of several processes too, has to name its own in `spark.checkpoint.dir`.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        configured = tempfile.mkdtemp(prefix="ebbline-")
    context.setCheckpointDir(configured)
    return configured


def _session_folder(spark: SparkSession) -> str:
    """A folder that goes when the application ends."""
    path = f"{ensure_checkpoint_dir(spark)}/session-{spark.sparkContext.applicationId}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        fs.mkdirs(folder)
        fs.deleteOnExit(folder)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder of the session below the shared checkpoint folder."""
    return f"{_session_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str = "stage", partition_by: Sequence[str] = ()) -> DataFrame:
    """Write a derived table once, for operators that read it several times.

    The copy is in the shared folder: a lost executor costs a re-read, not a
    second derivation from the source tables. With `partition_by`, who reads one value of
    these columns reads that value's files only.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*[f"`{c}`" for c in df.columns])
