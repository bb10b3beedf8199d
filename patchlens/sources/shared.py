"""Intermediate tables in the folder that all machines of a cluster share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The cluster's `spark.checkpoint.dir`.

    Where it is not set: a temporary folder if all runs on this machine (a
    local master, as in tests), else an error, for files in one machine's
    folder are lost with it and unseen by the others.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not re.match(r"local(\[|$)", master):
            raise RuntimeError(f"spark.checkpoint.dir is not set: the machines of {master} share no folder")
        app = spark.sparkContext.applicationId
        found = _LOCAL.get(app) or _LOCAL.setdefault(app, tempfile.mkdtemp(prefix="checkpoint-"))
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str = "cut") -> str:
    """A new path in the shared folder. What is written below goes when the application ends."""
    folder = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}"
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(at)
    return f"{folder}/{name}-{uuid.uuid4()}"


def cut(df: DataFrame) -> DataFrame:
    """Write `df` to the shared folder and go on from the files, which outlive any executor.

    The files are Parquet: what follows reads only the columns it needs.
    """
    path = fresh_path(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def discard(*cuts: DataFrame) -> None:
    """Delete the files of cuts that nothing reads any more: what was made of them has been written."""
    for df in cuts:
        path = getattr(df, "_cut_path", None)
        if path:
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
