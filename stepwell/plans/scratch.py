"""Intermediate tables in the folder that driver and executors share.

Executors come and go: what a later step reads again lies in ``spark.checkpoint.dir``, never on
one machine's disk. The cluster names that folder. Only a local session, where driver and
executors are one process, gets a default.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

LOCAL_DEFAULT = "/tmp/checkpoints"


def shared_root(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        return LOCAL_DEFAULT
    raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")


def shared_folder(spark: SparkSession) -> str:
    """A new folder name below the shared one, e.g. for one intermediate table."""
    return f"{shared_root(spark)}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as parquet into the shared folder and read it back: cuts lineage, and every
    reader sees the same rows even if an executor that made some of them is lost."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """``df.checkpoint()``, for the small tables of an iteration."""
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.sparkContext.setCheckpointDir(shared_root(spark))
    return df.checkpoint()


def clear_scratch(spark: SparkSession) -> bool:
    """Delete every intermediate table of this application. Results not yet written or collected
    may still read them, so call it between jobs or at the end."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_root(spark)}/{spark.sparkContext.applicationId}")
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return files.delete(place, True)
