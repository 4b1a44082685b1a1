"""Staged tables in the folder that driver and executors share: later work starts from files, not from lineage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def stage_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or /tmp/checkpoints in a local session without one."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "/tmp/checkpoints"
    return found.rstrip("/")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back."""
    path = f"{stage_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unstage(df: DataFrame) -> None:
    """Delete a staged table that nothing reads any more."""
    spark = df.sparkSession
    root = stage_dir(spark).split("://")[-1].lstrip("/")
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if folder.split(":")[-1].lstrip("/").startswith(root):
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def sweep(spark: SparkSession, older_than_hours: float = 24.0) -> int:
    """Delete staged tables that were last written at least so many hours ago, and return how many. A result reads its
    staged tables until it is written, so the age must be more than the longest job takes."""
    import time

    root = spark._jvm.org.apache.hadoop.fs.Path(stage_dir(spark))
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return 0
    limit, gone = (time.time() - older_than_hours * 3600) * 1000, 0
    for found in fs.listStatus(root):
        # staged names end with a hyphen and 32 hexadecimal digits; nothing else in the folder is touched
        name = str(found.getPath().getName()).rpartition("-")[2]
        if len(name) == 32 and set(name) <= set("0123456789abcdef") and found.getModificationTime() <= limit:
            gone += bool(fs.delete(found.getPath(), True))
    return gone
