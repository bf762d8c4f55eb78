"""Intermediate tables in the folder the cluster shares.

A table that several later jobs read is written once and read back, so the source is scanned
once, the lineage is cut, and a lost executor costs only re-reading files. The folder is the
session's `spark.checkpoint.dir`, else the one given to `SparkContext.setCheckpointDir`; a temporary
folder is used only by a local-mode session that names none.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: dict[str, list[str]] = {}
_local_folder: str | None = None


def shared_folder(spark: SparkSession) -> str:
    global _local_folder
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    chosen = spark.sparkContext._jsc.sc().getCheckpointDir()
    if chosen.isDefined():
        return chosen.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")
    if _local_folder is None:
        _local_folder = tempfile.mkdtemp(prefix="riskloom-")
    return _local_folder


def write_shared(df: DataFrame) -> DataFrame:
    """Write `df` once and return a DataFrame over the written files."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/riskloom/{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_shared(spark: SparkSession) -> int:
    """Delete the intermediate tables this application wrote; returns how many there were.

    DataFrames built on them can no longer be evaluated afterwards.
    """
    jvm = spark._jvm
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    dropped = 0
    mine = _written.get(spark.sparkContext.applicationId, [])
    while mine:
        path = jvm.org.apache.hadoop.fs.Path(mine.pop())
        path.getFileSystem(hadoop).delete(path, True)
        dropped += 1
    return dropped
