"""Rows that outlive executors, in the folder that the whole cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def is_local(spark: SparkSession) -> bool:
    """Whether driver and executors are one process."""
    return spark.sparkContext.master.split("[")[0] == "local"


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; where none is set, a temporary one in local mode, as in tests, and an error on a cluster."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not is_local(spark):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="millrace-"))
    return sc.getCheckpointDir()


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder, in the file system that the path names."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def durable(rows: DataFrame) -> DataFrame:
    """Write the rows to the shared folder and go on from there."""
    shared_dir(rows.sparkSession)
    return rows.checkpoint(eager=True)


def written(rows: DataFrame, path: str | None = None) -> DataFrame:
    """As durable(), as compressed Parquet, of which later steps read the columns that they need."""
    path = path or fresh_path(rows.sparkSession)
    rows.write.option("compression", "zstd").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def fresh_path(spark: SparkSession) -> str:
    """A place in the shared folder that nothing is at."""
    return f"{shared_dir(spark)}/millrace-{uuid.uuid4().hex}"


def forget(spark: SparkSession, path: str) -> None:
    """Delete a table that written() made at the path, once nothing reads it any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


#: Bytes of a table of few files up to which its rows are dealt over the cores; a larger one is read by as many tasks as it has parts.
SMALL_BYTES = 64 << 20


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table; a small one of few files is dealt over the cores, as one task would read it otherwise."""
    rows = spark.read.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return rows.repartition(cores) if size <= SMALL_BYTES and len(rows.inputFiles()) < cores else rows
