"""Answers of a model kept as they come, so that a run that was stopped goes on where it was.

The work list is written once, in parts, and read as a stream, some parts a batch. Spark's checkpoint is the log of batches: a
batch's answers are committed together, and one that was cut short is asked again; no other row is. The list is what
it was when the first run wrote it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..storage import exists


def resumable(work: DataFrame, folder: str, ask: Callable[[DataFrame], DataFrame], parts: int = 16, parts_a_batch: int = 1) -> DataFrame:
    """What ask() gives for the rows of the work list, batch by batch; written below the folder, which a later call with the same one goes on with.

    ask() gets a stream and may only do what needs no other rows: columns and calls. A folder holds one list; a new list takes a new folder.
    """
    spark = work.sparkSession
    if not exists(spark, f"{folder}/work/_SUCCESS"):
        enough = work.rdd.getNumPartitions() >= parts
        (work.coalesce(parts) if enough else work.repartition(parts)).write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/work")
    rows = spark.readStream.schema(work.schema).option("maxFilesPerTrigger", parts_a_batch).parquet(f"{folder}/work")
    answered = ask(rows)
    query = answered.writeStream.format("parquet").option("compression", "zstd").option("path", f"{folder}/answers").option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(answered.schema).parquet(f"{folder}/answers")


def listed(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """The work list that a folder of resumable() holds."""
    return spark.read.schema(schema).parquet(f"{folder}/work")
