"""Records as JSON lines, and counts beside them."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession


def write_jsonl(rows: DataFrame, path: str, keep_nulls: bool = False, single: bool = False) -> None:
    """A folder of JSON lines, letters of any script as they are; null fields only when asked for. `single`: one part file, for small sets."""
    (rows.coalesce(1) if single else rows).write.mode("overwrite").option("ignoreNullFields", not keep_nulls).json(path)


def write_splits(rows: DataFrame, folder: str, prefix: str, splits: tuple[str, ...] = ("train", "valid"), keep_nulls: bool = False, order: tuple[str, ...] = ("position",), drop: tuple[str, ...] = ()) -> None:
    """One folder of JSON lines for each split, each in the order of the given columns; without `position` and `rank`."""
    for name in splits:
        part = rows.filter(rows["split"] == name)
        write_jsonl(part.orderBy(*order).drop("split", "position", "rank", *drop), f"{folder}/{prefix}{name}.jsonl", keep_nulls)


def write_text(spark: SparkSession, path: str, said: str) -> None:
    """A small file, through the file system that the path names."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    out.write(bytearray(said.encode()))
    out.close()


def write_stats(spark: SparkSession, path: str, stats: dict) -> None:
    write_text(spark, path, json.dumps(stats, indent=2))


def read_jsonl(spark: SparkSession, paths: list[str], schema: str | None = None) -> DataFrame:
    """Datasets put together."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.json(paths)
