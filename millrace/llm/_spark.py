"""Small helpers that all operators of the subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..storage import durable, read_table, shared_dir, written

__all__ = ["durable", "scan", "shared_dir", "table", "written"]

Scan = Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]


def scan(frame: DataFrame, columns: list[str], fn: Scan, schema: str) -> DataFrame:
    """Apply fn to each Arrow batch of the columns; nothing else leaves the source."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from fn(batch)

    return frame.select(*columns).mapInArrow(run, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/{name}.parquet")
