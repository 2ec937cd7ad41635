"""Connected components of a table of edges, by forests of bounded parts and alternating stars.

The edges are dealt to parts of at most `PART` and each part is replaced by the stars of its own
components, which is all if there is but one part. Else rounds follow: each replaces every vertex's neighbours by links to the smallest of them, first the larger
ones, then the smaller; joins and minima only, so no neighbourhood is gathered. A round's edges
are written to the shared folder. Edges with a null end are left out; loops are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import durable


#: Edges that one task joins in memory.
PART = 1 << 20


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(vertex, smallest vertex of its component) for vertices that aren't the smallest; a, b: ends of edges."""
    names, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(names))
    while len(a):
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        open_ = low != high
        a, b, low, high = a[open_], b[open_], low[open_], high[open_]
        np.minimum.at(root, high, low)
        while not np.array_equal(up := root[root], root):
            root = up
    moved = root != np.arange(len(names))
    return names[moved], names[root[moved]]


def _forests(edges: DataFrame, parts: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = pa.Table.from_batches(held) if (held := list(batches)) else None
        if got is not None:
            a, b = forest(got.column("a").to_numpy(), got.column("b").to_numpy())
            yield pa.record_batch([pa.array(a, got.schema.field("a").type), pa.array(b, got.schema.field("b").type)], names=["a", "b"])

    return edges.repartition(parts).mapInArrow(run, edges.schema)


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").filter("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).filter("a <> b").distinct()


def components(edges: DataFrame, part: int = PART) -> DataFrame:
    """(v, root) for each vertex of the edges (a, b); root is the smallest vertex that it reaches."""
    now = durable(edges.filter("a <> b"))
    n = now.count()
    now = durable(_forests(now, max(1, -(-n // part))))
    mark = seen = None
    while n > part and (mark is None or mark != seen):
        mark = seen
        now = durable(_small(_large(now)))
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    roots = now.select(F.col("b").alias("v"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("v"), F.col("b").alias("root")).unionByName(roots)
