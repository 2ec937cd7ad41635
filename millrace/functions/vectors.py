"""Vectors as arrays of doubles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def normalised(v: Column) -> Column:
    """The vector at length one; a zero vector stays."""
    n = norm(v)
    return F.transform(v, lambda x: x.cast("double") / F.when(n == 0, F.lit(1.0)).otherwise(n))


def centroids(rows: DataFrame, label: str, vector: str) -> DataFrame:
    """(label, centroid): the mean of each label's vectors, component by component.

    Components are summed where the rows are, so a label of any size takes one short row a task.
    """
    each = rows.select(label, F.posexplode(vector).alias("i", "x"))
    mean = each.groupBy(label, "i").agg(F.avg("x").alias("x"))
    pairs = F.array_sort(F.collect_list(F.struct("i", "x")))  # as many as the vectors have components
    return mean.groupBy(label).agg(F.transform(pairs, lambda p: p["x"]).alias("centroid"))
