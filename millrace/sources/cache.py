"""A cache of embeddings by content and model, as Parquet."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import exists

WIDTH = 3072
SCHEMA = "key string, embedding array<float>"


def key(content: Column, model: str) -> Column:
    return F.sha2(F.concat(content, F.lit("\x1f" + model)), 256)


def split(rows: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with a cached embedding, rows without one)."""
    return rows.join(cache, "key"), rows.join(cache, "key", "left_anti")


def read(rows: DataFrame, path: str) -> DataFrame:
    """The cache at a path, empty if there is none yet."""
    spark = rows.sparkSession
    return spark.read.schema(SCHEMA).parquet(path) if exists(spark, path) else spark.createDataFrame([], SCHEMA)


def embedded(rows: DataFrame, content: str, embed: Callable[[list[str]], np.ndarray], model: str = "default", path: str | None = None) -> DataFrame:
    """The rows with `embedding`: from the cache, else by `embed`, a batch of texts a call; what is new is added to the cache."""
    keyed = rows.withColumn("key", key(F.col(content), model))
    texts = keyed.select("key", F.col(content).alias("text")).dropDuplicates(["key"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            vectors = np.asarray(embed(frame["text"].tolist()), np.float32)
            yield pd.DataFrame({"key": frame["key"], "embedding": list(vectors)})

    if path is None:
        return keyed.join(texts.mapInPandas(run, SCHEMA), "key").drop("key")
    missing = texts.join(read(rows, path), "key", "left_anti")
    missing.mapInPandas(run, SCHEMA).write.mode("append").parquet(path)
    return keyed.join(read(rows, path).dropDuplicates(["key"]), "key").drop("key")
