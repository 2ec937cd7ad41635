"""Splits into train, valid and test by position.

Every split works out its input once: the rows are written to the shared folder, and what follows reads keys from there.
A split by hash moves no rows at all: the key at which a part ends is found from numbers of keys by the first digits of their hashes.
"""

from __future__ import annotations

import random
from bisect import bisect_left
from collections.abc import Callable
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import forget, fresh_path, written

#: Rows up to which the exact permutation is worked out on the driver.
EXACT_ROWS = 1_000_000
#: Keys of one group of first digits that are looked at one by one.
_FEW = 1000


def numbered(rows: DataFrame, order: list, name: str = "position", once: bool = False) -> DataFrame:
    """The rows with their place in the order, from 0.

    Rows are dealt by range, sorted and numbered within their range as they are written, so they are shuffled once; only the ranges'
    sizes meet in one place. Both the rows (unless `once` says that reading them again costs nothing) and the dealt rows are
    written, as ranges are drawn anew each time; the first go when the second are there.
    """
    spark, path = rows.sparkSession, fresh_path(rows.sparkSession)
    held = rows if once else written(rows, path)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # The number's upper bits are the range's, the lower ones the place of a row in it.
    dealt = written(held.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id()))
    if not once:
        forget(spark, path)
    dealt = dealt.withColumn("__p", F.shiftright("__id", 33))
    sizes = dealt.groupBy("__p").agg(F.count(F.lit(1)).alias("__c"))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__p", F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__o"))
    within = F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    return dealt.join(F.broadcast(offsets), "__p").withColumn(name, (F.col("__o") + within).cast("long")).drop("__p", "__o", "__id")


def share(n: int, ratio: float) -> int:
    return int(n * ratio)


def n_valid(n: int, ratio: float = 0.1) -> int:
    """At least one row, of none no row."""
    return max(1, share(n, ratio)) if n else 0


def hash_rank(seed: int, key: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")))


Ends = Callable[[int], list[tuple[str, int]]]


def _counted(keys: DataFrame, digits: int) -> list[tuple[str, int]]:
    """Numbers of keys by the first digits of their rank, in order; as many as there are such digits at most."""
    found = keys.groupBy(F.substring("rank", 1, digits).alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()
    return sorted((r["d"], r["n"]) for r in found)


def _holding(groups: list[tuple[str, int]], place: int) -> tuple[str, int, int]:
    """The group that holds the place (from 1), how many stand before it, and its size."""
    ends = list(accumulate(n for _, n in groups))
    at = bisect_left(ends, place)
    return groups[at][0], ends[at] - groups[at][1], groups[at][1]


def _last_key(keys: DataFrame, groups: list[tuple[str, int]], place: int, key: str) -> tuple[str, object]:
    """Rank and key of the row at a place, from 1."""
    digits, before, size = _holding(groups, place)
    while size > _FEW and len(digits) < 32:
        inside = keys.filter(F.col("rank").startswith(digits))
        digits, skipped, size = _holding(_counted(inside, len(digits) + 4), place - before)
        before += skipped
    rows = keys.filter(F.col("rank").startswith(digits)).groupBy("rank", key).agg(F.count(F.lit(1)).alias("n")).orderBy("rank", key)
    for r in rows.toLocalIterator():
        before += r["n"]
        if before >= place:
            return r["rank"], r[key]
    raise AssertionError("no such place")


def _by_hash(rows: DataFrame, key: str, seed: int, ends: Ends, last: str) -> DataFrame:
    """The rows with `rank`, their seeded hash, and `split`: the parts that ends(n) names, each up to a place in the order of rank and key, and `last`."""
    held = written(rows.withColumn("rank", hash_rank(seed, F.col(key))))
    keys = held.select("rank", key)
    groups = _counted(keys, 4)
    label = F.lit(last)
    for name, end in reversed(ends(sum(n for _, n in groups))):
        if end > 0:
            rank, upto = _last_key(keys, groups, end, key)
            label = F.when((F.col("rank") < rank) | (F.col("rank") == rank) & (F.col(key) <= F.lit(upto)), F.lit(name)).otherwise(label)
    return held.withColumn("split", label)


def train_valid(rows: DataFrame, key: str, ratio: float = 0.1, seed: int = 17) -> DataFrame:
    """The first tenth in the order of a seeded hash (`rank`) of a unique key is valid, the rest train."""
    return _by_hash(rows, key, seed, lambda n: [("valid", n_valid(n, ratio))], "train")


def train_valid_test(rows: DataFrame, key: str, seed: int = 17, train: float = 0.90, upto: float = 0.95) -> DataFrame:
    """90, 5 and 5 per cent in the order of a seeded hash (`rank`) of a unique key."""
    return _by_hash(rows, key, seed, lambda n: [("train", share(n, train)), ("valid", share(n, upto))], "test")


def train_valid_exact(rows: DataFrame, order: list, ratio: float = 0.1, seed: int = 17) -> DataFrame:
    """As random.Random(seed).shuffle() of the rows in their order would split them, with `position`, their place then; for up to EXACT_ROWS rows."""
    held = written(rows)
    n = held.count()
    if n > EXACT_ROWS:
        raise ValueError(f"{n} rows; train_valid() splits any number")
    shuffled = list(range(n))
    random.Random(seed).shuffle(shuffled)
    to = rows.sparkSession.createDataFrame([(old, new) for new, old in enumerate(shuffled)], "__old long, position long")
    placed = numbered(held, order, "__old", once=True).join(F.broadcast(to), "__old").drop("__old")
    return placed.withColumn("split", F.when(F.col("position") < n_valid(n, ratio), F.lit("valid")).otherwise(F.lit("train")))


def prefix(rows: DataFrame, order: list[str], ratio: float = 0.1) -> DataFrame:
    """The first rows in the order of unique, non-null keys are valid, fewer than ten rows give none; only the keys are dealt."""
    held = written(rows)
    end = share(held.count(), ratio)
    if not end:
        return held.withColumn("split", F.lit("train"))
    last = numbered(held.select(*order), order, once=True).filter(F.col("position") == end - 1).select(F.struct(*order).alias("k"))
    return held.join(F.broadcast(last)).withColumn("split", F.when(F.struct(*(F.col(c) for c in order)) <= F.col("k"), F.lit("valid")).otherwise(F.lit("train"))).drop("k")


def counts(rows: DataFrame, *by: str) -> DataFrame:
    """total, train, valid and test of all rows or of each group."""
    of = lambda s: F.count_if(F.col("split") == s).alias(s)
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), of("train"), of("valid"), of("test"))
