"""Joins by order and by overlap, as equi-joins, windows and sums that Spark deals over tasks.

As-of: each row of one table gets the last row of the other that isn't later. Rows of a key stand in order of time
and the last row seen goes along. A key of many rows is cut into slices of its time; each slice is a
group of its own, and begins with the last row of the slices before it, of which only the ends meet.

Overlap: pairs of intervals that share a point. Intervals are put into bins whose width fits their length, level by
level, so that none lies in more than a few, however long; a pair is found at the wider level of the two, in the bin where
the later one starts, and so once. No pair outside a common bin is looked at.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from datetime import timedelta
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.times import position

#: Rows of a key beyond which its time is cut into slices of about as many.
SLICE_ROWS = 1_000_000
#: How much wider each level's bins are than the last one's.
FACTOR = 8


def _place(rows: DataFrame, column: str) -> Column:
    return position(F.col(column), rows.schema[column].dataType)


def asof_join(
    left: DataFrame, right: DataFrame, by: Sequence[str], left_on: str, right_on: str, order: Sequence[str] = (),
    strict: bool = False, within: timedelta | float | None = None, prefix: str = "right_", slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """All rows of left, with the right row of the same key that has the largest right_on not above left_on (below it, if strict).

    Of right rows at the same time the last by `order` counts (nulls first), then the one with the largest hash. The right
    table's columns come with the prefix, null where nothing matches or the match is further away than `within`. Null
    keys and times match nothing; equal left rows each give a row.
    """
    keys = [f"__k{i}" for i in range(len(by))]
    keyed = lambda rows: [F.col(c).alias(k) for c, k in zip(by, keys)]
    there = lambda on: reduce(and_, (F.col(c).isNotNull() for c in (*by, on)))
    own = F.struct(*(F.col(c) for c in left.columns))
    other = F.struct(*(F.col(c).alias(prefix + c) for c in right.columns))
    shape, met = left.select(own.alias("l")).schema["l"].dataType, right.select(other.alias("r")).schema["r"].dataType
    last = F.struct(*(F.col(c) for c in order), F.xxhash64(*right.columns).alias("__h"))
    ordered = right.select(last.alias("o")).schema["o"].dataType
    asked = left.filter(there(left_on)).select(*keyed(left), _place(left, left_on).alias("__t"), F.lit(0 if strict else 1).alias("__s"), own.alias("__l"), F.lit(None).cast(met).alias("__r"), F.lit(None).cast(ordered).alias("__o"))
    given = right.filter(there(right_on)).select(*keyed(right), _place(right, right_on).alias("__t"), F.lit(1 if strict else 0).alias("__s"), F.lit(None).cast(shape).alias("__l"), other.alias("__r"), last.alias("__o"))
    both = asked.unionByName(given)
    sizes = both.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("__t").alias("__lo"), F.max("__t").alias("hi")).filter(F.col("n") > slice_rows)
    wide = sizes.select(*keys, "__lo", ((F.col("hi") - F.col("__lo") + 1) / F.ceil(F.col("n") / slice_rows)).alias("__w"))
    sliced = both.join(wide, keys, "left").withColumn("__c", F.floor((F.col("__t") - F.col("__lo")) / F.col("__w"))).drop("__lo", "__w")
    upto = Window.partitionBy(*keys, "__c").orderBy("__t", "__s", "__o").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = sliced.withColumn("__r", F.last("__r", ignorenulls=True).over(upto)).filter("__l is not null")
    ends = sliced.filter("__c is not null").groupBy(*keys, "__c").agg(F.max_by("__r", F.when(F.col("__r").isNotNull(), F.struct("__t", "__o"))).alias("e"))
    before = Window.partitionBy(*keys).orderBy("__c").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*keys, "__c", F.last("e", ignorenulls=True).over(before).alias("__e"))
    found = near.join(ends, [*keys, "__c"], "left").select("__l.*", F.coalesce("__r", "__e").alias("__r"))
    missed = left.filter(~there(left_on)).select(*left.columns, F.lit(None).cast(met).alias("__r"))
    done = found.unionByName(missed)
    match = F.col("__r") if within is None else F.when(F.col(left_on) - F.lit(within) <= F.col("__r")[prefix + right_on], F.col("__r"))
    return done.withColumn("__r", match).select(*left.columns, *(F.col("__r")[prefix + c].alias(prefix + c) for c in right.columns))


def _level(base: float) -> Column:
    """The level whose bins are at least as wide as the interval."""
    return F.greatest(F.lit(0), F.ceil(F.log(F.greatest(F.col("__len") / base, F.lit(1.0))) / math.log(FACTOR))).cast("int")


def overlap_join(left: DataFrame, right: DataFrame, left_span: tuple[str, str], right_span: tuple[str, str], by: Sequence[str] = (), prefix: str = "right_") -> DataFrame:
    """Each pair of rows of the same key whose intervals, ends included, share a point; the right table's columns come with the prefix.

    Intervals with a null end or an end before the start, and null keys, are in no pair; equal rows each make their own. A
    point is an interval of equal ends, so points in ranges are found likewise.
    """
    keys = [f"__k{i}" for i in range(len(by))]

    def spans(rows: DataFrame, span: tuple[str, str], side: str, as_prefix: str) -> DataFrame:
        start, end = (_place(rows, c) for c in span)
        row = F.struct(*(F.col(c).alias(as_prefix + c) for c in rows.columns)).alias(side)
        cut = rows.select(row, *(F.col(c).alias(k) for c, k in zip(by, keys)), start.alias("__a"), end.alias("__b")).filter("__a <= __b")
        return cut.filter(" and ".join(["true", *(f"{k} is not null" for k in keys)])).withColumn("__len", F.col("__b") - F.col("__a"))

    sides = spans(left, left_span, "__l", ""), spans(right, right_span, "__r", prefix)
    base = max(1.0, float(sides[0].select("__len").unionByName(sides[1].select("__len")).agg(F.avg("__len")).first()[0] or 1.0))
    sides = tuple(rows.withColumn("__own", _level(base)) for rows in sides)
    there = [{r[0] for r in rows.select("__own").distinct().collect()} for rows in sides]  # a level for each power of FACTOR that a length has

    def binned(rows: DataFrame, others: set[int], name: str) -> DataFrame:
        """A row for each bin of its own level, and of each wider one that the other side has."""
        known = F.array(*(F.lit(m) for m in sorted(there[0] | there[1])))
        levels = F.filter(known, lambda m: (m == F.col("__own")) | (m > F.col("__own")) & m.isin([*others]))
        each = rows.withColumn("__m", F.explode(levels)).withColumn("__wide", base * F.pow(F.lit(float(FACTOR)), "__m"))
        bins = F.sequence(F.floor(F.col("__a") / F.col("__wide")), F.floor(F.col("__b") / F.col("__wide")))
        return each.withColumn("__bin", F.explode(bins)).select(*keys, "__m", "__bin", F.col("__own").alias(f"__own{name}"), F.col("__a").alias(f"__a{name}"), F.col("__b").alias(f"__b{name}"), f"__{name}")

    pairs = binned(sides[0], there[1], "l").join(binned(sides[1], there[0], "r"), [*keys, "__m", "__bin"])
    start = F.greatest("__al", "__ar")
    once = (F.col("__m") == F.greatest("__ownl", "__ownr")) & (F.col("__bin") == F.floor(start / (base * F.pow(F.lit(float(FACTOR)), "__m"))))
    return pairs.filter(once & (start <= F.least("__bl", "__br"))).select("__l.*", "__r.*")
