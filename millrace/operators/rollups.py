"""Rollups from stored states: counts and sums that add up, and sketches of distinct values and quantiles that merge.

Rows are read once, into a state for each period and each group of the finest level. Every coarser level, longer period
and later day is put together from states alone: a day that comes later adds its states and no old row is read again.
A state's size is bounded by its sketches' parameters, so a task merges many with little memory, whatever number of rows
they stand for; Spark adds states up in the tasks before it shuffles them.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Measures:
    """Columns to count and sum, columns whose distinct values count, and columns whose quantiles are asked for.

    lg_k: sketches of distinct values have 2^lg_k bins; k: size of a quantile sketch.
    """

    sums: Sequence[str] = ()
    distinct: Sequence[str] = ()
    quantiles: Sequence[str] = ()
    lg_k: int = 12
    k: int = 400

    def distinct_error(self) -> float:
        """Relative error that a count of distinct values stays within in about 95 of 100 cases."""
        return 2 * 1.04 / sqrt(2**self.lg_k)

    def rank_error(self) -> float:
        """Error of a quantile's rank, as a share of the rows, with a confidence of 99 in 100."""
        return 2.446 / self.k**0.9433


def states(rows: DataFrame, period: Column, dims: Sequence[str], measures: Measures) -> DataFrame:
    """A row for each period and group of dims: n, exact sums, and sketch states. Null dims are a group; null values are left out of their measure."""
    parts = [F.count(F.lit(1)).alias("n")]
    parts += [F.sum(c).alias(f"sum_{c}") for c in measures.sums]
    parts += [F.hll_sketch_agg(c, measures.lg_k).alias(f"hll_{c}") for c in measures.distinct]
    parts += [F.kll_sketch_agg_double(F.col(c).cast("double"), F.lit(measures.k)).alias(f"kll_{c}") for c in measures.quantiles]
    return rows.groupBy(period.alias("period"), *dims).agg(*parts)


def merged(stored: DataFrame, measures: Measures) -> list[Column]:
    """What the states of a group give together, as states again."""
    parts = [F.sum("n").alias("n")]
    parts += [F.sum(f"sum_{c}").alias(f"sum_{c}") for c in measures.sums]
    parts += [F.hll_union_agg(f"hll_{c}").alias(f"hll_{c}") for c in measures.distinct]
    parts += [F.kll_merge_agg_double(f"kll_{c}", F.lit(measures.k)).alias(f"kll_{c}") for c in measures.quantiles]
    return parts


def rolled(stored: DataFrame, levels: Sequence[Sequence[str | Column]], measures: Measures, names: Sequence[str]) -> DataFrame:
    """The states of several levels, each a list of grouping columns; a name that a level hasn't is null, and `level` is its number."""
    out = None
    for number, level in enumerate(levels):
        columns = [F.col(c) if isinstance(c, str) else c for c in level]
        one = stored.groupBy(*columns).agg(*merged(stored, measures))
        kinds = dict(stored.dtypes)
        missing = {n: F.lit(None).cast(kinds.get(n, "string")) for n in names if n not in one.columns}
        one = one.withColumns({**missing, "level": F.lit(number)})
        out = one if out is None else out.unionByName(one)
    return out


def read(found: DataFrame, measures: Measures, at: Sequence[float] = (0.5, 0.95)) -> DataFrame:
    """The states with what they say: distinct_<c>, and quantile_<c>, an array for the ranks asked for, null where there was no value."""
    said = {f"distinct_{c}": F.hll_sketch_estimate(f"hll_{c}") for c in measures.distinct}
    ranks = F.array(*(F.lit(float(q)) for q in at))
    said |= {f"quantile_{c}": F.when(F.kll_sketch_get_n_double(f"kll_{c}") > 0, F.kll_sketch_get_quantile_double(F.col(f"kll_{c}"), ranks)) for c in measures.quantiles}
    return found.withColumns(said).drop(*(f"hll_{c}" for c in measures.distinct), *(f"kll_{c}" for c in measures.quantiles))
