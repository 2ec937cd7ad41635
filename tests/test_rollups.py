"""Rollups of stored states, against the rows themselves."""

import datetime
import random
from bisect import bisect_left, bisect_right

import pytest
from pyspark.sql import functions as F

from millrace.operators import rollups

M = rollups.Measures(sums=["v"], distinct=["u"], quantiles=["x"])
DAY = datetime.date(2024, 1, 1)


def rows(n=6000, seed=3):
    rnd = random.Random(seed)
    return [(DAY + datetime.timedelta(days=rnd.choice([0, 0, 0, 1, 2])), rnd.choice(["a", "b", None]), rnd.choice(["p", "q"]), rnd.choice([None, 1, 2, 5]), rnd.randrange(3000), rnd.choice([None, rnd.gauss(0, 1)])) for _ in range(n)]


def made(spark, data):
    return spark.createDataFrame(data, "day date, kind string, place string, v long, u long, x double")


LEVELS = [["period", "kind", "place"], ["period", "kind"], ["kind"], []]


def rolled(stored):
    return rollups.read(rollups.rolled(stored, LEVELS, M, ["period", "kind", "place"]), M, [0.1, 0.5, 0.9]).collect()


def test_levels(spark):
    data = rows()
    got = rolled(rollups.states(made(spark, data), F.col("day"), ["kind", "place"], M))
    keys = (lambda r: (r[0], r[1], r[2]), lambda r: (r[0], r[1], None), lambda r: (None, r[1], None), lambda r: (None, None, None))
    want = {}
    for r in data:
        for level, key in enumerate(keys):
            want.setdefault((level, *key(r)), []).append(r)
    assert {(r.level, r.period, r.kind, r.place) for r in got} == set(want) and len(got) == len(want)
    for r in got:
        of = want[r.level, r.period, r.kind, r.place]
        assert r.n == len(of) and r.sum_v == sum(x[3] or 0 for x in of)
        exact = len({x[4] for x in of})
        assert abs(r.distinct_u - exact) <= max(2, 2 * M.distinct_error() * exact)
        seen = sorted(x[5] for x in of if x[5] is not None)
        for q, value in zip((0.1, 0.5, 0.9), r.quantile_x):
            low, high = bisect_left(seen, value) / len(seen), bisect_right(seen, value) / len(seen)
            assert low - 2 * M.rank_error() <= q <= high + 2 * M.rank_error()


def test_days_add_up(spark, tmp_path):
    """States of days that were stored one by one give what those of all days give."""
    data = rows()
    for day in sorted({r[0] for r in data}):
        rollups.states(made(spark, [r for r in data if r[0] == day]), F.col("day"), ["kind", "place"], M).write.mode("append").parquet(f"{tmp_path}/states")
    got, whole = rolled(spark.read.parquet(f"{tmp_path}/states")), rolled(rollups.states(made(spark, data), F.col("day"), ["kind", "place"], M))
    shown = lambda found: sorted(((r.level, str(r.period), str(r.kind), str(r.place), r.n, r.sum_v) for r in found))
    assert shown(got) == shown(whole)
    assert {(r.level, r.period, r.kind, r.place): r.distinct_u for r in got} == pytest.approx({(r.level, r.period, r.kind, r.place): r.distinct_u for r in whole}, rel=2 * M.distinct_error())


def test_nothing_and_nulls(spark):
    got = rolled(rollups.states(made(spark, [(DAY, None, "p", None, 1, None)]), F.col("day"), ["kind", "place"], M))
    assert {(r.n, r.sum_v, r.distinct_u, tuple(r.quantile_x or ())) for r in got} == {(1, None, 1, ())} and len(got) == 4
    assert [r for r in rolled(rollups.states(made(spark, []), F.col("day"), ["kind", "place"], M)) if r.level < 3] == []
