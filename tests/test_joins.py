"""Joins by order and by overlap against loops over all pairs."""

import datetime
import random
from collections import Counter

import pytest

from millrace.operators import joins

DAY = datetime.datetime(2024, 1, 1)
at = lambda s: None if s is None else DAY + datetime.timedelta(microseconds=s)


def tables(spark, seed, n=150):
    rnd = random.Random(seed)
    key = lambda: rnd.choice([1, 1, 1, 1, 2, 3, None])
    time = lambda: rnd.choice([None, *range(0, 60, 3)])
    left = [(i, key(), at(time())) for i in range(n)] + [(0, 1, at(9))] * 2
    right = [(i, key(), at(time()), rnd.choice([None, 1, 2])) for i in range(n)]
    return left, right, spark.createDataFrame(left, "id long, k int, t timestamp_ntz"), spark.createDataFrame(right, "id long, k int, t timestamp_ntz, o int")


@pytest.mark.parametrize("strict, within, slice_rows", [(False, None, 10**6), (False, None, 4), (True, None, 7), (False, 5, 1), (True, 4, 3)])
def test_asof(spark, strict, within, slice_rows):
    left, right, a, b = tables(spark, slice_rows)
    within = within and datetime.timedelta(microseconds=within)
    got = joins.asof_join(a, b, ["k"], "t", "t", order=["o", "id"], strict=strict, within=within, slice_rows=slice_rows)
    assert got.columns == ["id", "k", "t", "right_id", "right_k", "right_t", "right_o"]
    want = Counter()
    for i, k, t in left:
        fits = [r for r in right if k is not None and t is not None and r[1] == k and r[2] is not None and (r[2] < t if strict else r[2] <= t)]
        r = max(fits, key=lambda r: (r[2], r[3] is not None, r[3] or 0, r[0]), default=None)
        want[(i, k, t, *((None,) * 4 if r is None or within and t - within > r[2] else r))] += 1
    assert Counter(map(tuple, got.collect())) == want


def test_asof_numbers_names_and_one_hot_key(spark):
    """Slices of one key are groups of their own; columns may have the names that the join works with."""
    a = spark.createDataFrame([(i, 7, i * 1.5) for i in range(400)], "__t long, k int, x double")
    b = spark.createDataFrame([(i, 7, float(i)) for i in range(0, 600, 10)], "__r long, key int, x double").withColumnRenamed("key", "k")
    got = {r["__t"]: r["b___r"] for r in joins.asof_join(a, b, ["k"], "x", "x", prefix="b_", slice_rows=20).collect()}
    assert got == {i: int(i * 1.5) // 10 * 10 for i in range(400)}
    empty = joins.asof_join(a, b.limit(0), ["k"], "x", "x").filter("right_x is not null").count(), joins.asof_join(a.limit(0), b, ["k"], "x", "x").count()
    assert empty == (0, 0)


@pytest.mark.parametrize("seed", range(3))
def test_overlap(spark, seed):
    rnd = random.Random(seed)

    def made(n):
        rows = []
        for i in range(n):
            a = rnd.choice([None, *range(0, 400, 7)])
            long = rnd.choice([0, 0, 1, 5, 30, 30_000, None, -3])
            rows.append((i, rnd.choice([1, 1, 2, None]), at(a), None if a is None or long is None else at(a + long)))
        return rows + rows[:3]

    left, right = made(60), made(50)
    shape = "id long, k int, a timestamp_ntz, b timestamp_ntz"
    got = joins.overlap_join(spark.createDataFrame(left, shape), spark.createDataFrame(right, shape), ("a", "b"), ("a", "b"), by=["k"])
    fits = lambda r: r[1] is not None and r[2] is not None and r[3] is not None and r[2] <= r[3]
    want = Counter((*p, *q) for p in left for q in right if fits(p) and fits(q) and p[1] == q[1] and p[2] <= q[3] and q[2] <= p[3])
    assert Counter(map(tuple, got.collect())) == want and want
    plan = got._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_overlap_of_numbers_without_keys(spark):
    a = spark.createDataFrame([(0.5, 0.5), (10.0, 10.0), (-3.0, 4.0), (float(2**40), float(2**41))], "a double, b double")
    b = spark.createDataFrame([(0.25, 10.0), (0.75, 0.8), (-1e6, 1e13)], "a double, b double")
    want = {(p.a, q.a) for p in a.collect() for q in b.collect() if p.a <= q.b and q.a <= p.b}
    assert {(r.a, r.right_a) for r in joins.overlap_join(a, b, ("a", "b"), ("a", "b")).collect()} == want
    assert joins.overlap_join(a.limit(0), b, ("a", "b"), ("a", "b")).count() == 0
